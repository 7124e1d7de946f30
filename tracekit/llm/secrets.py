"""Secret scan with an incremental blob ledger.

Method
* Every historical version of every path is content-addressed: its blob is the SHA-256 of its UTF-8 text.
* The ledger is a Parquet table of (blob, rules, spans): which rule versions have scanned a blob, and what they found.
  A run scans only the pairs of blob and rule version that no ledger row holds, each blob once however many paths and
  versions hold it, and appends one row for each scanned blob. Raising a rule's version scans
  it anew; the other rules' findings stand.
* Findings are joined back to all paths.

The ids of blobs are shuffled without their texts, except that one text for each blob goes to the scan (a map-side
limit of one row for each blob comes first, so a blob held by very many paths costs no more than the tasks that saw it).

Defined results: null content is the empty blob; repeated rows give repeated results; null paths are kept;
an empty table scans nothing; columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracekit.llm.common import settle, ship, slices

ship(__name__)


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int | str = 0
    least: int = 1
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the kinds and patterns of the base rules
BASE = (
    Rule("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # a run of 16 or more is a maximal run of that length
)
RULES = (*BASE, Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----"))
FEW_BLOBS = 100_000  # hashes of 32 bytes that are broadcast to pick the texts before they are shuffled
LEDGER = "blob binary, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"


def find(rule: Rule, text: str) -> list[tuple[int, int]]:
    """(start, end) in code points."""
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]


def _scan(rules: Sequence[Rule]):
    by_id = {r.id: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part in slices(batches):
            spans = [[(i, *s) for i in due for s in find(by_id[i], text)]
                     for due, text in zip(part.column("rules").to_pylist(), part.column("text").to_pylist())]
            spans = [[{"rule": i, "start": a, "end": b} for i, a, b in row] for row in spans]
            yield pa.RecordBatch.from_arrays([part.column("blob"), part.column("rules"), pa.array(spans, spans_type)], ["blob", "rules", "spans"])
    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, rules): the rule versions with which each distinct blob is still to be scanned."""
    every = F.array(*[F.lit(r.id) for r in rules])
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    due = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", due.alias("rules")).where(F.size("rules") > 0)


def scan_history(versions: DataFrame, ledger_path: str, *, rules: Sequence[Rule] = RULES, path: str = "path",
                 content: str = "content") -> DataFrame:
    """(path, blob, spans) for each row of ``versions``; spans by start, then in the rules' order.

    Scans what the ledger at ``ledger_path`` has not seen and appends it there.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(content), F.lit(""))
    blob = F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob")
    paths = settle(versions.select(F.col(path).alias("path"), blob))
    due = settle(unseen(paths, read_ledger(spark, ledger_path), rules))
    if n := due.count():  # texts that have been seen are not moved
        texts = versions.select(blob, text.alias("text"))
        if n <= FEW_BLOBS:
            texts = texts.join(F.broadcast(due.select("blob")), "blob", "left_semi")
        one = Window.partitionBy("blob").orderBy(F.lit(0))
        texts = texts.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
        scanned = texts.join(due, "blob").select("blob", "rules", "text").mapInArrow(_scan(rules), LEDGER)
        scanned.write.mode("append").parquet(ledger_path)

    ids, order = [r.id for r in rules], F.array(*[F.lit(r.id) for r in rules])
    found = (read_ledger(spark, ledger_path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("s")))
    current = F.filter("s", lambda x: x["rule"].isin(ids))
    placed = F.transform(current, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["rule"]).alias("at"), x["end"].alias("end")))
    spans = F.transform(F.sort_array(placed), lambda x: F.struct(
        F.element_at(F.array(*[F.lit(r.kind) for r in rules]), x["at"].cast("int")).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    # settled, so that a blob held by very many paths is a skewed join that Spark can split
    return paths.join(settle(found.select("blob", spans.alias("spans"))), "blob", "left").select("path", "blob", "spans")


def digest(found: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """(doc_id, n_<kind>..., base_sha256, spans) from the result of ``scan_history``."""
    return found.select(F.col("path").alias("doc_id"), *span_digest("spans", [r.kind for r in base]))


def span_digest(spans: str, base: Sequence[str]) -> list[F.Column]:
    """Counts of the base kinds, the SHA-256 of their spans and all spans as text, from sorted structs."""
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = F.filter(spans, lambda x: x["kind"].isin(list(base)))
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    return [*[count(k).alias(f"n_{k}") for k in base], F.sha2(said(own).cast("binary"), 256).alias("base_sha256"), said(F.col(spans)).alias("spans")]
