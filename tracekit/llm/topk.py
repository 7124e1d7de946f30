"""Exact top-k inner-product search by a three-phase uniform threshold.

Method
* Vectors are cut by dimension into ``SLICES`` slices; a node holds one slice of one block of vectors and can only
  tell partial scores. The score of a pair is the sum of its partial scores.
* Phase 1: each node lists, for each query, its ``LISTED`` best partial scores. The ``LISTED`` best of each slice are gathered
  and resolved exactly; the k-th best of these scores, t, is a safe cutoff: k candidates reach it.
* Phase 2: a candidate of score t or more has a partial score of t / SLICES or more in some slice (the greatest of
  numbers is not below their mean). Each node gets the queries' cutoffs and sends exactly such entries.
* Phase 3: the candidates collected are resolved: those that every slice sent have their sum, the others get the
  inner product of the whole vectors. The k best are returned, ties to the smaller vec_id.

Queries meet the vectors in blocks (dense matrix products in NumPy, in float64 while that is exact). Identical vectors keep
only their k + 1 smallest ids as candidates, since ties go to the smaller id; a very common vector costs no more than a rare one.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part, nor do null ids; rows that
repeat a vec_id count once (the smallest vector); vectors of different lengths do not meet; a query with fewer
than k candidates gets them all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracekit.llm.common import settle, ship

ship(__name__)

SLICES = 2
LISTED = 48
BLOCK = 4096        # vectors in a block
QUERY_BLOCK = 512
ENTRY = "query_id long, slice int, vec_id long, partial long"
EXACT = 2**53


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x); unusable vectors left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _slices(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each slice of each vector."""
    n, rest = F.size("v"), F.lit(SLICES)
    first = lambda j: F.floor(n * j / rest).cast("int")
    parts = F.array(*[F.struct(F.lit(j).alias("slice"), F.slice("v", first(F.lit(j)) + 1, first(F.lit(j + 1)) - first(F.lit(j))).alias("part"))
                      for j in range(SLICES)])
    return rows.select(*more, "vec_id", n.alias("dim"), F.explode(parts).alias("x")).select(*more, "vec_id", "dim", "x.*")


def _pack(rows: DataFrame, size: int, block: str, *more: str) -> DataFrame:
    """Rows gathered into blocks of about ``size`` vectors (blocks are dealt by a hash of the id)."""
    n = max(1, -(-rows.select("vec_id").distinct().count() // size))
    at = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(block)
    entry = F.struct("vec_id", "part", *more)
    return (rows.groupBy("dim", "slice", at).agg(F.sort_array(F.collect_list(entry)).alias("e"))
            .select("dim", "slice", block, *[F.col(f"e.{c}").alias(f"{block}_{c}") for c in ("vec_id", "part", *more)]))


def _matrix(parts) -> np.ndarray:
    flat = parts.values
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    bound = max(1, a.shape[1]) * most[0] * most[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -2**63, 2**63 - 1).astype(np.int64)


def _score(select):
    """Runs ``select(scores, batch, row) -> (query rows, vector columns)`` on the scores of each pair of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i]  # noqa: B023, E731
                q, v = at("qblock_vec_id").values.to_numpy(), at("block_vec_id").values.to_numpy()
                s = products(_matrix(at("qblock_part")), _matrix(at("block_part")))
                r, c = select(s, q[:, None] == v[None, :], at)
                n = len(r)
                yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(np.full(n, at("slice").as_py(), np.int32)), pa.array(v[c]), pa.array(s[r, c])],
                                                 ["query_id", "slice", "vec_id", "partial"])
    return run


def _listed(n: int):
    def select(s, own, at):
        s[own] = np.iinfo(np.int64).min
        k = min(n, s.shape[1])
        c = np.argpartition(-s.astype(np.float64), k - 1, axis=1)[:, :k]
        r = np.repeat(np.arange(len(s)), k)
        c = c.ravel()
        keep = ~own[r, c]
        return r[keep], c[keep]
    return select


def _above(s, own, at):
    return np.nonzero((s >= at("qblock_need").values.to_numpy()[:, None]) & ~own)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda x, y: x + y)


def _best(rows: DataFrame, by: list[str], score: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _resolved(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    return pairs.join(vectors, "vec_id").join(q, "query_id").select("query_id", "vec_id", _dot("qv", "v").alias("score"))


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose vec_id ``every`` divides."""
    rows = settle(quantised(vectors, scale))
    queries = settle(rows.where(F.col("vec_id") % every == 0))
    alike = Window.partitionBy("v").orderBy("vec_id")
    kept = settle(rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).drop("n"))
    blocks = settle(_pack(_slices(kept), BLOCK, "block"))
    numbers = blocks.select("dim", "slice", "block")

    def with_blocks(packed: DataFrame) -> DataFrame:
        return packed.join(numbers, ["dim", "slice"]).join(blocks, ["dim", "slice", "block"])

    parts = _slices(queries)
    lists = with_blocks(_pack(parts, QUERY_BLOCK, "qblock")).mapInArrow(_score(_listed(LISTED)), ENTRY)
    gathered = _best(lists, ["query_id", "slice"], "partial", LISTED).select("query_id", "vec_id").distinct()
    cutoff = (_best(_resolved(gathered, queries, kept), ["query_id"], "score", k).groupBy("query_id")
              .agg(F.when(F.count("*") == k, F.min("score")).alias("t")))
    need = F.coalesce(F.ceil(F.col("t").cast("decimal(20,0)") / SLICES).cast("long"), F.lit(-2**63))
    cutoff = settle(cutoff.select("query_id", need.alias("need")))

    asked = parts.join(cutoff, parts.vec_id == cutoff.query_id).drop("query_id")
    entries = with_blocks(_pack(asked, QUERY_BLOCK, "qblock", "need")).mapInArrow(_score(_above), ENTRY)
    found = settle(entries.groupBy("query_id", "vec_id").agg(F.count("*").alias("n"), F.sum("partial").alias("score")))
    known = found.where(F.col("n") == SLICES).select("query_id", "vec_id", "score")
    missing = _resolved(found.where(F.col("n") < SLICES).select("query_id", "vec_id"), queries, kept)
    return _best(known.unionByName(missing), ["query_id"], "score", k).select("query_id", "rank", "vec_id", "score")
