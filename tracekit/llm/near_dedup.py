"""MinHash near-duplicate detection with min-max hashing.

Method
* A document is the set of its distinct k-word shingles, as 64-bit hashes.
* Min-max hashing: under each of ``PERMUTATIONS`` hash functions both the minimum and the maximum are
  kept, so ``2 * PERMUTATIONS`` signature values cost half the hash evaluations. Both agree between two
  sets with the probability of their Jaccard similarity. A band holds values of different functions only.
  A pair at the threshold shares no band with probability below 1e-5 (20 bands of 5 values for 0.85,
  25 bands of 4 for thresholds from 0.8 on).
* Equal sets are folded into one representative (the smallest id) before the bands are shuffled.
* Pass 1: in each bucket (documents sharing a band) every member is paired with the bucket's smallest
  member, and the pairs are confirmed on the full sets.
* Further passes settle what a star misses: while a bucket holds more than one component, the members
  outside its largest component are, a bounded pack at a time, compared on full sets with all other
  members of the bucket. Only confirmed links leave a task, at most one for each leader, so a group of
  m near copies costs rows in proportion to m, and no link within a bucket is lost.
* Components by alternating stars.

Defined results: a null or blank text has an empty set and is linked with nothing; rows repeating a
doc_id are one node; a null doc_id is its own (null) component and is kept; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracekit.llm.common import forget_worker_state, mix, release, settle, ship, slices, text_shingles
from tracekit.llm.components import components

ship(__name__)

PERMUTATIONS = 50
PACK = 1 << 21      # shingles of the leaders compared at once in a bucket (16 MB), one leader at least
SHARD = 2_000       # members of a bucket that one task compares with a pack
MAX_ROUNDS = 10_000
SIGNATURE = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2**63, n, dtype=np.uint64))


def min_max_signature(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """(sets, 2 * permutations): all minima, then all maxima. The sets must not be empty."""
    mult, add = _functions(permutations)
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])]) if sets else np.empty(0, np.int64)
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    for i in range(permutations if sets else 0):
        h = values * mult[i]
        h += add[i]
        out[:, i] = np.minimum.reduceat(h, starts)
        out[:, permutations + i] = np.maximum.reduceat(h, starts)
    return out


def band_rows(percent: int) -> int:
    """Signature values in a band."""
    return 5 if percent >= 85 else 4


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit keys; the band's number is part of its key."""
    n, width = signature.shape
    bands = width // rows
    keys = np.empty((n, bands), np.uint64)
    for b in range(bands):
        acc = np.full(n, b + 1, np.uint64)
        for j in range(b * rows, (b + 1) * rows):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + signature[:, j])
        keys[:, b] = acc
    return keys


def _sign(k: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forget_worker_state()
        for part in slices(batches):
            sets = [np.unique(s) for s in text_shingles(part.column("text"), k)]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(min_max_signature(full), band).view(np.int64).tolist())
            rows = [(xxhash.xxh3_128_digest(s.tobytes()), next(keys)) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker_state()
        for part in slices(batches):
            sets = [np.unique(s).view(np.int64) for s in text_shingles(part.column("text"), k)]
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])
    return run


class _Pack:
    """A bucket's leaders, with their shingles in one sorted array."""

    def __init__(self, rows: list[tuple]):
        self.rep = np.array([r[0] for r in rows], np.int64)
        self.component = np.array([r[1] for r in rows], np.int64)
        self.bands = np.stack([r[2] for r in rows])
        self.size = np.array([len(r[3]) for r in rows], np.int64)
        values, owner = np.concatenate([r[3] for r in rows]), np.repeat(np.arange(len(rows)), self.size)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def links(self, key: int, component: int, bands: np.ndarray, mine: np.ndarray, percent: int) -> np.ndarray:
        """Leaders of other components whose set is near ``mine`` and whose first shared band is ``key``."""
        equal = self.bands == bands
        due = (self.component != component) & (bands[equal.argmax(1)] == key)
        due &= 100 * np.minimum(self.size, len(mine)) >= percent * np.maximum(self.size, len(mine))
        if not due.any():
            return self.rep[:0]
        low, high = np.searchsorted(self.values, mine), np.searchsorted(self.values, mine, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.rep))
        return self.rep[due & (100 * both >= percent * (self.size + len(mine) - both))]


def _links(percent: int):
    """Leader rows, then member rows of each (key, shard) -> confirmed links. Only the leaders are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders, pack = None, [], None
        for batch in batches:
            flat = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "shard", "member", "rep", "component", "bands", "shingles")]
            a, b = [], []
            for key, shard, member, rep, component, bands, mine in zip(*flat):
                if (key, shard) != at:
                    at, leaders, pack = (key, shard), [], None
                if not member:
                    leaders.append((rep, component, bands, mine))
                    continue
                pack = pack or _Pack(leaders)
                found = pack.links(key, component, bands, mine, percent)
                a += [rep] * len(found)
                b += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links: components of components, so the old links are not needed."""
    def of(side: str) -> DataFrame:
        return comp.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))

    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = settle(components(ends))
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = comp.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return known.unionByName(merged.join(comp, "node", "left_anti"))


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked if ``100 * |intersection| >= percent * |union|`` of their k-word shingle
    sets. The bands are made for a similarity of 0.8 or more.
    """
    texts = docs.select("doc_id", "text")
    sig = settle(texts.mapInArrow(_sign(k, band_rows(percent)), SIGNATURE))
    full = sig.where("n_shingles > 0 and doc_id is not null")
    groups = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    copies = full.join(groups, "set_key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = full.join(groups.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"])
    buckets = reps.select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("bands").alias("key"))
    least = buckets.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    # rows of documents that share a bucket with another one
    shared = settle(buckets.join(least, "key").select("key", "rep", "n_shingles", "first"))
    release(docs.sparkSession)
    wanted = shared.select("rep").distinct()
    sets = settle(texts.join(wanted, texts.doc_id == wanted.rep).select("rep", "text")
                  .mapInArrow(_sets(k), "rep long, shingles array<long>")
                  .join(full.select(F.col("doc_id").alias("rep"), "bands"), "rep"))
    release(docs.sparkSession)

    pairs = shared.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    one, two = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = settle(pairs.join(two, "b").join(one, "a").select("a", "b", both.alias("n"), (F.size("sa") + F.size("sb")).alias("t"))
                   .where(100 * F.col("n") >= percent * (F.col("t") - F.col("n"))).select("a", "b").unionByName(copies))
    comp = settle(components(links))
    release(docs.sparkSession)
    tested = None
    for _ in range(MAX_ROUNDS):
        members = (shared.groupBy("key", "rep").agg(F.max("n_shingles").alias("n_shingles"))
                   .join(comp, F.col("rep") == comp.node, "left")
                   .select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("component")))
        spread = (members.groupBy("key", "component").agg(F.count("*").alias("n"))
                  .groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"),
                                      F.ceil(F.sum("n") / SHARD).cast("int").alias("shards"), F.count("*").alias("c"))
                  .where("c > 1").drop("c"))
        mixed = settle(members.join(spread, "key"))
        left = mixed.where("component <> main").drop("main")
        if tested is not None:
            left = left.join(tested, ["key", "rep"], "left_anti")
        before = F.sum("n_shingles").over(Window.partitionBy("key").orderBy("rep").rowsBetween(Window.unboundedPreceding, -1))
        turn = settle(left.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < PACK).select("key", "shards", "rep", "component"))
        if turn.isEmpty():
            break
        lead = turn.select("key", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
                           F.lit(False).alias("member"), "rep", "component")
        rest = (mixed.join(turn.select("key").distinct(), "key")
                .select("key", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int").alias("shard"),
                        F.lit(True).alias("member"), "rep", "component"))
        found = settle(lead.unionByName(rest).join(sets, "rep").repartition("key", "shard")
                       .sortWithinPartitions("key", "shard", "member")
                       .select("key", "shard", "member", "rep", "component", "bands", "shingles")
                       .mapInArrow(_links(percent), "a long, b long").distinct())
        if not found.isEmpty():
            comp = settle(_joined(comp, found))
        done = turn.select("key", "rep")
        tested = settle(done if tested is None else tested.unionByName(done))
        release(docs.sparkSession)
    else:
        raise RuntimeError(f"buckets did not settle in {MAX_ROUNDS} rounds")
    out = sig.join(comp, sig.doc_id == comp.node, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
