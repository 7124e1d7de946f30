"""Hard negatives by Hilbert-ordered Parquet blocks and zone maps.

Method
* Candidates are ordered by label and by their place on a Hilbert curve through the dimensions of greatest variance, cut
  into blocks and written as Parquet, one row for each block: ids, labels, vectors, and the zone map, the least and greatest
  value of each dimension and of the label. The zone maps are read without the vectors.
* A search has, for each anchor, windows of scores. Interval arithmetic bounds the scores that a block can hold; an anchor reads
  a block only if these bounds meet one of its windows (and the labels of the block are of use).
* Each search is made twice: first every anchor reads the block that can hold its highest scores. Windows that find enough there
  are raised to the k-th score found; then the other blocks that the windows still meet are read.
* The first search finds an anchor's positives (its label, all scores); they set the windows of the second (other labels).

Anchors go in chunks, zone maps in pages and candidates in blocks, so tasks hold matrices of set size; a block and the
chunks that read it meet by a join on the block's number. Of candidates with one label and one vector only the
k + 1 smallest ids are written, which are all that ties to the smaller id can return.

Defined results: rows with a null id, label or vector, or with a null, NaN or infinite component take no part; rows that
repeat an id count once (the least label, then vector); vectors of different lengths do not meet; an anchor without
positives has no rows, nor has a positive score below 0 (its window is empty); scores beyond a long are cut off at its
bounds; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracekit.llm import hilbert
from tracekit.llm.common import drop, scratch, settle, ship
from tracekit.llm.topk import products

ship(__name__)

LOW, HIGH = -2**63, 2**63 - 1
BLOCK = 2048            # candidates in a block, fewer if vectors are long
CHUNK = 256             # anchors in a chunk
PAGE = 512              # zone maps in a page
NUMBERS = 1 << 17       # vector entries in a block
AXES, BITS = 16, 4      # of the Hilbert curve
STATED = 1 << 20        # entries of dimension statistics that go to the tasks; lengths beyond are ordered by label and id
ROW = "vec_id long, label long, dim int, v array<long>"
KEYED = ROW + ", key binary"
STORED = "dim int, block long, n int, label_lo long, label_hi long, lo array<long>, hi array<long>, ids array<long>, labels array<long>, data array<long>"
FOUND = "anchor_id long, w int, vec_id long, score long"
TASK = "dim int, block long, q_id array<long>, q_label array<long>, q_data array<long>, q_low array<long>, q_high array<long>"


def quantised(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """``ROW`` of the usable rows: each component x as floor(scale * x), one row for an id."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~bad)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).where("label is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return rows.select("vec_id", "r.label", F.size("r.v").alias("dim"), "r.v")


def _matrix(lists, dim: int) -> np.ndarray:
    return lists.to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.empty((0, 0), np.int64)


# ------------------------------------------------------------ blocks and their zone maps

def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims[dims > 0]).tolist():
            v = _matrix(pc.list_flatten(batch.column("v").filter(pa.array(dims == dim))), dim).astype(np.float64)
            total[dim] = total.get(dim, 0) + np.vstack([np.full(dim, len(v), np.float64), v.sum(axis=0), (v * v).sum(axis=0)])
    for dim, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), *map(pa.array, m)], ["dim", "at", "n", "s", "ss"])


def _axes(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each vector length (up to ``STATED`` entries): the dimensions of greatest variance, with the cells' start and width."""
    parts = rows.mapInArrow(_moments, "dim int, at int, n double, s double, ss double").groupBy("dim", "at").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    of: dict[int, list] = {}
    for r in parts.orderBy("dim", "at").limit(STATED).toLocalIterator():
        of.setdefault(r.dim, []).append((r.s / r.n, max(0.0, r.ss / r.n - (r.s / r.n) ** 2)))
    out = {}
    for dim, m in of.items():
        if len(m) == dim:
            mean, spread = np.array([x[0] for x in m]), np.sqrt([x[1] for x in m])
            axes = np.sort(np.argsort(-spread, kind="stable")[:AXES])
            out[dim] = axes, mean[axes] - 2 * spread[axes], np.maximum(4 * spread[axes] / (1 << BITS), 1e-9)
    return out


def _keyed(axes: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            keys = np.full(batch.num_rows, b"", object)
            for dim in np.unique(dims).tolist():
                if dim in axes:
                    at, start, width = axes[dim]
                    mask = dims == dim
                    v = _matrix(pc.list_flatten(batch.column("v").filter(pa.array(mask))), dim)[:, at]
                    cells = np.clip(np.floor((v - start) / width), 0, (1 << BITS) - 1)
                    keys[mask] = [k.tobytes() for k in hilbert.position(cells, BITS)]
            yield batch.append_column("key", pa.array(keys.tolist(), pa.binary()))
    return run


def _blocks(size: int, numbers: int):
    """Cuts sorted rows into blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made, held, held_dim = TaskContext.get().partitionId() << 32, 0, [], None

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            flat = pc.list_flatten(rows.column("v"))
            v, labels = _matrix(flat, held_dim), rows.column("label").to_numpy()
            one = lambda x: pa.array([x])
            return pa.RecordBatch.from_arrays(
                [pa.array([held_dim], pa.int32()), one(first + made), pa.array([rows.num_rows], pa.int32()), one(int(labels.min())), one(int(labels.max())),
                 *[pa.array([list(f(axis=0)) if held_dim else []], pa.list_(pa.int64())) for f in (v.min, v.max)],
                 *[pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x) for x in (rows.column("vec_id"), rows.column("label"), flat)]],
                [c.split()[0] for c in STORED.split(", ")])

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                while a < b:
                    if held and held_dim != dims[a]:
                        yield block()
                        made, held = made + 1, []
                    held_dim = int(dims[a])
                    most = max(64, min(size, numbers // max(1, held_dim)))
                    room = most - sum(x.num_rows for x in held)
                    held.append(batch.slice(a, min(b - a, room)))
                    a += min(b - a, room)
                    if room <= held[-1].num_rows:
                        yield block()
                        made, held = made + 1, []
        if held:
            yield block()
    return run


def write_blocks(rows: DataFrame, path: str, k: int) -> None:
    """The candidates' blocks, as a Parquet table."""
    spark = rows.sparkSession
    alike = Window.partitionBy("label", "v").orderBy("vec_id")
    kept = rows.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).drop("_n")
    keyed = f"{path}-keyed"
    kept.mapInArrow(_keyed(_axes(rows)), KEYED).write.parquet(keyed)
    ordered = spark.read.schema(KEYED).parquet(keyed)
    total = ordered.agg(F.sum(F.greatest(F.col("dim"), F.lit(1)).cast("double") / NUMBERS + 1.0 / BLOCK)).first()[0] or 0
    order = ["dim", "label", "key", "vec_id"]
    ordered = ordered.repartitionByRange(max(1, math.ceil(total / 4)), *order).sortWithinPartitions(*order)
    ordered.mapInArrow(_blocks(BLOCK, NUMBERS), STORED).write.parquet(path)
    drop(spark, keyed)


# ------------------------------------------------------------ which blocks an anchor reads

def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of a with vectors between a row of lo and that of hi."""
    most = max(1, a.shape[1]) * max(int(np.abs(a.astype(np.float64)).max(initial=0)) + 1, 1) * (max([int(np.abs(x.astype(np.float64)).max(initial=0)) for x in (lo, hi)]) + 1)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    if most < 2**61:
        return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)
    up, down, lo, hi = (x.astype(object) for x in (up, down, lo, hi))
    return tuple(np.clip(x, LOW, HIGH).astype(np.int64) for x in (up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T))


def _needed(same: bool, first: bool):
    """Of each chunk of anchors and page of zone maps: each anchor's best block, or all reads that remain, by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                ids, labels, dim = at("q_id"), at("q_label"), batch.column("dim")[i].as_py()
                flat = at("q_data")
                a, blocks = flat.reshape(len(ids), dim), at("z_block")
                least, most = bounds(a, *[at(c).reshape(len(blocks), dim) for c in ("z_lo", "z_hi")])
                if same:
                    use = (at("z_label_lo") <= labels[:, None]) & (labels[:, None] <= at("z_label_hi"))
                else:
                    use = (at("z_label_lo") != labels[:, None]) | (labels[:, None] != at("z_label_hi"))
                low, high = at("q_low").reshape(len(ids), -1), at("q_high").reshape(len(ids), -1)
                meets = np.zeros(use.shape, bool)
                for w in range(low.shape[1]):
                    x, y = low[:, w, None], high[:, w, None]
                    meets |= (x <= y) & (least <= y) & (most >= x)
                use &= meets
                if first:
                    rows = np.flatnonzero(use.any(axis=1))
                    best = np.where(use[rows], most[rows], LOW).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(blocks[best]), pa.array(most[rows, best])], ["anchor_id", "block", "most"])
                    continue
                use &= at("q_done")[:, None] != blocks
                for j in np.flatnonzero(use.any(axis=0)).tolist():
                    rows = np.flatnonzero(use[:, j])
                    one = lambda x: pa.ListArray.from_arrays(np.array([0, x.size], np.int32), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([int(blocks[j])]), *map(one, (ids[rows], labels[rows], a[rows], low[rows], high[rows]))],
                                                     [c.split()[0] for c in TASK.split(", ")])
    return run


def _read(same: bool, k: int):
    """Scores of the anchors with the block they read: of each window the first k rows by score, then id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                q, ids, dim = at("q_id"), at("ids"), batch.column("dim")[i].as_py()
                s = products(at("q_data").reshape(len(q), dim), at("data").reshape(len(ids), dim))
                use = (at("q_label")[:, None] == at("labels")) == same
                use &= q[:, None] != ids
                low, high = at("q_low").reshape(len(q), -1), at("q_high").reshape(len(q), -1)
                for w in range(low.shape[1]):
                    inside = use & (s >= low[:, w, None]) & (s <= high[:, w, None])
                    if len(ids) > k:
                        inside &= s >= np.partition(np.where(inside, s, LOW), -k, axis=1)[:, -k, None]
                    r, c = np.nonzero(inside)
                    score = s[r, c]
                    order = np.lexsort((ids[c], -score.astype(object) if score.min(initial=0) == LOW else -score, r))
                    r, c, score = r[order], c[order], score[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c, score = r[place < k], c[place < k], score[place < k]
                    yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(np.full(len(r), w, np.int32)), pa.array(ids[c]), pa.array(score)], ["anchor_id", "w", "vec_id", "score"])
    return run


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(anchors: DataFrame, by: list[Column], *more: str) -> DataFrame:
    """Anchors (vec_id, label, v, low, high) gathered in chunks."""
    e = F.collect_list(F.struct("vec_id", "label", "v", "low", "high", *more))
    rows = anchors.groupBy("dim", *by).agg(e.alias("e"))
    flat = {"q_id": F.col("e.vec_id"), "q_label": F.col("e.label"), **{f"q_{c}": F.flatten(f"e.{x}") for c, x in (("data", "v"), ("low", "low"), ("high", "high"))}}
    return rows.select(*[c for c in rows.columns if c != "e"], *[x.alias(c) for c, x in flat.items()], *[F.col(f"e.{m}").alias(f"q_{m}") for m in more])


def search(anchors: DataFrame, stored: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, w, vec_id, score, rank): the first k rows of each anchor's windows.

    ``anchors`` is (vec_id, label, dim, v, low array<long>, high array<long>), with as many windows for each; rows of the
    anchor's own label, without the anchor itself, or of other labels.
    """
    zones = stored.select("dim", "block", "label_lo", "label_hi", "lo", "hi")
    pages, chunks = (max(1, -(-f.count() // size)) for f, size in ((zones, PAGE), (anchors, CHUNK)))
    page = F.pmod(F.xxhash64("block"), F.lit(pages)).cast("int").alias("page")
    e = F.collect_list(F.struct("block", "label_lo", "label_hi", "lo", "hi"))
    paged = zones.groupBy("dim", page).agg(e.alias("e")).select(
        "dim", "page", *[F.col(f"e.{c}").alias(f"z_{c}") for c in ("block", "label_lo", "label_hi")], *[F.flatten(f"e.{c}").alias(f"z_{c}") for c in ("lo", "hi")])
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk")
    every = F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page")

    def needed(df: DataFrame, first: bool, schema: str, *more: str) -> DataFrame:
        pairs = _packed(df, [chunk], *more).select("*", every).join(paged, ["dim", "page"])
        return pairs.mapInArrow(_needed(same, first), schema)

    def read(tasks: DataFrame) -> DataFrame:
        blocks = stored.select("dim", "block", "ids", "labels", "data")
        return tasks.join(blocks, ["dim", "block"]).mapInArrow(_read(same, k), FOUND)

    best = needed(anchors, True, "anchor_id long, block long, most long").groupBy("anchor_id").agg(F.max_by("block", F.struct("most", "block")).alias("done"))
    best = settle(anchors.join(best, anchors.vec_id == best.anchor_id).drop("anchor_id"))
    found = settle(_first(read(_packed(best.withColumn("block", F.col("done")), [F.col("block"), chunk]).drop("chunk")), k).drop("rank"))
    cut = (found.groupBy("anchor_id", "w").agg(F.when(F.count("*") == k, F.min("score")).alias("cut"))
           .groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "cut"))).alias("cut")))
    raised = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("cut", w), x)))
    rest = best.join(cut, best.vec_id == cut.anchor_id, "left").withColumn("low", raised).drop("anchor_id", "cut")
    more = read(needed(rest, False, TASK, "done"))
    return _first(found.unionByName(more), k)


def hard_negatives(vectors: DataFrame, *, label: Column | None = None, anchors_every: int = 100, positives: int = 5, negatives: int = 5,
                   low_percent: int = 80, high_percent: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    Negatives of a positive of score p have scores s with low_percent * p <= 100 * s <= high_percent * p.
    """
    spark = vectors.sparkSession
    path, rows_path = scratch(spark, "negatives"), scratch(spark, "negatives-rows")
    quantised(vectors, F.col("label") if label is None else label, scale).write.parquet(rows_path)
    rows = spark.read.schema(ROW).parquet(rows_path)
    write_blocks(rows, path, max(positives, negatives))
    stored = spark.read.schema(STORED).parquet(path)
    anchors = settle(rows.where(F.col("vec_id") % anchors_every == 0))
    drop(spark, rows_path)
    full = lambda x: F.array(F.lit(x).cast("long"))
    near = search(anchors.withColumn("low", full(LOW)).withColumn("high", full(HIGH)), stored, positives, True)
    near = settle(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("w")))
    exact = F.col("positive_score").cast("decimal(38,0)")
    edge = lambda f, percent: F.least(F.greatest(f(exact * percent / F.lit(100).cast("decimal(3,0)")), F.lit(LOW)), F.lit(HIGH)).cast("long")
    windows = near.select("anchor_id", "w", edge(F.ceil, low_percent).alias("low"), edge(F.floor, high_percent).alias("high"))
    windows = windows.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("low", "high")))).alias("m"))
    side = lambda c, none: F.array(*[F.coalesce(F.try_element_at("m", F.lit(w))[c], F.lit(none)) for w in range(positives)]).alias(c)
    asked = anchors.join(windows, anchors.vec_id == windows.anchor_id).select("vec_id", "label", "dim", "v", side("low", HIGH), side("high", LOW))
    found = settle(search(settle(asked), stored, negatives, False))
    drop(spark, path)
    out = near.join(found.select("anchor_id", "w", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["anchor_id", "w"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
