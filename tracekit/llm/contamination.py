"""Benchmark decontamination: size-partitioned MinHash containment search.

Method
* Items and documents are sets of k-word shingles. Item x is contained in document d if d holds at least
  ``percent`` of x's shingles.
* Items are partitioned by set size (powers of two). An item's sketch is its ``SKETCH`` smallest
  shingle hashes (all of them, if fewer). Each size partition has a cut-off, the greatest hash in any of its
  sketches: short items need a high one, long items a low one. Only document shingles below some cut-off are
  looked up, against the sketches of the partitions whose cut-off they pass.
  A Jaccard-based banding would need thousands of hashes here: a 50-shingle item inside a document of
  20,000 words has a similarity of 0.0025. A containment sketch does not depend on the document's size.
* One sketch hit makes a candidate: an item of similarity 0.8 is missed with probability 0.2 ** SKETCH.
* Candidates are verified on the exact shingles (the words, not their hashes).

The items travel to the tasks as a broadcast while they hold at most ``MAX_BROADCAST`` shingles; beyond it sketches
and documents meet in a join on the hash instead, with the same result.

Defined results: an item without words is contained in nothing; an item of fewer than k words is one shingle,
its whole sequence, which only a document of exactly these words holds; null or blank documents contain
nothing; repeated documents give repeated rows, repeated items (same id and text) one; columns other than ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracekit.llm.common import forget_worker_state, ship, slices, text_shingles

ship(__name__)

SKETCH = 12
MAX_BROADCAST = 2_000_000  # shingles: 16 MB of hashes
OUT = "doc_id long, item_id long, n_item long, n_shared long"


def word_shingles(text: str | None, k: int) -> set[bytes]:
    """The distinct k-word shingles themselves."""
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def size_class(n: int) -> int:
    return n.bit_length() - 1


class Sketches:
    """All items' sketches by size partition, and their texts for the verification."""

    def __init__(self, items: list[tuple[int, str]], k: int, sketch: int = SKETCH):
        self.k, self.items = k, [(i, t) for i, t in items if t is not None and t.split()]
        sets = [np.unique(s) for s in text_shingles(pa.array([t for _, t in self.items], pa.string()), k)]
        classes: dict[int, list[tuple[np.ndarray, int]]] = {}
        for at, s in enumerate(sets):
            if len(s):
                classes.setdefault(size_class(len(s)), []).append((s[:sketch], at))
        self.partitions = []
        for _, members in sorted(classes.items()):
            hashes = np.concatenate([s for s, _ in members])
            owner = np.repeat([at for _, at in members], [len(s) for s, _ in members])
            order = np.argsort(hashes, kind="stable")
            self.partitions.append((hashes[order[-1]], hashes[order], owner[order]))

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Items of which one sketch hash at least is among ``hashes``."""
        found = []
        for cut, known, owner in self.partitions:
            below = hashes[hashes <= cut]
            low = np.searchsorted(known, below)
            hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == below)
            for value in np.unique(below[hit]):
                found.append(owner[np.searchsorted(known, value):np.searchsorted(known, value, "right")])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _verified(doc: str, items: list[tuple[int, str]], k: int, percent: int) -> list[tuple[int, int, int]]:
    own, out = word_shingles(doc, k), []
    for item_id, text in items:
        want = word_shingles(text, k)
        n = len(want & own)
        if want and 100 * n >= percent * len(want):
            out.append((item_id, len(want), n))
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "item_id", "n_item", "n_shared"])


def _scan(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker_state()
        sketches = Sketches(*shared.value)
        for part in slices(batches):
            rows = []
            for i, hashes in enumerate(text_shingles(part.column("text"), sketches.k)):
                found = sketches.candidates(hashes)
                if len(found):
                    doc_id = part.column("doc_id")[i].as_py()
                    rows += [(doc_id, *v) for v in _verified(part.column("text")[i].as_py(), [sketches.items[c] for c in found], sketches.k, percent)]
            yield _rows(rows)
    return run


def _sketch_rows(k: int, id_column: str, sketch: int | None, cuts=None):
    """(id, size class, hash) of the sketch of each item, or of each document's shingles below a class's cut-off."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, classes, hashes = [], [], []
            for i, s in zip(part.column(id_column).to_pylist(), text_shingles(part.column("text"), k)):
                s = np.unique(s)
                for c, kept in ([(size_class(len(s)), s[:sketch])] if sketch else [(c, s[s <= np.uint64(cut)]) for c, cut in cuts]) if len(s) else []:
                    ids += [i] * len(kept)
                    classes += [c] * len(kept)
                    hashes.append(kept.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.int32()),
                                              pa.array(np.concatenate(hashes) if hashes else [], pa.int64())], [id_column, "class", "hash"])
    return run


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield _rows([(d, *v) for d, t, i, x in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item")))
                         for v in _verified(t, [(i, x)], k, percent)])
    return run


def _containing(k: int, percent: int):
    """The ids and texts' hashes of the documents that contain their item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            good = [bool(_verified(t, [(i, x)], k, percent)) for t, i, x in zip(*(part.column(c).to_pylist() for c in ("text", "item_id", "item")))]
            yield part.select(["doc_id", "hash"]).filter(pa.array(good, pa.bool_()))
    return run


def _with_id(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("long").alias(column), "text")


def _joined(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(doc_id, text, item_id, item) of the candidates when the items are too many for a broadcast."""
    sketches = items.mapInArrow(_sketch_rows(k, "item_id", SKETCH), "item_id long, class int, hash long")
    # one row for each size class, 64 at most; hashes compare as unsigned numbers
    unsigned = F.max(F.conv(F.hex("hash"), 16, 10).cast("decimal(20,0)"))
    cuts = [(r["class"], int(r["cut"])) for r in sketches.groupBy("class").agg(unsigned.alias("cut")).collect()]
    seen = docs.mapInArrow(_sketch_rows(k, "doc_id", None, cuts), "doc_id long, class int, hash long")
    pairs = seen.join(sketches, ["class", "hash"]).select(F.col("doc_id").alias("d"), F.col("item_id").alias("i")).distinct()
    full = pairs.join(docs, F.col("d").eqNullSafe(F.col("doc_id")))
    full = full.join(items.withColumnRenamed("text", "item"), F.col("i").eqNullSafe(F.col("item_id")))
    return full.select("doc_id", "text", "item_id", "item")


def _drop(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker_state()
        sketches = Sketches(*shared.value)
        for part in slices(batches):
            clean = []
            for i, hashes in enumerate(text_shingles(part.column("text"), sketches.k)):
                found = [sketches.items[c] for c in sketches.candidates(hashes)]
                clean.append(not found or not _verified(part.column("text")[i].as_py(), found, sketches.k, percent))
            yield part.filter(pa.array(clean, pa.bool_()))
    return run


def _items(items: DataFrame, k: int, max_broadcast: int):
    """(items, the same as a broadcast or, if they are too many, None)."""
    items = _with_id(items.where("text is not null"), "item_id").distinct()
    words = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    if words > max_broadcast:
        return items, None
    rows = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return items, items.sparkSession.sparkContext.broadcast((rows, k))


def contained_items(docs: DataFrame, items: DataFrame, *, k: int = 5, percent: int = 80,
                    max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): each item that a document contains."""
    docs = _with_id(docs, "doc_id")
    items, shared = _items(items, k, max_broadcast)
    found = docs.mapInArrow(_scan(shared, percent), OUT) if shared else _joined(docs, items, k).mapInArrow(_verify(k, percent), OUT)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def uncontaminated(docs: DataFrame, items: DataFrame, *, k: int = 5, percent: int = 80,
                   max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The documents, with all their columns, that contain no item."""
    items, shared = _items(items, k, max_broadcast)
    if shared:
        return docs.mapInArrow(_drop(shared, percent), docs.schema)
    met = _joined(_with_id(docs, "doc_id"), items, k).withColumn("hash", F.sha2("text", 256)).select("doc_id", "hash", "text", "item_id", "item")
    found = met.mapInArrow(_containing(k, percent), "doc_id long, hash string").select(F.col("doc_id").alias("_found"), F.col("hash").alias("_hash")).distinct()
    # by id and text: rows that share an id, or have none, are judged by their own text
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_found")) & (F.sha2(F.col("text"), 256) == F.col("_hash")), "left_anti")
