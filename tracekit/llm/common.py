"""Helpers shared by the training-data operators: reading, settling, words and shingles.

Words are maximal runs without ASCII white space (space, tab to carriage return). A batch of
texts is split and dictionary-encoded by Arrow, so that everything paid per *distinct* word
(hashing, tokenising, scoring) is paid once a batch, and per-occurrence work stays in NumPy.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracekit.session import ensure_checkpoint_dir, shared_dir

SLICE_BYTES = 8 << 20  # text handled at once inside a Python task
FOLD = 1 << 14         # shingles hashed at once


def ship(name: str) -> None:
    """Send the module's functions to the workers by value: executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def worker_state(key: str, make: Callable[[], object]) -> object:
    """One object for each Python worker process, kept across its tasks."""
    store = sys.modules.setdefault("_tracekit_worker_state", types.ModuleType("_tracekit_worker_state"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


def forget_worker_state(keep: str | None = None) -> None:
    """Free what tasks of an earlier operator have left in this worker process, and give its unused memory back to the system.

    Where the state named ``keep`` is there, the worker already runs the same operator and nothing is done.
    """
    if keep is not None and hasattr(sys.modules.get("_tracekit_worker_state"), keep):
        return
    sys.modules.pop("_tracekit_worker_state", None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc keeps what Python frees
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    They go when the driver finds the plans that made them unreachable, which a long job otherwise leaves to chance.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that this library has written and no longer reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that a slice holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size + 64, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def words_of(texts: pa.Array, *, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct words): text i has the words ``distinct[codes[offsets[i]:offsets[i+1]]]``.

    A null or blank text has none. ``lower`` maps A-Z only.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(None, texts.type), texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    coded = lists.flatten().dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's UTF-8 bytes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()),
                       np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fold(words: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of each run of k consecutive word hashes."""
    out = np.empty(len(words) - k + 1, np.uint64)
    for low in range(0, len(out), FOLD):  # blocks that stay in the processor's cache
        n = min(FOLD, len(out) - low)
        acc = mix(words[low:low + n] + np.uint64(k))
        for j in range(1, k):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[low + j:low + j + n])
        out[low:low + n] = acc
    return out


def shingles(offsets: np.ndarray, words: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's shingle hashes in order; a text of fewer than k words has its whole sequence as one."""
    acc = _fold(words, k) if len(words) >= k else np.empty(0, np.uint64)
    bounds = offsets.tolist()
    return [acc[a:b - k + 1] if b - a >= k else _fold(words[a:b], b - a) if b > a else acc[:0]
            for a, b in zip(bounds[:-1], bounds[1:])]


def text_shingles(texts: pa.Array, k: int, *, lower: bool = True) -> list[np.ndarray]:
    offsets, codes, distinct = words_of(texts, lower=lower)
    hashed = hash_words(distinct)
    return shingles(offsets, hashed[codes] if len(codes) else np.empty(0, np.uint64), k)


def count_words(text) -> F.Column:
    """Number of words of a text column (null: 0), JVM side."""
    return F.coalesce(F.expr(r"regexp_count({}, '[^\\x20\\x09-\\x0D]+')".format(text)), F.lit(0)).cast("long")
