"""Embedding whitening: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

Method
* Each component c becomes the integer x = floor(256 c). The fit list is each distinct vector once; its sums are exact.
* Centred rows (n x - S) / n are folded into a triangle R block by block in every task, the tasks' triangles in about the
  square root of their number of tasks, and those in one: only rows of triangles are shuffled. R^T R is n times the covariance.
* ``bidiagonal.py`` finds the greatest singular values of R and their right vectors, the whitening directions.
* Every row of the table is projected in one pass without a shuffle; a pass over the fit list gives the covariance that
  the whitened vectors have.

Defined results: vectors that are null or hold a null, NaN or infinite entry are dropped; vectors of each length are fitted for
themselves (n, components and error are their own); repeated rows and null ids stay; a direction without variance (of less
variance than rounding leaves) is no component; empty vectors have none; a deviation beyond a long is null; an empty table gives
an empty result. A direction's sign is that its largest entry is positive. Memory: a task holds one triangle of each vector length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracekit.llm import bidiagonal
from tracekit.llm.common import drop, scratch, ship

ship(__name__)

ROWS = 1024          # rows folded at once, at least
PACK = 1 << 22       # numbers of the models that go out to the tasks together
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, x): each entry c as floor(scale * c); rows with unusable vectors left out."""
    v = F.col("embedding")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return vectors.where(v.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(v).alias("dim"), x.alias("x"))


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) for each length of the batch's vectors, some rows at a time."""
    lists, dims = batch.column(column), batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        step = max(1, (1 << 22) // max(1, dim))
        for i in range(0, len(rows), step):
            part = rows[i:i + step]
            yield dim, part, pc.list_flatten(lists.take(pa.array(part))).to_numpy(zero_copy_only=False).reshape(len(part), dim)


def deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S exactly, as int64 where that holds it and else as Python's integers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, s), default=0)
    if most < 2**62:
        return x * np.int64(n) - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for dim, part, x in _by_length(batch, "x"):
            own = total.setdefault(dim, [0, [0] * dim])
            most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * len(x)
            own[0] += len(part)
            own[1] = [a + int(b) for a, b in zip(own[1], (x if most < 2**62 else x.astype(object)).sum(axis=0))]
    for dim, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int64()),
                                          pa.array([list(map(Decimal, s))], pa.list_(pa.decimal128(38, 0)))], ["dim", "n", "s"])


def _folded(centred: Callable[[int, np.ndarray], np.ndarray], column: str):
    """Folds rows into one triangle for each length, and returns the triangles' rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for dim, _, x in _by_length(batch, column):
                own = held.setdefault(dim, [])
                own.append(centred(dim, x))
                if sum(map(len, own)) >= max(ROWS, 3 * dim):
                    held[dim] = [np.linalg.qr(np.vstack(own), mode="r")]
        for dim, own in held.items():
            r = np.linalg.qr(np.vstack(own), mode="r")
            for i in range(0, len(r), 256):
                flat = pa.array(r[i:i + 256].ravel())
                rows = len(r[i:i + 256])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, dim, np.int32)), pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * dim, flat)], ["dim", "y"])
    return run


def _solved(k: int):
    """A row for each length, whose triangles' rows are all in the task: the leading squared singular values and directions."""
    fold = _folded(lambda dim, y: y, "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangles: dict[int, list[np.ndarray]] = {}
        for batch in fold(batches):
            for dim, _, y in _by_length(batch, "y"):
                triangles.setdefault(dim, []).append(y)
        for dim, parts in triangles.items():
            r = np.vstack(parts)
            values, found = bidiagonal.leading(r, min(k, dim))
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([values.tolist()]), pa.array([found.tolist()], pa.list_(pa.list_(pa.float64()))), pa.array([float((r * r).sum())])],
                                             ["dim", "values", "directions", "total"])
    return run


def _whitened(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = deviations(x, model["n"], model["s"])
    return y, (y.astype(np.float64) / model["n"]) @ model["directions"].T / np.sqrt(model["values"] / model["n"])


def _second_moments(models: dict[int, dict]):
    """(dim, at, value): sums of the whitened vectors and of their products, flat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_length(batch, "x"):
                _, w = _whitened(models[dim], x)
                total[dim] = total.get(dim, 0) + np.vstack([w.sum(axis=0), w.T @ w]).ravel()
        for dim, flat in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), dim, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["dim", "at", "value"])
    return run


def _projected(models: dict[int, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for dim, part, x in _by_length(batch, "x"):
                m = models[dim]
                k = len(m["values"])
                y, w = _whitened(m, x)
                most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) if y.size else 0
                if most * most * dim < 2**63:
                    far = pa.array((y.astype(np.int64) ** 2).sum(axis=1))
                else:
                    far = pa.array([v if v < 2**63 else None for v in (sum(int(c) * int(c) for c in row) for row in y)], pa.int64())
                rows = np.repeat(np.arange(len(part)), k)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(part[rows])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(rows), m["n"], np.int64)),
                     far.take(pa.array(rows)), pa.array(w.ravel()), pa.array(np.tile(m["explained"], len(part))), pa.array(np.full(len(rows), m["error"]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def _triangles(fit: DataFrame, sums: dict[int, tuple[int, list[int]]], k: int) -> DataFrame:
    def centred(dim: int, x: np.ndarray) -> np.ndarray:
        n, s = sums[dim]
        return deviations(x, n, s).astype(np.float64) / n

    schema, tasks = "dim int, y array<double>", fit.rdd.getNumPartitions()
    rows = fit.mapInArrow(_folded(centred, "x"), schema)
    if tasks > 16:
        bucket = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks)))
        rows = rows.withColumn("bucket", bucket).repartition(math.isqrt(tasks), "dim", "bucket").select("dim", "y").mapInArrow(_folded(lambda dim, y: y, "y"), schema)
    return rows.repartition("dim").mapInArrow(_solved(k), "dim int, values array<double>, directions array<array<double>>, total double")


def fitted(fit: DataFrame, k: int) -> Iterator[dict[int, dict]]:
    """Models by vector length, of at most ``PACK`` numbers together, for distinct vectors (dim, x)."""
    parts = fit.mapInArrow(_sums, "dim int, n long, s array<decimal(38,0)>")
    lengths = parts.groupBy("dim").agg(F.sum("n").alias("n")).where("dim > 0").orderBy("dim")
    sums = parts.select("dim", F.posexplode("s").alias("at", "s")).groupBy("dim", "at").agg(F.sum("s").alias("s"))
    packs: list[dict[int, int]] = []
    room = 0
    for r in lengths.toLocalIterator():
        room -= r.dim * (k + 1)
        if room < 0:
            packs.append({})
            room = PACK - r.dim * (k + 1)
        packs[-1][r.dim] = r.n
    for pack in packs:
        s: dict[int, list[int]] = {dim: [0] * dim for dim in pack}
        for r in sums.where(F.col("dim").isin(*pack)).toLocalIterator():
            s[r.dim][r.at] = int(r.s)
        own = fit.where(F.col("dim").isin(*pack))
        models = {}
        for r in _triangles(own, {dim: (n, s[dim]) for dim, n in pack.items()}, k).collect():
            n, values = pack[r.dim], np.array(r["values"])
            solid = np.sqrt(values) > max(math.sqrt(n), r.dim) * 8 * bidiagonal.EPS * math.sqrt(max(r.total, 1e-300))
            models[r.dim] = {"n": n, "s": s[r.dim], "values": values[solid], "directions": np.array(r.directions)[solid].reshape(-1, r.dim),
                             "explained": values[solid] / r.total if solid.any() else values[solid], "error": 0.0}
        models = {dim: m for dim, m in models.items() if len(m["values"])}
        if not models:
            continue
        own = own.where(F.col("dim").isin(*models))
        flat = {dim: np.zeros((len(m["values"]) + 1) * len(m["values"])) for dim, m in models.items()}
        for r in own.mapInArrow(_second_moments(models), "dim int, at int, value double").groupBy("dim", "at").agg(F.sum("value").alias("value")).toLocalIterator():
            flat[r.dim][r["at"]] = r.value
        for dim, m in models.items():
            mean, products = flat[dim].reshape(-1, len(m["values"]))[0] / m["n"], flat[dim].reshape(-1, len(m["values"]))[1:] / m["n"]
            m["error"] = float(np.abs(products - np.outer(mean, mean) - np.eye(len(mean))).max())
        yield models


def whitened(vectors: DataFrame, *, components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and leading component."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    path = scratch(spark, "whitening")
    rows.select("dim", "x").distinct().write.parquet(path)
    fit = spark.read.schema("dim int, x array<long>").parquet(path)
    out = [rows.where(F.col("dim").isin(*m)).mapInArrow(_projected(m), RESULT) for m in fitted(fit, components)]
    drop(spark, path)
    return reduce(DataFrame.unionByName, out, spark.createDataFrame([], RESULT)) if len(out) != 1 else out[0]
