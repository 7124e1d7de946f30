"""Session tables in hashed buckets, saved as versioned snapshots.

    <root>/<table>/<version>/bucket=<b>/part-*.parquet    data; a folder is never changed once written
    <root>/_snapshots/<number>.json                       which folder holds which bucket of which table

A save writes new folders for the buckets that its sessions fall into (their other sessions' rows are copied) and names
them in one snapshot file, written last. Readers take the snapshot of the highest number, or one given to them, and
read the folders it names: a save that breaks off leaves the snapshot before it as it was, and no reader sees half of one.
A session belongs to the bucket crc32(session_id) mod the number of buckets, so that a reader of some sessions opens their
buckets only. Each bucket of a table is one file, or one for each ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` of it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

BUCKETS = 16
FOLDER = "_snapshots"


class SaveConflict(RuntimeError):
    """Another save has been finished since this one began; its sessions would be lost."""


@dataclass(frozen=True)
class Snapshot:
    """Folders (below ``root``) by table and bucket, and the tables' schemas."""

    root: str
    number: int = 0
    buckets: int = BUCKETS
    folders: dict[str, dict[int, str]] = field(default_factory=dict)
    schemas: dict[str, T.StructType] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"number": self.number, "buckets": self.buckets, "folders": self.folders,
                           "schemas": {t: s.jsonValue() for t, s in self.schemas.items()}})

    @classmethod
    def from_json(cls, root: str, text: str) -> Snapshot:
        x = json.loads(text)
        folders = {t: {int(b): f for b, f in of.items()} for t, of in x["folders"].items()}
        return cls(root, x["number"], x["buckets"], folders, {t: T.StructType.fromJson(s) for t, s in x["schemas"].items()})


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file under a name of its own, then rename it; False if the name is taken."""
    at, fs = _fs(spark, path)
    made, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(made)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.exists(at) and fs.rename(made, at):
        return True
    fs.delete(made, False)
    return False


def latest(spark: SparkSession, root: str) -> Snapshot:
    """The newest snapshot; number 0, without tables, if nothing has been saved."""
    root = root.rstrip("/")
    numbers = [n for n in _names(spark, f"{root}/{FOLDER}") if n.endswith(".json")]
    return Snapshot(root) if not numbers else at_number(spark, root, int(numbers[-1].split(".")[0]))


def at_number(spark: SparkSession, root: str, number: int) -> Snapshot:
    at, fs = _fs(spark, f"{root.rstrip('/')}/{FOLDER}/{number:012d}.json")
    stream = fs.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Snapshot.from_json(root.rstrip("/"), text)


def bucket(buckets: int) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("session_id").cast("binary")), F.lit(buckets)), F.lit(0)).cast("int")


def buckets_of(sessions: Iterable[str], buckets: int) -> set[int]:
    return {zlib.crc32(s.encode()) % buckets for s in sessions}


def read(spark: SparkSession, snapshot: Snapshot, table: str, schema: T.StructType | None = None,
         sessions: Sequence[str] | None = None) -> DataFrame:
    """A table of a snapshot, or the rows of some sessions; empty if the snapshot does not have it."""
    schema = schema or snapshot.schemas.get(table)
    folders = snapshot.folders.get(table, {})
    if sessions is not None:
        folders = {b: folders[b] for b in buckets_of(sessions, snapshot.buckets) & folders.keys()}
    if schema is None:
        raise ValueError(f"{snapshot.root} holds no table {table}")
    if not folders:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(*[f"{snapshot.root}/{f}" for _, f in sorted(folders.items())])
    return df if sessions is None else df.where(F.col("session_id").isin(*sessions))


def _merged(table: str, old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The old columns and the new ones; a column that changes its type is an error."""
    fields = {f.name: f for f in (old.fields if old else [])}
    if "bucket" in new.names:
        raise ValueError(f"{table}: the column name bucket is taken by the store")
    for f in new.fields:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"{table}.{f.name} is {fields[f.name].dataType.simpleString()} and can not become {f.dataType.simpleString()}")
        fields.setdefault(f.name, T.StructField(f.name, f.dataType))
    return T.StructType(list(fields.values()))


def _in_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def save(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, Sequence[str]]], sessions: DataFrame,
         buckets: int = BUCKETS) -> Snapshot:
    """Replace what all tables hold of ``sessions`` (session_id) by the given rows, in one step.

    ``tables``: rows with a session_id, and the columns that order them within a session. What the tables held of
    these sessions goes, also from tables that get no rows of them or are not given. ``buckets`` counts for a new store.
    """
    base = latest(spark, root)
    n = base.buckets if base.number else buckets
    root, version = root.rstrip("/"), f"{base.number + 1:012d}-{uuid.uuid4().hex[:8]}"
    sessions = sessions.select("session_id").distinct()
    touched = sorted(r[0] for r in sessions.select(bucket(n)).distinct().collect())  # n numbers at most
    folders = {t: dict(f) for t, f in base.folders.items()}
    schemas = dict(base.schemas)

    def write(table: str) -> None:
        rows, order = tables.get(table, (None, ()))
        schema = base.schemas.get(table) if rows is None else _merged(table, base.schemas.get(table), rows.schema)
        parts = [] if rows is None else [_in_schema(rows, schema)]
        held = {b: folders[table][b] for b in touched if b in folders.get(table, {})}
        if held:
            old = spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in held.values()])
            gone = sessions.withColumnRenamed("session_id", "_gone")
            parts.append(old.join(gone, old.session_id.eqNullSafe(gone["_gone"]), "left_anti"))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        cols = ["bucket", "session_id", *[c for c in order if c in out.columns]]
        (out.withColumn("bucket", bucket(n)).hint("rebalance", F.col("bucket")).sortWithinPartitions(*cols)
         .write.partitionBy("bucket").parquet(f"{root}/{table}/{version}"))
        wrote = {int(x.partition("=")[2]) for x in _names(spark, f"{root}/{table}/{version}") if x.startswith("bucket=")}
        strange = wrote - set(touched)
        if strange:
            raise ValueError(f"{table} has rows of sessions that are not being saved (buckets {sorted(strange)})")
        folders[table] = {b: f for b, f in folders.get(table, {}).items() if b not in touched} | {b: f"{table}/{version}/bucket={b}" for b in wrote}
        schemas[table] = schema

    due = [t for t in dict.fromkeys([*tables, *base.folders]) if t in tables or any(b in base.folders[t] for b in touched)]
    with ThreadPoolExecutor(max(1, len(due))) as pool:  # the tables' jobs run side by side; the first failure ends the save
        list(pool.map(write, due))
    new = Snapshot(root, base.number + 1, n, folders, schemas)
    if not _put(spark, f"{root}/{FOLDER}/{new.number:012d}.json", new.to_json()):
        raise SaveConflict(f"{root}: snapshot {new.number} was saved meanwhile")
    return new


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete what no snapshot but the newest ``keep`` needs: older snapshots, and folders of saves that broke off or were replaced.

    Not to be run beside a save. Returns the deleted paths.
    """
    root = root.rstrip("/")
    numbers = sorted(int(x.split(".")[0]) for x in _names(spark, f"{root}/{FOLDER}") if x.endswith(".json"))
    kept = [at_number(spark, root, n) for n in numbers[-keep:]]
    used = {"/".join(f.split("/")[:2]) for s in kept for of in s.folders.values() for f in of.values()}
    found = {f"{t}/{v}" for t in _names(spark, root) if t != FOLDER for v in _names(spark, f"{root}/{t}")}
    gone = sorted(found - used) + [f"{FOLDER}/{n:012d}.json" for n in numbers[:-keep]]
    for x in gone:
        at, fs = _fs(spark, f"{root}/{x}")
        fs.delete(at, True)
    return gone
