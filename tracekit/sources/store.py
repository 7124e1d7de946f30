"""Prepared dataset store and session bookkeeping (IO1-IO15).

A prepared dataset is a folder of session tables (``sources/snapshots.py``: hashed buckets, one snapshot for all tables):

    laps        lap table (LAPS schema)
    corners     corners of each session's circuit
    samples     cleaned samples of the selected laps
    segments    their segment index (operators/segments.py), which comparisons read
    lap_index   one row per selected lap, in request order (replaces the JSON lap list)
    sessions    dataset_version, generated_at, request, frequency_hz

Saving sessions replaces all that the tables held of them and leaves the others untouched. Readers take a root folder
(its newest snapshot) or a ``Snapshot``, so that several reads see one state.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from tracekit.functions import scalars as S
from tracekit.operators.segments import segment_index
from tracekit.schemas import CORNERS, DATASET_VERSION, LAP_INDEX, LAPS, MANIFEST
from tracekit.session import materialize
from tracekit.sources import snapshots
from tracekit.sources.snapshots import Snapshot

# --- fixed values: fallback event names when a season has no schedule (in this order) ---
COMMON_GRAND_PRIX_NAMES = (
    "Australian Grand Prix", "Bahrain Grand Prix", "Saudi Arabian Grand Prix", "Chinese Grand Prix",
    "Miami Grand Prix", "Emilia Romagna Grand Prix", "Monaco Grand Prix", "Spanish Grand Prix",
    "Canadian Grand Prix", "Austrian Grand Prix", "British Grand Prix", "Hungarian Grand Prix",
    "Belgian Grand Prix", "Dutch Grand Prix", "Italian Grand Prix", "Azerbaijan Grand Prix",
    "Singapore Grand Prix", "Japanese Grand Prix", "Qatar Grand Prix", "United States Grand Prix",
    "Mexico City Grand Prix", "Sao Paulo Grand Prix", "Las Vegas Grand Prix", "Abu Dhabi Grand Prix",
    "Portuguese Grand Prix", "French Grand Prix", "German Grand Prix", "Turkish Grand Prix",
    "Tuscan Grand Prix", "Eifel Grand Prix", "Styrian Grand Prix", "Sakhir Grand Prix",
    "70th Anniversary Grand Prix",
)
DATA_SOURCES = ("prepared", "live", "demo")
# --- end of fixed values ---

TRACK_CHUNK = 10_000  # circuit-wide corners that travel to a session in one row


def _corners_by_session(corners: DataFrame, lap_index: DataFrame) -> DataFrame:
    """Corners keyed by session; circuit-wide ones are stored with each prepared session, gathered in rows of bounded size."""
    if "session_id" not in corners.columns:
        n = max(1, -(-corners.count() // TRACK_CHUNK))
        chunk = F.pmod(F.xxhash64(*corners.columns), F.lit(n)).cast("int").alias("_chunk")
        track = corners.groupBy(chunk).agg(F.collect_list(F.struct(*corners.columns)).alias("_c"))
        sessions = lap_index.select("session_id").distinct().withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        corners = sessions.join(track, "_chunk").select("session_id", F.explode("_c").alias("_c")).select("session_id", "_c.*")
    have = set(corners.columns)
    return corners.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CORNERS.fields])


def save_lap_index(root: str, lap_index: DataFrame) -> str:
    """The lap index alone, which is all that driver look-ups and sector tables read."""
    index = materialize(lap_index.select(*[f.name for f in LAP_INDEX.fields]))
    snapshots.save(index.sparkSession, root, {"lap_index": (index, ("position",))}, index)
    return root


def save_corners(root: str, corners: DataFrame) -> str:
    """Corners keyed by session, alone."""
    kept = materialize(_corners_by_session(corners, corners))
    snapshots.save(kept.sparkSession, root, {"corners": (kept, ("Number", "Letter"))}, kept)
    return root


def save_prepared(root: str, *, laps: DataFrame, samples: DataFrame, lap_index: DataFrame,
                  corners: DataFrame | None = None, sessions: DataFrame | None = None,
                  frequency_hz: int = 10, segments: bool = False) -> str:
    """IO5: save a prepared dataset of every session that the laps, the lap index or ``sessions`` name.

    All tables change at once, and hold nothing older of these sessions. ``samples`` are cleaned samples; only those of
    laps in ``lap_index`` are kept, with ``segments`` also their segment index. ``sessions`` optionally carries (session_id, year, grand_prix, session_type).
    """
    spark = laps.sparkSession
    lap_index = materialize(lap_index.select(*[f.name for f in LAP_INDEX.fields]))  # four tables are written from it
    named = [laps.select("session_id"), lap_index.select("session_id")]
    if sessions is None:
        sessions = lap_index.select("session_id").distinct().select(
            "session_id", F.lit(None).cast("int").alias("year"),
            F.lit(None).cast("string").alias("grand_prix"), F.lit(None).cast("string").alias("session_type"))
    else:
        named.append(sessions.select("session_id"))
    named = materialize(reduce(DataFrame.unionByName, named).distinct())
    meta = sessions.select(
        "session_id", F.lit(DATASET_VERSION).alias("dataset_version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("generated_at"),
        "year", "grand_prix", "session_type", F.lit(int(frequency_hz)).alias("frequency_hz"))
    keys = ["session_id", "driver", "lap_number"]
    picked = samples.join(lap_index.select(*keys), keys, "left_semi")
    tables = {"samples": (picked, ("driver", "lap_number", "Distance")), "laps": (laps, ("Driver", "LapNumber")),
              "lap_index": (lap_index, ("position",)), "sessions": (meta, ())}
    if segments:
        tables["segments"] = (segment_index(picked), ("driver", "lap_number", "x0"))
    if corners is not None:
        tables["corners"] = (_corners_by_session(corners, lap_index), ("Number", "Letter"))
    snapshots.save(spark, root, tables, named)
    return root


def _snapshot(spark: SparkSession, root: str | Snapshot) -> Snapshot:
    return root if isinstance(root, Snapshot) else snapshots.latest(spark, root)


def _version_gate(message) -> F.Column:
    """Predicate that is true for supported rows and fails the job otherwise (a filter, so
    column pruning cannot drop it)."""
    return F.when(F.col("dataset_version") == DATASET_VERSION, F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean"))


def read_laps(spark: SparkSession, root: str | Snapshot, sessions: Sequence[str] | None = None) -> DataFrame:
    """IO1: lap table of all or the given sessions (only their buckets are opened)."""
    return snapshots.read(spark, _snapshot(spark, root), "laps", LAPS, sessions)


def read_corners(spark: SparkSession, root: str | Snapshot, sessions: Sequence[str] | None = None) -> DataFrame:
    """IO2: corners, or an empty table when none were saved; the CORNERS schema either way."""
    return snapshots.read(spark, _snapshot(spark, root), "corners", CORNERS, sessions)


def read_lap_index(spark: SparkSession, root: str | Snapshot, sessions: Sequence[str] | None = None) -> DataFrame:
    """Selected laps of the prepared sessions, with their request position."""
    return snapshots.read(spark, _snapshot(spark, root), "lap_index", LAP_INDEX, sessions)


def read_sessions(spark: SparkSession, root: str | Snapshot) -> DataFrame:
    """Session metadata rows; rows with an unsupported dataset version fail the job (IO4)."""
    df = snapshots.read(spark, _snapshot(spark, root), "sessions")
    return df.filter(_version_gate(F.concat(F.lit("Unsupported prepared dataset version for session "),
                                            F.col("session_id"))))


def read_lap_samples(spark: SparkSession, root: str | Snapshot, lap_index: DataFrame | None = None,
                     sessions: Sequence[str] | None = None) -> DataFrame:
    """IO3: stored samples of the selected laps, of all sessions or (opening their buckets only) of the given ones.

    What a snapshot holds are the samples of its own lap index; only another index needs a semi-join on the lap keys.
    """
    stored = snapshots.read(spark, _snapshot(spark, root), "samples", None, sessions)
    if lap_index is None:
        return stored
    keys = ["session_id", "driver", "lap_number"]
    return stored.join(lap_index.select(*keys), keys, "left_semi")


def read_segments(spark: SparkSession, root: str | Snapshot, sessions: Sequence[str] | None = None) -> DataFrame:
    """The stored segment index of the selected laps, of all or the given sessions."""
    return snapshots.read(spark, _snapshot(spark, root), "segments", None, sessions)


def lap_index_from_manifests(spark: SparkSession, path: str) -> DataFrame:
    """IO4: read JSON manifests (one multi-line document per file) into lap index rows.

    A manifest whose dataset_version differs from the supported one fails the job.
    """
    m = spark.read.option("multiLine", True).schema(MANIFEST).json(path)
    m = m.filter(_version_gate(F.lit("Unsupported processed telemetry dataset")))
    sid = S.session_key(F.col("request.year"), F.col("request.grand_prix"), F.col("request.session_type"))
    x = m.select(sid.alias("session_id"), "dataset_version", F.posexplode("laps").alias("pos", "lap"))
    return x.select(
        "session_id", (F.col("pos") + 1).cast("int").alias("position"),
        F.col("lap.driver").alias("driver"), F.col("lap.lap_number").cast("int").alias("lap_number"),
        F.col("lap.lap_time_seconds").alias("lap_time_seconds"), F.col("lap.team").alias("team"),
        F.col("lap.compound").alias("compound"), F.col("lap.stint").cast("int").alias("stint"),
        F.col("lap.sector1").alias("sector1"), F.col("lap.sector2").alias("sector2"),
        F.col("lap.sector3").alias("sector3"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, status, drivers array<string>) of JSON manifests, one document in a folder for each session.

    The folder's name is the session. ``status`` is ok, unsupported (another dataset version, or none) or unreadable
    (not JSON); drivers are null unless it is ok. No manifest fails the job. An empty file has no row.
    """
    known = T.StructType([T.StructField("dataset_version", T.DoubleType()),
                          T.StructField("laps", T.ArrayType(T.StructType([T.StructField("driver", T.StringType())]))),
                          T.StructField("_corrupt", T.StringType())])
    raw = (spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(known)
           .json(path).select("*", F.col("_metadata.file_path").alias("_file")))
    session = F.url_decode(F.regexp_extract("_file", r"([^/=]+)/[^/]+$", 1))
    status = (F.when(F.col("_corrupt").isNotNull(), "unreadable")
              .when(F.coalesce(F.col("dataset_version") == DATASET_VERSION, F.lit(False)), "ok").otherwise("unsupported"))
    rows = raw.select(session.alias("session_id"), status.alias("status"), "laps")
    drivers = F.coalesce(F.col("laps.driver"), F.array().cast("array<string>"))
    return rows.select("session_id", "status", F.when(F.col("status") == "ok", drivers).alias("drivers"))


def manifests_contain(manifests: DataFrame, requests: DataFrame) -> DataFrame:
    """IO9 over JSON manifests: (session_id, contains) for each requested session.

    False where the manifest is missing, unreadable or unsupported, or lacks a requested driver; a session requested with no
    driver (null Driver) only needs a good manifest.
    """
    good = manifests.where("status = 'ok'").select("session_id", "drivers")
    have = good.select("session_id", F.explode_outer("drivers").alias("driver")).distinct()
    asked = requests.select("session_id", "Driver").distinct()
    wanted = asked.where("Driver is not null")
    on = (wanted.session_id == have.session_id) & (wanted.Driver == have.driver)
    lacking = wanted.join(have, on, "left_anti").select("session_id").distinct()
    ok = good.select("session_id").distinct().join(lacking, "session_id", "left_anti").withColumn("_ok", F.lit(True))
    return asked.select("session_id").distinct().join(ok, "session_id", "left").select("session_id", F.coalesce("_ok", F.lit(False)).alias("contains"))


def lap_index_from_selection(meta: DataFrame, sectors: DataFrame) -> DataFrame:
    """Lap index rows from selected-lap metadata and their sector table."""
    sec = sectors.select("session_id", F.col("Driver").alias("driver"), F.col("Lap").alias("lap_number"),
                         F.col("Sector1").alias("sector1"), F.col("Sector2").alias("sector2"),
                         F.col("Sector3").alias("sector3"))
    j = meta.join(sec, ["session_id", "driver", "lap_number"], "left")
    return j.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LAP_INDEX.fields])


def prepared_drivers(lap_index: DataFrame) -> DataFrame:
    """IO8: drivers of each prepared session in stored order."""
    return lap_index.select("session_id", "position", "driver")


def missing_drivers(lap_index: DataFrame, requests: DataFrame) -> DataFrame:
    """IO10: requested (session_id, Driver) rows the prepared dataset does not hold."""
    have = lap_index.select("session_id", F.col("driver").alias("Driver"))
    return requests.select("session_id", "Driver").join(have, ["session_id", "Driver"], "left_anti")


def contains_drivers(lap_index: DataFrame, requests: DataFrame) -> DataFrame:
    """IO9: per requested session, does the prepared dataset hold every requested driver?

    A session without a prepared dataset is False; a session requested with no driver
    (NULL Driver) only needs to exist.
    """
    sessions = lap_index.select("session_id").distinct().withColumn("_present", F.lit(True))
    miss = (missing_drivers(lap_index, requests.filter(F.col("Driver").isNotNull()))
            .groupBy("session_id").agg(F.count(F.lit(1)).alias("_missing")))
    req = requests.select("session_id").distinct()
    return (req.join(sessions, "session_id", "left").join(miss, "session_id", "left")
            .select("session_id", (F.coalesce(F.col("_present"), F.lit(False))
                                   & (F.coalesce(F.col("_missing"), F.lit(0)) == 0)).alias("contains")))


def validate_sessions(requested: DataFrame, laps: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """IO12: per requested session_id: lap_count, sample_count, is_valid, reason."""
    lc = laps.groupBy("session_id").agg(F.count(F.lit(1)).alias("lap_count"))
    out = requested.select("session_id").distinct().join(lc, "session_id", "left")
    if samples is not None:
        sc = samples.groupBy("session_id").agg(F.count(F.lit(1)).alias("sample_count"))
        out = out.join(sc, "session_id", "left")
    else:
        out = out.withColumn("sample_count", F.lit(None).cast("bigint"))
    lap_n = F.coalesce(F.col("lap_count"), F.lit(0))
    smp_n = F.coalesce(F.col("sample_count"), F.lit(0))
    reason = (F.when(lap_n == 0, F.lit("no laps"))
              .when(F.lit(samples is not None) & (smp_n == 0), F.lit("no telemetry")))
    return out.select("session_id", lap_n.alias("lap_count"), smp_n.alias("sample_count"),
                      reason.isNull().alias("is_valid"), reason.alias("reason"))


def session_summary(laps: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """IO13: per session driver_count, lap_count and event facts with defaults.

    ``events`` (session_id, event_name, session_name, date, circuit_name) is optional;
    missing facts default to the session id / 'unknown'.
    """
    agg = laps.groupBy("session_id").agg(F.countDistinct("Driver").cast("int").alias("driver_count"),
                                         F.count(F.lit(1)).cast("int").alias("lap_count"))
    if events is None:
        out = agg.select("*", *[F.lit(None).cast("string").alias(c)
                                for c in ("event_name", "session_name", "date", "circuit_name")])
    else:
        out = agg.join(events, "session_id", "left")
    return out.select(
        "session_id", F.coalesce("event_name", "session_id").alias("event_name"),
        F.coalesce("session_name", "session_id").alias("session_name"),
        F.coalesce("date", F.lit("unknown")).alias("date"),
        F.coalesce("circuit_name", F.lit("unknown")).alias("circuit_name"),
        "driver_count", "lap_count")


def season_events(schedule: DataFrame, seasons: DataFrame) -> DataFrame:
    """IO14: (year, position, event_name): a season's non-blank event names in round order,
    or the static fallback list when it has none. ``schedule``: (year, round, event_name)."""
    named = schedule.filter(F.col("event_name").isNotNull() & (F.trim("event_name") != ""))
    w = Window.partitionBy("year").orderBy("round")
    have = named.withColumn("position", F.row_number().over(w).cast("int"))
    missing = seasons.select("year").distinct().join(named.select("year").distinct(), "year", "left_anti")
    names = F.array(*[F.lit(n) for n in COMMON_GRAND_PRIX_NAMES])
    fallback = missing.select("year", F.posexplode(names).alias("_i", "event_name")).select(
        "year", (F.col("_i") + 1).cast("int").alias("position"), "event_name")
    return have.select("year", "position", "event_name").unionByName(fallback)


def resolve_source(requests: DataFrame, prepared_index: DataFrame, live_laps: DataFrame) -> DataFrame:
    """IO15: per requested session pick the data source in order prepared -> live -> demo:
    prepared only if it holds every requested driver, live if the session has laps."""
    prepared = contains_drivers(prepared_index, requests).filter("contains").select(
        "session_id", F.lit(1).alias("_p"), F.lit(DATA_SOURCES[0]).alias("data_source"))
    live = live_laps.select("session_id").distinct().select(
        "session_id", F.lit(2).alias("_p"), F.lit(DATA_SOURCES[1]).alias("data_source"))
    demo = requests.select("session_id").distinct().select(
        "session_id", F.lit(3).alias("_p"), F.lit(DATA_SOURCES[2]).alias("data_source"))
    cand = prepared.unionByName(live).unionByName(demo).join(
        requests.select("session_id").distinct(), "session_id", "left_semi")
    return (cand.groupBy("session_id").agg(F.min_by("data_source", "_p").alias("data_source")))


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Read a session-partitioned table keeping session_id a string (no type inference)."""
    inferred = spark.read.parquet(path).schema
    fixed = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "session_id" else f
                          for f in inferred.fields])
    return spark.read.schema(fixed).parquet(path)


def export_csv(df: DataFrame, path: str) -> str:
    """IO6 / IO7: CSV with a header row (one folder of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
