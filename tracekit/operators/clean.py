"""Row cleaning of laps and samples (CL1-CL8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tracekit.functions import scalars as S
from tracekit.schemas import (LAP_TABLE_COLUMNS, LAP_TIME_COLUMNS, NUMERIC_SAMPLE_COLUMNS,
                              SAMPLE_KEYS, present, require)


def derive_distance(samples: DataFrame, *, keys: Sequence[str] = SAMPLE_KEYS,
                    time_col: str = "TimeSeconds", order: Sequence[str] = ("sample_id",),
                    bucket_s: float = 60.0) -> DataFrame:
    """CL1: Distance = running sum of Speed/3.6 * dt per lap, dt from the previous sample in
    time order (the first sample of a lap sits at 0). Only applied when Distance is absent.

    Two-level prefix sum so one long lap is not a single task: running sums inside
    (lap, time bucket) windows, then a per-lap window over the bucket summaries adds the
    step across each bucket boundary and the totals of earlier buckets.
    """
    if "Distance" in samples.columns:
        return samples
    require(samples, [*keys, "Speed", time_col], "derive_distance")
    tie = [c for c in order if c in samples.columns]
    t, v = F.col(time_col), S.coerce_number(F.col("Speed"))
    s = samples.withColumn("_b", F.floor(t / F.lit(float(bucket_s))))
    wb = Window.partitionBy(*keys, "_b").orderBy(time_col, *tie)
    step = F.coalesce(v / 3.6 * (t - F.lag(time_col).over(wb)), F.lit(0.0))
    s = s.withColumn("_step", step).withColumn(
        "_local", F.sum("_step").over(wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.struct(t, *[F.col(c) for c in tie])
    summ = s.groupBy(*keys, "_b").agg(
        F.min(time_col).alias("_t0"), F.max(time_col).alias("_t1"), F.sum("_step").alias("_inner"),
        F.min_by(v, first).alias("_v0"))
    wl = Window.partitionBy(*keys).orderBy("_b")
    cross = F.coalesce(F.col("_v0") / 3.6 * (F.col("_t0") - F.lag("_t1").over(wl)), F.lit(0.0))
    summ = summ.withColumn("_cross", cross).withColumn(
        "_offset", F.coalesce(F.sum(F.col("_inner") + F.col("_cross")).over(
            wl.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col("_cross"))
    out = s.join(summ.select(*keys, "_b", "_offset"), [*keys, "_b"])
    return out.withColumn("Distance", F.col("_offset") + F.col("_local")).drop(
        "_b", "_step", "_local", "_offset")


def coerce_channels(samples: DataFrame) -> DataFrame:
    """SC3 over every numeric channel present."""
    cols = set(present(samples, NUMERIC_SAMPLE_COLUMNS))
    return samples.select(*[S.coerce_number(F.col(c)).alias(c) if c in cols else F.col(c)
                            for c in samples.columns])


def binary_channels(samples: DataFrame) -> DataFrame:
    """SC4 / SC5: Brake -> 0/1, DRSActive from the DRS code."""
    new = {}
    if "Brake" in samples.columns:
        new["Brake"] = S.binary_flag(F.col("Brake"))
    if "DRS" in samples.columns:
        new["DRSActive"] = S.drs_active(F.col("DRS"))
    return samples.withColumns(new) if new else samples


def dedupe_samples(samples: DataFrame, *, keys: Sequence[str] = SAMPLE_KEYS,
                   axis: str = "Distance", order: Sequence[str] = ("TimeSeconds", "sample_id")) -> DataFrame:
    """CL2: drop NULL axis values, keep the first sample per (lap, axis value).

    "First" = earliest TimeSeconds (NULLs last), then lowest sample_id. The window is
    partitioned by (lap keys, axis value), so one long lap still spreads over all tasks.
    """
    tie = [F.col(c).asc_nulls_last() for c in order if c in samples.columns]
    w = Window.partitionBy(*keys, axis).orderBy(*tie) if tie else Window.partitionBy(*keys, axis).orderBy(axis)
    cols = samples.columns
    return (samples.filter(F.col(axis).isNotNull())
            .select(*cols, F.row_number().over(w).alias("_rn")).filter("_rn = 1").select(*cols))


def prepare_channels(samples: DataFrame, *, keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """CL3 without the dedupe: seconds columns -> distance if absent -> coercion -> binary channels.

    Row-wise only (no shuffle); lap-level min/max of Distance can be taken from here since
    the dedupe never changes them.
    """
    out = S.add_seconds_column(samples, "Time", "TimeSeconds")
    out = S.add_seconds_column(out, "SessionTime", "SessionTimeSeconds")
    if "Speed" in out.columns and "TimeSeconds" in out.columns:
        out = derive_distance(out, keys=keys)
    out = coerce_channels(out)
    return binary_channels(out)


def clean_samples(samples: DataFrame, *, keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """CL3: seconds columns -> distance if absent -> numeric coercion -> binary channels -> dedupe.

    Samples with neither ``Distance`` nor what it is derived from keep all their rows.
    """
    out = prepare_channels(samples, keys=keys)
    return dedupe_samples(out, keys=keys) if "Distance" in out.columns else out


def lap_table(laps: DataFrame, driver: str | None = None) -> DataFrame:
    """CL5: optional driver filter ('' = none), duration columns -> seconds, fixed projection."""
    out = laps
    if driver and "Driver" in out.columns:
        out = out.filter(F.col("Driver") == F.lit(driver))
    for column in LAP_TIME_COLUMNS:
        if column in out.columns:
            out = out.withColumn(f"{column}Seconds", S.seconds_of(out, column))
    keep = [c for c in ("session_id", *LAP_TABLE_COLUMNS) if c in out.columns]
    return out.select(*keep)


def lap_time() -> F.Column:
    """The lap time, NULL where it is missing: NULL or NaN."""
    return S.nan_to_null(F.col("LapTimeSeconds").cast("double"))


def timed_laps(laps: DataFrame) -> DataFrame:
    """CL6: laps with a lap time."""
    return laps.filter(lap_time().isNotNull())


def drivers_without_timed_lap(laps: DataFrame, requested: DataFrame | None = None,
                              keys: Sequence[str] = ("session_id", "Driver")) -> DataFrame:
    """CL6 report: requested (session, driver) rows that have no timed lap (default: all drivers)."""
    req = requested if requested is not None else laps.select(*keys).distinct()
    return req.join(timed_laps(laps).select(*keys), list(keys), "left_anti")


def valid_timed_laps(laps: DataFrame) -> DataFrame:
    """CL7: lap time present and positive."""
    return laps.filter(lap_time() > 0)


def complete_cases(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """CL8: rows with every present feature column non-null."""
    cols = present(df, features)
    return df.dropna(subset=cols) if cols else df  # dropna also drops NaN
