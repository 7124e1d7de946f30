"""Braking zones: gaps-and-islands over the distance order of each lap (WN1-WN3).

Two-level scan so that one very long lap never sits in a single task:
1. samples are windowed per (lap, distance bucket) -> local runs of equal braking flag,
   folded to one summary row per run (the only pass over raw samples; one exchange);
2. run summaries (few per bucket) are windowed per lap: a run continues the previous
   one when both have the same flag (no sample lies between consecutive runs), so the
   zone id is the running count of flag changes - the same numbering as counting
   changes sample by sample;
3. braking runs are folded into zones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tracekit.schemas import SAMPLE_KEYS, require

BUCKET_M = 100.0


def _braking(c="Brake"):
    return (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0.5).cast("int")


def _local_runs(samples: DataFrame, keys: Sequence[str], bucket_m: float) -> DataFrame:
    tie = ["sample_id"] if "sample_id" in samples.columns else []
    s = samples.withColumn("_braking", _braking()).withColumn(
        "_b", F.floor(F.col("Distance") / F.lit(float(bucket_m))))
    w = Window.partitionBy(*keys, "_b").orderBy("Distance", *tie)
    prev = F.lag("_braking").over(w)
    s = s.withColumn("_chg", F.when(prev.isNull() | (prev != F.col("_braking")), 1).otherwise(0))
    return s.withColumn("_r", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _zone_of_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("_b", "_r")
    prev = F.lag("_braking").over(w)
    chg = F.when(prev.isNull() | (prev != F.col("_braking")), 1).otherwise(0)
    return runs.withColumn("ZoneId", F.sum(chg).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def zone_ids(samples: DataFrame, *, keys: Sequence[str] = SAMPLE_KEYS,
             bucket_m: float = BUCKET_M) -> DataFrame:
    """WN1: per sample, Braking (0/1) and ZoneId = running count of flag changes along Distance."""
    require(samples, [*keys, "Distance", "Brake"], "zone_ids")
    s = _local_runs(samples, keys, bucket_m)
    runs = _zone_of_runs(s.groupBy(*keys, "_b", "_r").agg(F.first("_braking").alias("_braking")), keys)
    out = s.join(runs.select(*keys, "_b", "_r", "ZoneId"), [*keys, "_b", "_r"])
    tie = ["sample_id"] if "sample_id" in samples.columns else []
    return out.select(*keys, *tie, "Distance", F.col("_braking").alias("Braking"), "ZoneId")


def braking_zones(samples: DataFrame, *, minimum_distance_m: float = 20.0,
                  keys: Sequence[str] = SAMPLE_KEYS, bucket_m: float = BUCKET_M) -> DataFrame:
    """WN2/WN3: braking zones of every lap at once.

    Per zone: StartDistance, EndDistance, LengthM, DurationS, EntrySpeed (first sample),
    MinimumSpeed, SpeedDrop, SpeedDropPerMeter; zones shorter than ``minimum_distance_m``
    (strictly) are dropped.
    """
    require(samples, [*keys, "Distance", "Speed", "Brake", "TimeSeconds"], "braking_zones")
    s = _local_runs(samples.select(*keys, "Distance", "Speed", "Brake", "TimeSeconds"), keys, bucket_m)
    x, v, t = F.col("Distance"), F.col("Speed").cast("double"), F.col("TimeSeconds").cast("double")
    runs = s.groupBy(*keys, "_b", "_r").agg(
        F.first("_braking").alias("_braking"), F.min(x).alias("_start"), F.max(x).alias("_end"),
        F.min_by(v, x).alias("_entry"), F.min(v).alias("_vmin"),
        F.min(t).alias("_tmin"), F.max(t).alias("_tmax"))
    z = (_zone_of_runs(runs, keys).filter(F.col("_braking") == 1)
         .groupBy(*keys, "ZoneId").agg(
             F.min("_start").alias("StartDistance"), F.max("_end").alias("EndDistance"),
             F.min_by("_entry", "_start").alias("EntrySpeed"), F.min("_vmin").alias("MinimumSpeed"),
             (F.max("_tmax") - F.min("_tmin")).alias("DurationS")))
    length = F.col("EndDistance") - F.col("StartDistance")
    z = z.withColumn("LengthM", length).filter(F.col("LengthM") >= F.lit(float(minimum_distance_m)))
    drop = F.col("EntrySpeed") - F.col("MinimumSpeed")
    return z.select(
        F.col(keys[0]), F.col(keys[1]).alias("Driver"), F.col(keys[2]).alias("Lap"), "ZoneId",
        "StartDistance", "EndDistance", "LengthM", "DurationS", "EntrySpeed", "MinimumSpeed",
        drop.alias("SpeedDrop"),
        F.when(F.col("LengthM") > 0, F.try_divide(drop, F.col("LengthM"))).alias("SpeedDropPerMeter"))
