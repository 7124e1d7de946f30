"""Comparison insights (AG4-AG8): per-lap speed extremes and full-throttle share, best-lap
gap, final delta, and the capped insight list. Numbers first; text is built last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tracekit.schemas import SAMPLE_KEYS

MAX_INSIGHTS = 8


def speed_extremes(samples: DataFrame, *, keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """AG4: per lap peak and minimum speed."""
    v = F.col("Speed").cast("double")
    return samples.groupBy(*keys).agg(F.max(v).alias("PeakSpeed"), F.min(v).alias("MinimumSpeed"))


def full_throttle_share(samples: DataFrame, *, keys: Sequence[str] = SAMPLE_KEYS,
                        threshold: float = 95.0) -> DataFrame:
    """AG5: percentage of samples with Throttle > threshold (NULL counts as not full)."""
    full = F.when(F.col("Throttle") > threshold, F.lit(1.0)).otherwise(F.lit(0.0))
    return samples.groupBy(*keys).agg((F.avg(full) * 100).alias("FullThrottlePct"))


def lap_stats(samples: DataFrame, *, keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """AG4 + AG5 in one aggregation pass; a missing channel gives NULL columns (and no insight)."""
    aggs = [F.lit(True).alias("_dummy")]
    if "Speed" in samples.columns:
        v = F.col("Speed").cast("double")
        aggs += [F.max(v).alias("PeakSpeed"), F.min(v).alias("MinimumSpeed")]
    if "Throttle" in samples.columns:
        full = F.when(F.col("Throttle") > 95.0, F.lit(1.0)).otherwise(F.lit(0.0))
        aggs.append((F.avg(full) * 100).alias("FullThrottlePct"))
    out = samples.groupBy(*keys).agg(*aggs).drop("_dummy")
    for c in ("PeakSpeed", "MinimumSpeed", "FullThrottlePct"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.withColumn("_has_speed", F.lit("Speed" in samples.columns)).withColumn(
        "_has_throttle", F.lit("Throttle" in samples.columns))


def best_lap_gap(members: DataFrame, *, group_keys: Sequence[str], order: str = "position",
                 driver: str = "driver", lap_time: str = "lap_time_seconds") -> DataFrame:
    """AG6: fastest vs slowest timed lap of each comparison (first in request order wins ties);
    only when they belong to different drivers."""
    t = members.filter(F.col(lap_time).isNotNull())
    out = t.groupBy(*group_keys).agg(
        F.min_by(driver, F.struct(F.col(lap_time), F.col(order))).alias("Fastest"),
        F.max_by(driver, F.struct(F.col(lap_time), -F.col(order))).alias("Slowest"),
        (F.max(lap_time) - F.min(lap_time)).alias("GapSeconds"))
    return out.filter(F.col("Fastest") != F.col("Slowest"))


def final_delta(aligned: DataFrame, *, group_keys: Sequence[str], order: str = "grid_index") -> DataFrame:
    """AG7: last non-NULL delta of each aligned pair; > 0 means the comparison lap is behind."""
    d = aligned.filter(F.col("DeltaSeconds").isNotNull()).groupBy(*group_keys).agg(
        F.max_by("DeltaSeconds", order).alias("FinalDelta"))
    return d.select(*group_keys, "FinalDelta", F.abs("FinalDelta").alias("AbsDelta"),
                    F.when(F.col("FinalDelta") > 0, "behind").otherwise("ahead").alias("Direction"))


def insights(members: DataFrame, stats: DataFrame, delta: DataFrame | None, *,
             group_keys: Sequence[str], lap_keys: Sequence[str] = SAMPLE_KEYS,
             order: str = "position", limit: int = MAX_INSIGHTS) -> DataFrame:
    """AG8: typed insight rows per comparison, cut to the first ``limit``.

    Order: best-lap gap, then per lap (request order) speed extremes and full-throttle share,
    then the final delta. Columns: group keys, Item, Kind, Driver, Other, Value1, Value2.
    """
    G = list(group_keys)
    gap = best_lap_gap(members, group_keys=G, order=order).select(
        *G, F.lit(0).alias("_o"), F.lit(0).alias("_s"), F.lit("best_lap_gap").alias("Kind"),
        F.col("Fastest").alias("Driver"), F.col("Slowest").alias("Other"),
        F.col("GapSeconds").alias("Value1"), F.lit(None).cast("double").alias("Value2"))
    m = members.join(stats, list(lap_keys))
    kinds = F.filter(F.array(
        F.struct((F.col(order) * 2).alias("_s"), F.lit("speed").alias("Kind"),
                 F.col("PeakSpeed").alias("Value1"), F.col("MinimumSpeed").alias("Value2"),
                 F.col("_has_speed").alias("_on")),
        F.struct((F.col(order) * 2 + 1).alias("_s"), F.lit("full_throttle").alias("Kind"),
                 F.col("FullThrottlePct").alias("Value1"), F.lit(None).cast("double").alias("Value2"),
                 F.col("_has_throttle").alias("_on")),
    ), lambda e: e.getField("_on"))
    per_lap = m.select(*G, F.lit(1).alias("_o"), F.explode(kinds).alias("_x"),
                       F.col("driver").alias("Driver")).select(
        *G, "_o", "_x._s", "_x.Kind", "Driver", F.lit(None).cast("string").alias("Other"),
        "_x.Value1", "_x.Value2")
    parts = [gap, per_lap]
    if delta is not None:
        parts.append(delta.select(
            *G, F.lit(2).alias("_o"), F.lit(0).alias("_s"), F.lit("final_delta").alias("Kind"),
            F.lit(None).cast("string").alias("Driver"), F.col("Direction").alias("Other"),
            F.col("AbsDelta").alias("Value1"), F.col("FinalDelta").alias("Value2")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy(*G).orderBy("_o", "_s")
    return (u.withColumn("Item", F.row_number().over(w)).filter(F.col("Item") <= limit)
            .select(*G, "Item", "Kind", "Driver", "Other", "Value1", "Value2"))


def insight_text(ins: DataFrame) -> DataFrame:
    """Render each insight row as the sentence shown to users."""
    k = F.col("Kind")
    text = (F.when(k == "best_lap_gap", F.format_string(
                "%s owns the best selected lap by %.3fs over %s.", "Driver", "Value1", "Other"))
            .when(k == "speed", F.format_string(
                "%s peak speed: %.1f km/h; minimum speed: %.1f km/h.", "Driver", "Value1", "Value2"))
            .when(k == "full_throttle", F.format_string(
                "%s full-throttle distance share: %.1f%%.", "Driver", "Value1"))
            .when(k == "final_delta", F.format_string(
                "Finish-line delta trend: comparison driver is %.3fs %s.", "Value1", "Other")))
    return ins.withColumn("Text", text)
