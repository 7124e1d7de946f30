"""Lap-time aggregates: driver pace / consistency and stint degradation (AG1-AG3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracekit.operators.clean import timed_laps, valid_timed_laps
from tracekit.operators.order import medians, with_position


def consistency(laps: DataFrame) -> DataFrame:
    """AG1 + AG2 per (session_id, Driver) over valid timed laps; NULL drivers dropped.

    Laps, BestLap, MeanLap, MedianLap, StdDev (sample), ConsistencyScore = 100 / (1 + std),
    with a missing std (one lap) counted as 0. The median is exact (``order.medians``: no buffer grows with a driver's laps).
    Sort with ``order_consistency`` at the sink, or number the rows with ``ranked_consistency``.
    """
    t = valid_timed_laps(laps).filter(F.col("Driver").isNotNull())
    lt = F.col("LapTimeSeconds")
    out = t.groupBy("session_id", "Driver").agg(
        F.count(lt).cast("int").alias("Laps"), F.min(lt).alias("BestLap"), F.avg(lt).alias("MeanLap"), F.stddev_samp(lt).alias("StdDev"))
    mid = medians(t, ["session_id", "Driver"], "LapTimeSeconds", "MedianLap").withColumnsRenamed({"session_id": "_s", "Driver": "_d"})
    out = out.join(mid, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("Driver") == F.col("_d")))
    return out.select("session_id", "Driver", "Laps", "BestLap", "MeanLap", "MedianLap", "StdDev",
                      (100 / (1 + F.coalesce(F.col("StdDev"), F.lit(0.0)))).alias("ConsistencyScore"))


def order_consistency(summary: DataFrame) -> DataFrame:
    """SL1: best lap, then std dev, NULLs last (a sink-side sort)."""
    return summary.orderBy("session_id", F.col("BestLap").asc_nulls_last(),
                           F.col("StdDev").asc_nulls_last())


def ranked_consistency(summary: DataFrame) -> DataFrame:
    """SL1 as a column: each row's Position in the order of ``order_consistency``, ties by driver."""
    return with_position(summary, F.col("session_id"), F.col("BestLap").asc_nulls_last(), F.col("StdDev").asc_nulls_last(), F.col("Driver"))


def stint_degradation(laps: DataFrame, driver: str | None = None, *, min_laps: int = 3) -> DataFrame:
    """AG3 per (session_id, Driver, Stint, Compound), NULL keys kept, at least ``min_laps`` timed
    laps: Laps, BestLap, MeanLap, DegradationPerLap = least-squares slope of lap time on lap
    number (NULL when every lap number is equal)."""
    data = timed_laps(laps)
    if driver:
        data = data.filter(F.col("Driver") == F.lit(driver))
    lt, ln = F.col("LapTimeSeconds"), F.col("LapNumber").cast("double")
    out = data.groupBy("session_id", "Driver", "Stint", "Compound").agg(
        F.count(F.lit(1)).cast("int").alias("Laps"), F.min(lt).alias("BestLap"),
        F.avg(lt).alias("MeanLap"), F.regr_slope(lt, ln).alias("DegradationPerLap"))
    return out.filter(F.col("Laps") >= min_laps)
