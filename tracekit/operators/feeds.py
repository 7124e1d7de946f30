"""Tidy chart feeds (CH1-CH8): the data half of every figure, long / tidy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tracekit.functions.scalars import lap_label
from tracekit.operators.clean import timed_laps
from tracekit.schemas import SAMPLE_KEYS, require

# --- fixed values: channels drawn as overlays ---
OVERLAY_CHANNELS = ("Speed", "Throttle", "Brake", "nGear", "RPM")
# --- end of fixed values ---


def _label(lap_samples: DataFrame) -> DataFrame:
    return lap_samples.withColumn(
        "Label", lap_label(F.col("driver"), F.col("lap_number"), F.col("lap_time_seconds")))


def channel_overlay(lap_samples: DataFrame, channels: Sequence[str] = OVERLAY_CHANNELS, *,
                    keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """CH1: (lap keys, Label, Distance, Channel, Value) for every channel present; laps
    without a value for a channel contribute no rows for it."""
    chans = [c for c in channels if c in lap_samples.columns]
    s = _label(lap_samples).select(*keys, "Label", "Distance", *[F.col(c).cast("double").alias(c) for c in chans])
    long = s.unpivot([*keys, "Label", "Distance"], chans, "Channel", "Value")
    return long.filter(F.col("Value").isNotNull())


def track_speed_map(lap_samples: DataFrame, *, keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """CH3: (lap keys, X, Y, Speed) with a position."""
    require(lap_samples, ["X", "Y", "Speed"], "track_speed_map")
    return lap_samples.select(*keys, "X", "Y", "Speed").filter(
        F.col("X").isNotNull() & F.col("Y").isNotNull())


def racing_line(lap_samples: DataFrame, *, keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """CH4: (lap keys, Label, X, Y)."""
    require(lap_samples, ["X", "Y"], "racing_line")
    return _label(lap_samples).select(*keys, "Label", "X", "Y").filter(
        F.col("X").isNotNull() & F.col("Y").isNotNull())


def sector_bars(sector_table: DataFrame, *, keys: Sequence[str] = ("session_id", "Driver")) -> DataFrame:
    """CH5: wide sector table -> (keys, Sector, Seconds)."""
    return sector_table.select(*keys, "Sector1", "Sector2", "Sector3").unpivot(
        list(keys), ["Sector1", "Sector2", "Sector3"], "Sector", "Seconds")


def lap_evolution(laps: DataFrame) -> DataFrame:
    """CH6: timed laps (session_id, LapNumber, LapTimeSeconds, Driver, Compound)."""
    return timed_laps(laps).select(
        "session_id", "LapNumber", "LapTimeSeconds", "Driver", "Compound")


def degradation_feed(degradation: DataFrame) -> DataFrame:
    """CH7: (session_id, Driver, Compound, Stint, DegradationPerLap)."""
    return degradation.select("session_id", "Driver", "Compound", "Stint", "DegradationPerLap")


def cluster_feed(clustered: DataFrame) -> DataFrame:
    """CH8: (session_id, LapNumber, LapTimeSeconds, Cluster, Driver, Compound, TyreLife)."""
    return clustered.select("session_id", "LapNumber", "LapTimeSeconds", "Cluster", "Driver",
                            "Compound", "TyreLife")
