"""Lap selection: distinct drivers, quick / fastest laps, lookups, sector tables, ranking (SE1-SE10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tracekit.functions import scalars as S
from tracekit.operators.clean import clean_samples, timed_laps

LAP_ID = ("session_id", "Driver", "LapNumber")


def available_drivers(laps: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """SE1: (session_id, position, Driver).

    Sessions with classification ``results`` (session_id, position, Abbreviation) list those
    abbreviations in classification order (NULLs dropped, duplicates kept); the others list
    their distinct lap drivers in sorted order.
    """
    distinct = laps.filter(F.col("Driver").isNotNull()).select("session_id", "Driver").distinct()
    ordered = distinct.withColumn(
        "position", F.row_number().over(Window.partitionBy("session_id").orderBy("Driver")))
    if results is None:
        return ordered.select("session_id", F.col("position").cast("int"), "Driver")
    res = (results.filter(F.col("Abbreviation").isNotNull())
           .select("session_id", "position", F.col("Abbreviation").cast("string").alias("Driver")))
    res = res.withColumn("position", F.row_number().over(
        Window.partitionBy("session_id").orderBy("position")))
    fallback = ordered.join(res.select("session_id").distinct(), "session_id", "left_anti")
    return (res.select("session_id", F.col("position").cast("int"), "Driver")
            .unionByName(fallback.select("session_id", F.col("position").cast("int"), "Driver")))


def quick_laps(laps: DataFrame, *, factor: float = 1.07) -> DataFrame:
    """SE2: timed laps within ``factor`` x the session's best; a driver with none keeps all
    of its timed laps. The session best comes from the drivers' bests, and both are joined
    back once (partial aggregation, no window over a whole session)."""
    timed = timed_laps(laps)
    mine = timed.groupBy("session_id", "Driver").agg(F.min("LapTimeSeconds").alias("_mine"))
    best = mine.groupBy("session_id").agg(F.min("_mine").alias("_best"))
    limit = F.col("_best") * F.lit(factor)
    # a driver without a quick lap has no limit
    limits = mine.join(best, "session_id").select(F.col("session_id").alias("_sid"), F.col("Driver").alias("_d"),
                                                  F.when(F.col("_mine") <= limit, limit).alias("_limit"))
    own = (F.col("session_id") == F.col("_sid")) & F.col("Driver").eqNullSafe(F.col("_d"))
    return (timed.join(limits, own).filter(F.col("_limit").isNull() | (F.col("LapTimeSeconds") <= F.col("_limit")))
            .select(*laps.columns))


def fastest_laps(laps: DataFrame, *, by: Sequence[str] = ("session_id", "Driver")) -> DataFrame:
    """SE3: each driver's fastest timed lap; ties go to the lower lap number.

    ``row_number() = 1`` is planned as a map-side group limit before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(F.col("LapTimeSeconds"), F.col("LapNumber"))
    return (timed_laps(laps).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def fastest_laps_selected(laps: DataFrame, requested: DataFrame) -> DataFrame:
    """SE4: fastest lap of each requested (session_id, position, Driver), with the position."""
    return fastest_laps(laps).join(requested.select("session_id", "Driver", "position"),
                                   ["session_id", "Driver"])


def lap_by_number(laps: DataFrame, requested: DataFrame) -> DataFrame:
    """SE5: the timed lap (session_id, Driver, LapNumber) of each request, once; of several the fastest."""
    found = timed_laps(laps).join(requested.select(*LAP_ID).distinct(), list(LAP_ID), "left_semi")
    first = Window.partitionBy(*LAP_ID).orderBy("LapTimeSeconds", *[c for c in laps.columns if c not in LAP_ID])
    return found.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def laps_not_found(laps: DataFrame, requested: DataFrame) -> DataFrame:
    """SE5 report: requests with no timed lap."""
    return requested.select(*LAP_ID).join(timed_laps(laps).select(*LAP_ID), list(LAP_ID), "left_anti")


def lap_metadata(selected: DataFrame) -> DataFrame:
    """Lap metadata carried with each selected lap (defaults for missing team / compound)."""
    extra = [c for c in ("position",) if c in selected.columns]
    return selected.select(
        "session_id", F.col("Driver").alias("driver"), F.col("LapNumber").alias("lap_number"),
        F.col("LapTimeSeconds").alias("lap_time_seconds"),
        S.text_or_unknown(F.col("Team")).alias("team"),
        S.text_or_unknown(F.col("Compound")).alias("compound"),
        S.optional_int(F.col("Stint")).alias("stint"), *extra)


def selected_lap_samples(samples: DataFrame, selected: DataFrame) -> DataFrame:
    """SE6: cleaned samples of the selected laps, with the lap metadata columns."""
    return samples.join(lap_metadata(selected), ["session_id", "driver", "lap_number"])


def clean_selected_samples(raw: DataFrame, selected: DataFrame) -> DataFrame:
    """SE6 from raw samples: the selected laps' samples are picked first, and only those cleaned."""
    keys = ["session_id", "driver", "lap_number"]
    chosen = raw.join(lap_metadata(selected).select(*keys), keys, "left_semi")
    return selected_lap_samples(clean_samples(chosen), selected)


def sector_table(selected: DataFrame, laps: DataFrame) -> DataFrame:
    """SE7: Driver, Lap, LapTime, Sector1-3, Compound, Team for each selected lap; sectors are
    looked up in the lap table on (session, driver, lap number)."""
    meta = lap_metadata(selected)
    sectors = laps.select(
        "session_id", F.col("Driver").alias("driver"), F.col("LapNumber").alias("lap_number"),
        F.col("Sector1TimeSeconds").alias("Sector1"), F.col("Sector2TimeSeconds").alias("Sector2"),
        F.col("Sector3TimeSeconds").alias("Sector3"))
    extra = [c for c in ("position",) if c in meta.columns]
    return meta.join(sectors, ["session_id", "driver", "lap_number"]).select(
        "session_id", *extra, F.col("driver").alias("Driver"), F.col("lap_number").alias("Lap"),
        F.col("lap_time_seconds").alias("LapTime"), "Sector1", "Sector2", "Sector3",
        F.col("compound").alias("Compound"), F.col("team").alias("Team"))


def sector_table_prepared(lap_index: DataFrame) -> DataFrame:
    """SE8: the sector table straight from a prepared dataset's lap index."""
    return lap_index.select(
        "session_id", "position", F.col("driver").alias("Driver"), F.col("lap_number").alias("Lap"),
        F.col("lap_time_seconds").alias("LapTime"), F.col("sector1").alias("Sector1"),
        F.col("sector2").alias("Sector2"), F.col("sector3").alias("Sector3"),
        F.col("compound").alias("Compound"), F.col("team").alias("Team"))


def rank_laps(selected: DataFrame) -> DataFrame:
    """SE9: rank the selected laps of each session by lap time (NULL last; ties by driver)."""
    meta = lap_metadata(selected)
    w = Window.partitionBy("session_id").orderBy(F.col("lap_time_seconds").asc_nulls_last(),
                                                 F.col("driver"), F.col("lap_number"))
    return meta.select(
        "session_id", F.row_number().over(w).alias("Rank"), F.col("driver").alias("Driver"),
        F.col("lap_number").alias("Lap"), F.col("lap_time_seconds").alias("LapTime"),
        F.col("compound").alias("Compound"), F.col("team").alias("Team"))


def lap_cards(selected: DataFrame, *, cards: int = 4) -> DataFrame:
    """SE10: metric cards for the first ``cards`` selected laps (by request position)."""
    meta = lap_metadata(selected)
    if "position" not in meta.columns:
        raise ValueError("lap_cards needs the request position column")
    w = Window.partitionBy("session_id").orderBy("position")
    return (meta.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cards)
            .select("session_id", "position", F.col("driver").alias("Driver"),
                    F.col("lap_time_seconds").alias("LapTime"), F.col("lap_number").alias("Lap"),
                    F.col("compound").alias("Compound")))
