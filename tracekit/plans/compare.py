"""Compositions: compare fastest laps (AL6), compare from a prepared dataset (AL7),
report bundle (CH9). Each returns a dict of DataFrames sharing the session key."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F

from tracekit.operators import align as AL
from tracekit.operators import insights as IN
from tracekit.operators import segments as SG
from tracekit.operators import select as SE
from tracekit.operators.clean import clean_samples
from tracekit.schemas import DEFAULT_COMPARISON_CHANNELS, DEFAULT_GRID_POINTS
from tracekit.session import ensure_checkpoint_dir, materialize
from tracekit.sources.store import missing_drivers

PAIR_BY_SESSION = ("session_id", "ref_driver", "cmp_driver")


def reference_pairs(meta: DataFrame) -> DataFrame:
    """First requested lap of each session is the reference, every other one a comparison:
    session_id, ref_driver, ref_lap, cmp_driver, cmp_lap."""
    first = F.struct(F.col("position"), F.col("driver"), F.col("lap_number"))
    m = meta.join(meta.groupBy("session_id").agg(F.min(first).alias("_ref")), "session_id")
    return (m.filter(F.col("position") != F.col("_ref.position"))
            .select("session_id", F.col("_ref.driver").alias("ref_driver"),
                    F.col("_ref.lap_number").alias("ref_lap"), F.col("driver").alias("cmp_driver"),
                    F.col("lap_number").alias("cmp_lap")))


def compare_laps(meta: DataFrame, samples: DataFrame, *, laps: DataFrame | None = None,
                 sectors: DataFrame | None = None,
                 channels: Sequence[str] = DEFAULT_COMPARISON_CHANNELS,
                 points: int = DEFAULT_GRID_POINTS, raw: bool = False, segments: DataFrame | None = None) -> dict[str, DataFrame]:
    """Align selected laps (``meta``: session_id, driver, lap_number, lap_time_seconds, team,
    compound, stint, position) per session and derive sectors and insights. ``raw`` samples
    are cleaned, of the selected laps only."""
    lap_keys = ["session_id", "driver", "lap_number"]
    # selected first, then (for raw samples) cleaned, once for all that follows
    samples = samples.join(meta.select(*lap_keys), lap_keys, "left_semi")
    samples = materialize(clean_samples(samples) if raw else samples)
    if segments is None:
        aligned = AL.align_many(samples, meta.select(*lap_keys), group_keys=["session_id"],
                                member_keys=["driver"], channels=channels, points=points)
        pairs = AL.align_pairs(samples, reference_pairs(meta), pair_keys=PAIR_BY_SESSION,
                               channels=channels, points=points)
    else:
        aligned = SG.align_indexed(segments, meta.select(*lap_keys), group_keys=["session_id"],
                                   member_keys=["driver"], channels=channels, points=points)
        pairs = SG.align_pairs_indexed(segments, reference_pairs(meta), pair_keys=PAIR_BY_SESSION,
                                       channels=channels, points=points)
    two = meta.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 2")
    delta = (IN.final_delta(pairs, group_keys=PAIR_BY_SESSION).join(two, "session_id", "left_semi")
             if "DeltaSeconds" in pairs.columns else None)
    stats = IN.lap_stats(samples)
    ins = IN.insights(meta, stats, delta, group_keys=["session_id"])
    out = {"laps": meta, "aligned": aligned, "pairs": pairs, "insights": ins}
    if sectors is not None:
        out["sectors"] = sectors
    return out


def compare_fastest_laps(laps: DataFrame, samples: DataFrame, requests: DataFrame, *,
                         channels: Sequence[str] = DEFAULT_COMPARISON_CHANNELS,
                         points: int = DEFAULT_GRID_POINTS,
                         min_drivers: int = 2, raw: bool = False) -> dict[str, DataFrame]:
    """AL6: fastest lap of every requested driver (SE4) -> cleaned samples (SE6) ->
    alignment (AL5 per session, AL4 reference-vs-each pairs with delta) -> sectors (SE7)
    -> insights (AG8). Sessions with fewer than ``min_drivers`` selected laps are left out."""
    # the selected laps (one row per requested driver) feed every branch below: materialise
    # them once in the shared checkpoint folder instead of re-deriving them per branch
    ensure_checkpoint_dir(laps.sparkSession)
    sel = SE.fastest_laps_selected(laps, requests)
    enough = (sel.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
              .filter(F.col("_n") >= min_drivers))
    sel = sel.join(enough.select("session_id"), "session_id", "left_semi").transform(materialize)
    meta = SE.lap_metadata(sel)
    sectors = SE.sector_table(sel, laps)
    return compare_laps(meta, samples, sectors=sectors, channels=channels, points=points, raw=raw)


def compare_prepared(lap_index: DataFrame, samples: DataFrame, requests: DataFrame, *,
                     channels: Sequence[str] = DEFAULT_COMPARISON_CHANNELS,
                     points: int = DEFAULT_GRID_POINTS, segments: DataFrame | None = None) -> dict[str, DataFrame]:
    """AL7: comparison read back from a prepared dataset: requested drivers looked up in the
    lap index, their stored samples aligned, sectors from the index (SE8), insights.

    With the stored ``segments`` the alignments read these instead of cutting the samples into cells for each comparison.
    Raises ValueError if a requested driver is not prepared or a session is asked for fewer than two.
    """
    missing = [f"{r.session_id}/{r.Driver}" for r in missing_drivers(lap_index, requests).limit(10).collect()]
    if missing:
        raise ValueError(f"drivers not in the prepared dataset: {', '.join(missing)}")
    alone = requests.groupBy("session_id").agg(F.countDistinct("Driver").alias("n")).filter("n < 2").limit(10).collect()
    if alone:
        raise ValueError(f"a comparison needs two drivers; sessions with fewer: {', '.join(r.session_id for r in alone)}")
    req = requests.select("session_id", F.col("Driver").alias("driver"),
                          F.col("position").alias("_req_pos"))
    ensure_checkpoint_dir(lap_index.sparkSession)
    idx = lap_index.join(req, ["session_id", "driver"]).transform(materialize)
    meta = idx.select("session_id", "driver", "lap_number", "lap_time_seconds", "team", "compound",
                      "stint", F.col("_req_pos").alias("position"))
    sectors = SE.sector_table_prepared(idx.drop("position").withColumnRenamed("_req_pos", "position"))
    return compare_laps(meta, samples, sectors=sectors, channels=channels, points=points, segments=segments)


def build_report(comparison: dict[str, DataFrame], lap_samples: DataFrame, laps: DataFrame,
                 path: str) -> dict[str, str]:
    """CH9: write the chart feeds and insights of a comparison under one folder, one Parquet
    table per feed partitioned by session_id. ``lap_samples`` are the compared laps'
    samples with their lap time (``selected_lap_samples``). Returns feed -> path."""
    from tracekit.operators import feeds as FD
    from tracekit.operators.insights import insight_text

    tables = {
        "channel_overlay": FD.channel_overlay(lap_samples),
        "lap_evolution": FD.lap_evolution(laps),
        "insights": insight_text(comparison["insights"]),
    }
    if {"X", "Y"} <= set(lap_samples.columns):
        tables["track_speed"] = FD.track_speed_map(lap_samples)
        tables["racing_line"] = FD.racing_line(lap_samples)
    if "DeltaSeconds" in comparison["pairs"].columns:
        tables["delta"] = comparison["pairs"].select(*PAIR_BY_SESSION, "grid_index", "Distance", "DeltaSeconds")
    if "sectors" in comparison:
        tables["sector_bars"] = FD.sector_bars(comparison["sectors"])
    out = {name: f"{path.rstrip('/')}/{name}" for name in tables}

    def write(name: str) -> None:
        # a session's rows in few tasks: the number of files grows with the sessions, not with sessions times tasks
        (tables[name].hint("rebalance", F.col("session_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("session_id").parquet(out[name]))

    with ThreadPoolExecutor(len(tables)) as pool:  # the feeds' jobs run side by side; the first failure ends the report
        list(pool.map(write, tables))
    return out
