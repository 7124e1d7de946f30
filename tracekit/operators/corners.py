"""Corner window range join and corner speeds (CO1-CO3).

A sample belongs to a corner when ``|Distance - corner distance| <= window_m``. Instead of
a nested-loop join the corners are spread over the fixed-width distance buckets their
window touches (at most three) and joined on (session, bucket) - an equi-join that can
hash-partition or broadcast - then the exact band predicate is applied. Each
(sample, corner) pair comes out once because a sample has exactly one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tracekit.functions.scalars import corner_label
from tracekit.schemas import SAMPLE_KEYS, require


# Corner tables without session_id are circuit-wide: the only join key is the distance
# bucket (a few dozen values), so they are broadcast - after checking they hold at most
# BROADCAST_MAX_CORNERS rows. A larger one is joined on (bucket, salt) with SALTS copies,
# each sample drawing one salt from its hash, so the hot buckets spread over many tasks.
BROADCAST_MAX_CORNERS = 100_000
SALTS = 64


def corner_window(samples: DataFrame, corners: DataFrame, *, window_m: float = 70.0,
                  keys: Sequence[str] = SAMPLE_KEYS,
                  columns: Sequence[str] = ("sample_id", "Distance", "Speed"),
                  broadcast_max_rows: int = BROADCAST_MAX_CORNERS) -> DataFrame:
    """CO1: (lap keys, Number, Letter, CornerDistance, sample columns) for every sample in the
    inclusive window of every corner; corners without session_id apply to all sessions."""
    require(corners, ["Number", "Distance"], "corner_window")
    w = float(window_m)
    width = 2.0 * w if w > 0 else 1.0
    on_session = keys[0] in corners.columns
    c = corners.select(
        *([keys[0]] if on_session else []), F.col("Number"),
        (F.col("Letter") if "Letter" in corners.columns else F.lit(None).cast("string")).alias("Letter"),
        F.col("Distance").cast("double").alias("CornerDistance"))
    c = c.withColumn("_bucket", F.explode(F.sequence(
        F.floor((F.col("CornerDistance") - w) / width), F.floor((F.col("CornerDistance") + w) / width))))
    cols = [col for col in columns if col in samples.columns and col not in keys]
    s = samples.select(*keys, *cols).filter(F.col("Distance").isNotNull()).withColumn(
        "_bucket", F.floor(F.col("Distance") / width))
    join_keys = ([keys[0]] if on_session else []) + ["_bucket"]
    if not on_session:
        if c.limit(broadcast_max_rows + 1).count() <= broadcast_max_rows:
            c = F.broadcast(c)
        else:
            c = c.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            s = s.withColumn("_salt", F.pmod(F.xxhash64(*keys, "Distance"), F.lit(SALTS)).cast("int"))
            join_keys.append("_salt")
    j = s.join(c, join_keys).filter(
        F.col("Distance").between(F.col("CornerDistance") - w, F.col("CornerDistance") + w))
    return j.select(*keys, "Number", "Letter", "CornerDistance", *cols)


def corner_speeds(samples: DataFrame, corners: DataFrame, *, window_m: float = 70.0,
                  keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """CO2/CO3: per lap and corner with a non-empty window: entry speed (first sample by
    distance), apex (minimum) speed and exit speed (last sample)."""
    require(samples, [*keys, "Distance", "Speed"], "corner_speeds")
    j = corner_window(samples, corners, window_m=window_m, keys=keys, columns=("Distance", "Speed"))
    x, v = F.col("Distance"), F.col("Speed").cast("double")
    g = j.groupBy(*keys, "Number", "Letter", "CornerDistance").agg(
        F.min_by(v, x).alias("EntrySpeed"), F.min(v).alias("ApexMinimumSpeed"),
        F.max_by(v, x).alias("ExitSpeed"))
    return g.select(
        F.col(keys[0]), F.col(keys[1]).alias("Driver"), F.col(keys[2]).alias("Lap"),
        corner_label(F.col("Number"), F.col("Letter")).alias("Corner"),
        F.col("CornerDistance").alias("Distance"), "EntrySpeed", "ApexMinimumSpeed", "ExitSpeed")
