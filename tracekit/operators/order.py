"""Global positions and exact order statistics without a task that holds a whole table or group."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracekit.session import ensure_checkpoint_dir, materialize

BINS = 1024        # of a histogram pass
SMALL = 4096       # values of a group that are sorted in one buffer
FEW_GROUPS = 100_000
LARGEST = 1.7976931348623157e308


def with_position(df: DataFrame, *order: Column | str, name: str = "Position") -> DataFrame:
    """Adds each row's position, from 1, in the order of the whole table (give it columns that make it total).

    Rows are dealt to partitions by ranges of the order and sorted there; a row's position is its place in its partition
    plus the sizes of the partitions before. Only these sizes meet in one place.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(placed)  # places hold from here on
    part = F.shiftright("_place", 33).cast("int")
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    starts = [0, *accumulate(n for _, n in sizes)]
    before = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "_part int, _before long")
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    rows = placed.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row for each partition
    return rows.select(*df.columns, (F.col("_before") + place + 1).alias(name))


def _same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    on = left[by[0]].eqNullSafe(right[f"_{by[0]}"])
    for c in by[1:]:
        on = on & left[c].eqNullSafe(right[f"_{c}"])
    return on


def _beside(rows: DataFrame, small: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows joined to a table of a few rows a group; null keys are a group like others."""
    small = small.withColumnsRenamed({c: f"_{c}" for c in by})
    return rows.join(small, _same(rows, small, by), how).drop(*[f"_{c}" for c in by])


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by..., one double for each of ``ranks``): exact order statistics of the values that are neither null nor NaN.

    A rank is a column over ``n``, the group's number of values, counted from 0 (``{"least": F.lit(0)}``). Histogram passes narrow a rank's
    interval down to ``SMALL`` values or to a single one: each pass counts ``BINS`` bins between the least and the greatest value that is
    left, keeps the bin that holds the rank, and goes on between the least and greatest value found in it.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    v = F.col("_v")
    data = rows.select(*by, F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v)).persist(StorageLevel.MEMORY_AND_DISK)
    ends = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    targets = F.explode(F.array(*[F.struct(F.lit(name).alias("t"), rank.cast("long").alias("r")) for name, rank in ranks.items()])).alias("_t")
    open_ = materialize(ends.select(*by, targets, "n", "_lo", "_hi").select(*by, F.col("_t.t").alias("_name"), F.col("_t.r").alias("_rank"), "n", "_lo", "_hi"))
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("n") > SMALL)
    closed = []
    while True:
        closed.append(open_.where(~wide))
        open_ = open_.where(wide)
        groups = open_.count()
        if not groups:
            break
        sent = F.broadcast(open_) if groups <= FEW_GROUPS else open_
        inside = _beside(data, sent, by).where((v >= F.col("_lo")) & (v <= F.col("_hi")))
        half = lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)) / 2
        share = F.try_divide(half(v) - half(F.col("_lo")), half(F.col("_hi")) - half(F.col("_lo")))
        at = F.when(v == F.col("_lo"), 0).when(v == F.col("_hi"), BINS - 1).otherwise(F.least(F.lit(BINS - 2), F.greatest(F.lit(1), F.floor(F.coalesce(share, F.lit(0.5)) * BINS))))
        bins = inside.groupBy(*by, "_name", "_rank", at.alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        order = Window.partitionBy(*by, "_name").orderBy("_bin")  # over BINS rows at most
        bins = bins.withColumn("_to", F.sum("n").over(order)).withColumn("_from", F.col("_to") - F.col("n"))
        held = bins.where((F.col("_from") <= F.col("_rank")) & (F.col("_rank") < F.col("_to")))
        open_ = materialize(held.select(*by, "_name", (F.col("_rank") - F.col("_from")).alias("_rank"), "n", "_lo", "_hi"))
    found = None
    for part in closed:
        found = part if found is None else found.unionByName(part)
    found = materialize(found)
    small = found.where("_lo < _hi")
    inside = _beside(data, small, by).where((v >= F.col("_lo")) & (v <= F.col("_hi")))
    picked = inside.groupBy(*by, "_name", "_rank").agg(F.sort_array(F.collect_list(v)).alias("_all")).select(*by, "_name", F.get("_all", F.col("_rank").cast("int")).alias("_x"))
    every = found.where("_lo = _hi").select(*by, "_name", F.col("_lo").alias("_x")).unionByName(picked)
    out = materialize(every.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in ranks]))
    data.unpersist()
    return out


def medians(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(by..., name): the exact median of each group."""
    halves = order_statistics(rows, by, value, {"_low": F.floor((F.col("n") - 1) / 2), "_high": F.floor(F.col("n") / 2)})
    return halves.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * 0.5).alias(name))
