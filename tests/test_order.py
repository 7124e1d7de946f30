"""Global positions and exact order statistics against plain Python."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracekit.operators import order as OD
from tracekit.operators import pace


def test_positions_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50) if rng.random() > 0.1 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, id int").repartition(7)
    got = {r.id: r.Position for r in OD.with_position(df, F.col("a").desc_nulls_last(), F.col("id")).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [got[r[1]] for r in want] == list(range(1, 3001))


def test_positions_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([], "a int")
    assert OD.with_position(df, "a").collect() == []
    same = spark.createDataFrame([(1,)] * 40, "a int").repartition(5)
    assert sorted(r.Position for r in OD.with_position(same, "a").collect()) == list(range(1, 41))


def test_no_window_over_the_whole_table(spark):
    plan = OD.with_position(spark.range(100).repartition(5), F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("small", [1, 30, 4096])
def test_order_statistics(spark, monkeypatch, small):
    monkeypatch.setattr(OD, "SMALL", small)
    monkeypatch.setattr(OD, "BINS", 64)
    rng = random.Random(2)
    groups = {"normal": [rng.gauss(80, 3) for _ in range(301)], "skewed": [10.0 ** rng.uniform(-6, 6) for _ in range(120)], "one": [4.0], "two": [1.0, 2.0],
              "ties": [rng.choice([1.0, 2.0, 3.0]) for _ in range(200)], "same": [7.0] * 50, None: [3.0, 1.0, 2.0, 0.5],
              "ends": [-math.inf, math.inf, 0.0, 1.0, -1.0, 1.7e308, -1.7e308, 5e-324, -5e-324]}
    rows = [(g, v, 1) for g, vs in groups.items() for v in vs] + [("normal", None, 1), ("normal", math.nan, 1), ("nothing", None, 1)]
    rng.shuffle(rows)
    n = F.col("n")
    ranks = {"least": F.lit(0), "most": n - 1, "low": F.floor((n - 1) / 2), "third": F.floor(n / 3)}
    got = {r.g: r for r in OD.order_statistics(spark.createDataFrame(rows, "g string, v double, n int"), ["g"], "v", ranks).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        s, r = sorted(vs), got[g]
        assert (r.least, r.most, r.low, r.third) == (s[0], s[-1], s[(len(s) - 1) // 2], s[len(s) // 3]), g


def test_medians_of_large_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(OD, "SMALL", 16)
    rng = random.Random(3)
    rows = [("s", d, rng.uniform(70, 90)) for d, k in (("A", 5001), ("B", 4000), ("C", 3), ("D", 1)) for _ in range(k)]
    laps = spark.createDataFrame(rows, "session_id string, Driver string, LapTimeSeconds double")
    got = {r.Driver: r for r in pace.consistency(laps).collect()}
    for d in "ABCD":
        own = [v for _, x, v in rows if x == d]
        assert got[d].Laps == len(own) and got[d].MedianLap == pytest.approx(statistics.median(own), abs=1e-12)


def test_ranked_consistency_is_the_order_of_the_sink(spark):
    rows = [("s", "B", 80.0, 1.0), ("s", "A", 80.0, 1.0), ("s", "C", 80.0, None), ("r", "Z", None, None), ("r", "Y", 90.0, 2.0)]
    df = spark.createDataFrame(rows, "session_id string, Driver string, BestLap double, StdDev double")
    got = sorted(pace.ranked_consistency(df).collect(), key=lambda r: r.Position)
    assert [r.Driver for r in got] == ["Y", "Z", "A", "B", "C"]
