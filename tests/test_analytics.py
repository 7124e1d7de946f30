"""Pace, consistency and degradation (expectations of the reference's analytics tests + edges)."""

import pytest
from pyspark.sql import functions as F

from tracekit.operators import pace


def laps_df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_consistency_orders_by_best_lap(spark):
    df = laps_df(spark, [("s", "AAA", 80.0), ("s", "AAA", 81.0), ("s", "BBB", 82.0), ("s", "BBB", 84.0)],
                 "session_id string, Driver string, LapTimeSeconds double")
    out = pace.order_consistency(pace.consistency(df)).collect()
    assert out[0]["Driver"] == "AAA"
    assert out[0]["BestLap"] == 80.0
    assert out[0]["Laps"] == 2
    assert out[0]["MedianLap"] == pytest.approx(80.5)
    assert out[0]["StdDev"] == pytest.approx(0.7071067811865476)
    assert out[0]["ConsistencyScore"] == pytest.approx(100 / (1 + 0.7071067811865476))


def test_consistency_single_lap_and_invalid_rows(spark):
    df = laps_df(spark, [("s", "AAA", 80.0), ("s", "AAA", None), ("s", "AAA", 0.0), ("s", None, 70.0),
                         ("s", "CCC", -1.0)],
                 "session_id string, Driver string, LapTimeSeconds double")
    out = pace.consistency(df).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["Driver"], r["Laps"], r["StdDev"], r["ConsistencyScore"]) == ("AAA", 1, None, 100.0)


def test_degradation_slope(spark):
    df = laps_df(spark, [("s", "AAA", 1, 80.0, 1, "MEDIUM"), ("s", "AAA", 2, 81.0, 1, "MEDIUM"),
                         ("s", "AAA", 3, 82.0, 1, "MEDIUM")],
                 "session_id string, Driver string, LapNumber int, LapTimeSeconds double, Stint int, Compound string")
    out = pace.stint_degradation(df).collect()
    assert len(out) == 1
    assert round(out[0]["DegradationPerLap"], 6) == 1.0
    assert out[0]["Laps"] == 3 and out[0]["BestLap"] == 80.0 and out[0]["MeanLap"] == 81.0


def test_degradation_keeps_null_keys_and_needs_three_laps(spark):
    rows = [("s", "AAA", i, 80.0 + i, None, None) for i in range(1, 4)]
    rows += [("s", "BBB", i, 80.0, 1, "SOFT") for i in range(1, 3)]
    df = laps_df(spark, rows, "session_id string, Driver string, LapNumber int, LapTimeSeconds double, "
                              "Stint int, Compound string")
    out = pace.stint_degradation(df).collect()
    assert [(r["Driver"], r["Stint"], r["Compound"]) for r in out] == [("AAA", None, None)]
    assert pace.stint_degradation(df, "BBB").count() == 0


def test_degradation_constant_lap_number_is_null(spark):
    df = laps_df(spark, [("s", "AAA", 5, 80.0 + i, 1, "SOFT") for i in range(3)],
                 "session_id string, Driver string, LapNumber int, LapTimeSeconds double, Stint int, Compound string")
    assert pace.stint_degradation(df).first()["DegradationPerLap"] is None
