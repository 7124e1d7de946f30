"""Scalar expressions, lap selection, insights text and the driver contract."""

import datetime as dt

from pyspark.sql import functions as F

from tracekit.functions import scalars as S
from tracekit.operators import insights as IN
from tracekit.operators import select as SE
from tracekit.sources.store import LAPS


def test_slug_session_key_and_labels(spark):
    df = spark.createDataFrame([(2024, "São Paulo  GP!", "Sprint Qualifying")], "y int, gp string, st string")
    r = df.select(S.slug(F.col("gp")).alias("s"),
                  S.session_key(F.col("y"), F.col("gp"), F.col("st")).alias("k"),
                  S.session_label(F.col("y"), F.col("gp"), F.col("st")).alias("l")).first()
    assert r["s"] == "são_paulo__gp"
    assert r["k"] == "2024_são_paulo__gp_sprint_qualifying"
    assert r["l"] == "2024 São Paulo  GP! Sprint Qualifying"
    lab = spark.createDataFrame([("VER", 12, 80.1234), ("LEC", 3, None), ("X", 1, 79.0)],
                                "d string, n int, t double").select(
        S.lap_label(F.col("d"), F.col("n"), F.col("t")).alias("x")).collect()
    assert [r["x"] for r in lab] == ["VER L12 (80.123s)", "LEC L3 (nans)", "X L1 (79.000s)"]


def test_corner_label_and_defaults(spark):
    df = spark.createDataFrame([(1, None), (4, " b "), (12, "")], "n int, l string")
    assert [r[0] for r in df.select(S.corner_label(F.col("n"), F.col("l"))).collect()] == ["1", "4b", "12"]
    assert spark.range(1).select(S.text_or_unknown(F.lit(None).cast("string"))).first()[0] == "Unknown"


def test_durations(spark):
    df = spark.createDataFrame([(dt.timedelta(minutes=14, seconds=16.306), "0 days 00:14:16.306000", "00:01:20.5"),
                                (None, None, None)], "i interval day to second, t string, s string")
    r = df.select(S.seconds_of(df, "i").alias("a"), S.seconds_of(df, "t").alias("b"),
                  S.seconds_of(df, "s").alias("c")).collect()
    assert abs(r[0]["a"] - 856.306) < 1e-9 and abs(r[0]["b"] - 856.306) < 1e-9 and r[0]["c"] == 80.5
    assert r[1]["a"] is None and r[1]["b"] is None


def _laps(spark):
    rows = [("s", "A", 1, 90.0), ("s", "A", 2, 80.0), ("s", "A", 3, 80.0), ("s", "A", 4, None),
            ("s", "B", 1, 100.0), ("s", "B", 2, 95.0), ("s", "C", 1, None)]
    full = [(sid, d, n, t, None, None, None, None, None, 1, None, "1", None, None) for sid, d, n, t in rows]
    return spark.createDataFrame(full, LAPS)


def test_fastest_quick_and_lookup(spark):
    laps = _laps(spark)
    f = {r["Driver"]: r["LapNumber"] for r in SE.fastest_laps(laps).collect()}
    assert f == {"A": 2, "B": 2}
    q = sorted((r["Driver"], r["LapNumber"]) for r in SE.quick_laps(laps, factor=1.07).collect())
    assert q == [("A", 2), ("A", 3), ("B", 1), ("B", 2)]   # B has no quick lap -> all of B's timed laps
    req = spark.createDataFrame([("s", "A", 4), ("s", "A", 3), ("s", "Z", 1)], "session_id string, Driver string, LapNumber int")
    assert [r["LapNumber"] for r in SE.lap_by_number(laps, req).collect()] == [3]
    assert sorted(r["Driver"] for r in SE.laps_not_found(laps, req).collect()) == ["A", "Z"]
    avail = SE.available_drivers(laps).orderBy("position").collect()
    assert [r["Driver"] for r in avail] == ["A", "B", "C"]
    res = spark.createDataFrame([("s", 2, "B"), ("s", 1, "C"), ("s", 3, None)], "session_id string, position int, Abbreviation string")
    assert [r["Driver"] for r in SE.available_drivers(laps, res).orderBy("position").collect()] == ["C", "B"]


def test_rank_and_cards(spark):
    laps = _laps(spark)
    req = spark.createDataFrame([("s", "B", 1), ("s", "A", 2)], "session_id string, Driver string, position int")
    sel = SE.fastest_laps_selected(laps, req)
    assert [r["Driver"] for r in SE.rank_laps(sel).orderBy("Rank").collect()] == ["A", "B"]
    assert [r["Driver"] for r in SE.lap_cards(sel, cards=1).collect()] == ["B"]
    sec = SE.sector_table(sel, laps).collect()
    assert {r["Compound"] for r in sec} == {"Unknown"}


def test_insight_text(spark):
    ins = spark.createDataFrame([("best_lap_gap", "VER", "LEC", 0.1234, None), ("speed", "VER", None, 330.04, 80.0),
                                 ("full_throttle", "VER", None, 71.25, None), ("final_delta", None, "ahead", 0.5, -0.5)],
                                "Kind string, Driver string, Other string, Value1 double, Value2 double")
    t = [r["Text"] for r in IN.insight_text(ins).collect()]
    assert t[0] == "VER owns the best selected lap by 0.123s over LEC."
    assert t[1] == "VER peak speed: 330.0 km/h; minimum speed: 80.0 km/h."
    assert t[3] == "Finish-line delta trend: comparison driver is 0.500s ahead."


def test_entry_contract(spark):
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
    df = E.entry(spark)
    assert {"DeltaSeconds", "Distance", "grid_index"} <= set(df.columns)
    assert df.limit(5).count() == 5
