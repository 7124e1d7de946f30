"""Edge cases: NaN lap times, raw samples, empty session lists, comparison errors, k-means convergence."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tracekit.functions import scalars as S
from tracekit.operators import clean as CL, ml as ML, pace as PA, select as SE
from tracekit.plans import compare as CP
from tracekit.schemas import CORNERS, LAPS
from tracekit.sources import adapters as A, store as ST

NAN = float("nan")


def test_nan_lap_times_are_missing(spark):
    rows = [("s", "A", n, t, "SOFT", 1) for n, t in enumerate([80.0, NAN, 81.0, 83.0], 1)] + [("s", "B", 1, NAN, "SOFT", 1)]
    laps = spark.createDataFrame(rows, "session_id string, Driver string, LapNumber int, LapTimeSeconds double, Compound string, Stint int")
    assert CL.timed_laps(laps).count() == CL.valid_timed_laps(laps).count() == 3
    pace = PA.consistency(laps).collect()
    assert len(pace) == 1 and pace[0].Laps == 3 and not math.isnan(pace[0].MeanLap) and not math.isnan(pace[0].ConsistencyScore)
    assert not math.isnan(PA.stint_degradation(laps).first().DegradationPerLap)
    assert [r.LapNumber for r in SE.fastest_laps(laps).collect()] == [1]
    assert SE.quick_laps(laps).count() == 3
    labels = laps.select(S.lap_label(F.col("Driver"), F.col("LapNumber"), F.col("LapTimeSeconds")).alias("l")).collect()
    assert [r.l for r in labels][:2] == ["A L1 (80.000s)", "A L2 (nans)"]


def test_quick_laps_without_driver(spark):
    laps = spark.createDataFrame([("s", None, 1, 80.0), ("s", None, 2, 99.0), ("s", "B", 1, 95.0)], "session_id string, Driver string, LapNumber int, LapTimeSeconds double")
    assert sorted(r.LapTimeSeconds for r in SE.quick_laps(laps).collect()) == [80.0, 95.0]


def test_raw_samples_without_distance(spark):
    rows = [("s", "A", 1, i, f"0 days 00:00:0{i}", 36.0) for i in range(6)]
    raw = spark.createDataFrame(rows, "session_id string, driver string, lap_number int, sample_id long, Time string, Speed double")
    got = CL.clean_samples(raw).orderBy("Distance").collect()
    assert [(r.TimeSeconds, r.Distance) for r in got] == [(float(i), 10.0 * i) for i in range(6)]
    assert CL.clean_samples(raw.drop("Speed")).count() == 6


def test_lap_by_number_is_deterministic(spark):
    laps = spark.createDataFrame([("s", "A", 1, 82.0), ("s", "A", 1, 81.0)], "session_id string, Driver string, LapNumber int, LapTimeSeconds double")
    asked = spark.createDataFrame([("s", "A", 1), ("s", "A", 1), ("s", "A", 9)], "session_id string, Driver string, LapNumber int")
    assert [r.LapTimeSeconds for r in SE.lap_by_number(laps, asked).collect()] == [81.0]
    assert [r.LapNumber for r in SE.laps_not_found(laps, asked).collect()] == [9]


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    index = spark.createDataFrame([("17", 1, "A", 1, 80.0, "T", "C", 1, None, None, None), ("17", 2, "B", 1, 81.0, "T", "C", 1, None, None, None),
                                   ("18", 1, "A", 2, 80.0, "T", "C", 1, None, None, None)],
                                  ST.LAP_INDEX)
    samples = spark.createDataFrame([(s, d, n, float(x)) for s, d, n in (("17", "A", 1), ("17", "B", 1), ("18", "A", 2), ("18", "Z", 2)) for x in range(3)],
                                    "session_id string, driver string, lap_number int, Distance double")
    corners = spark.createDataFrame([(1, "A", 10.0), (2, None, 20.0)], "Number int, Letter string, Distance double")
    ST.save_prepared(root, laps=spark.createDataFrame([], LAPS), samples=samples, lap_index=index, corners=corners)
    return root


def test_store_sessions_and_corners(spark, prepared):
    assert ST.read_lap_samples(spark, prepared).count() == 9
    assert ST.read_lap_samples(spark, prepared, sessions=["18"]).count() == 3
    assert ST.read_lap_samples(spark, prepared, sessions=[]).count() == 0
    assert ST.read_laps(spark, prepared, sessions=[]).count() == 0
    found = ST.read_corners(spark, prepared)
    names = [(f.name, f.dataType) for f in CORNERS.fields]
    assert [(f.name, f.dataType) for f in found.schema.fields] == names
    assert [(f.name, f.dataType) for f in ST.read_corners(spark, prepared + "/none").schema.fields] == names
    assert sorted((r.session_id, r.Number) for r in found.collect()) == [("17", 1), ("17", 2), ("18", 1), ("18", 2)]


def test_comparison_errors(spark, prepared):
    index, samples = ST.read_lap_index(spark, prepared), ST.read_lap_samples(spark, prepared)
    ask = lambda *rows: spark.createDataFrame(list(rows), "session_id string, Driver string, position int")
    with pytest.raises(ValueError, match="17/X"):
        CP.compare_prepared(index, samples, ask(("17", "A", 1), ("17", "X", 2)))
    with pytest.raises(ValueError, match="two drivers"):
        CP.compare_prepared(index, samples, ask(("18", "A", 1)))


def test_labels_do_not_depend_on_the_bound(spark):
    laps = A.laps(spark, SF_SMALL)
    key = ["session_id", "Driver", "LapNumber"]
    one, two = (ML.cluster_laps(laps, max_iter=n).select(*key, "Cluster") for n in (300, 600))
    assert one.exceptAll(two).count() == 0 and one.count() > 0
    with pytest.warns(UserWarning, match="not converged"):
        ML.cluster_laps(laps, max_iter=1)


def test_anomalies_by_another_key(spark):
    laps = A.laps(spark, SF_SMALL).withColumnRenamed("session_id", "race").withColumn("race", F.col("race").cast("int") % 3)
    got = ML.detect_anomalies(laps, by="race", key=("race", "Driver", "LapNumber"), trees=5)
    assert got.columns == [*laps.columns, "AnomalyScore", "IsAnomaly", "Score"] and got.count() > 0
    assert got.where("Score <= 0 or Score > 1").count() == 0
