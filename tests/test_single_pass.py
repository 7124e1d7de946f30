"""Large inputs are computed once, and points and reports are not scattered."""

import os

from pyspark.sql import functions as F

from tracekit.operators import align as AL
from tracekit.operators import ml as ML
from tracekit.plans import catalog as C
from tracekit.plans import compare as CP

SF = "/root/testdata/sf0.001"


def counted(spark, df):
    """The frame, and an accumulator of the rows that have been read from it."""
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for p in batches:
            seen.add(len(p))
            yield p

    return df.mapInPandas(passing, df.schema), seen


def laps(spark, rows=60):
    cols = "session_id string, Driver string, LapNumber int, LapTimeSeconds double, Sector1TimeSeconds double, Sector2TimeSeconds double, Sector3TimeSeconds double, TyreLife double"
    return spark.createDataFrame([(str(i % 2), f"D{i % 5}", i, 80.0 + i % 7, 20.0 + i % 3, 30.0 + i % 4, 30.0 + i % 6, float(i % 9)) for i in range(rows)], cols)


def test_laps_are_computed_once_for_clusters_and_anomalies(spark):
    for query in (ML.cluster_laps, ML.detect_anomalies):
        frame, seen = counted(spark, laps(spark))
        out = query(frame)
        assert out.count() == 60 and seen.value == 60


def test_laps_are_computed_once_for_a_prepared_store(spark, monkeypatch):
    frame, seen = counted(spark, C.sel_df(spark, SF))
    monkeypatch.setattr(C, "sel_df", lambda *_: frame)
    n = C.prepared_laps(spark, SF)[0].count()
    assert n and C.prepared_laps(spark, SF)[1].count() and seen.value == 2 * n  # two calls


def test_no_grid_point_is_shuffled_to_a_pair(spark):
    samples = spark.createDataFrame([], "session_id string, driver string, lap_number int, Distance double, a double, b double, c double, d double")
    pairs = spark.createDataFrame([], "session_id string, lap_number int, ref_driver string, cmp_driver string")
    plan = AL.align_pairs(samples.repartition(3), pairs.repartition(3), channels=("a", "b", "c", "d"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate")]


def test_a_report_has_one_file_for_a_small_session(spark, tmp_path):
    many = spark.range(400).select((F.col("id") % 2).cast("string").alias("session_id"), F.lit("A").alias("driver"), F.lit(1).alias("lap_number"), F.lit(80.0).alias("lap_time_seconds"),
                                   F.col("id").cast("double").alias("Distance"), F.col("id").cast("double").alias("Speed")).repartition(4)
    insights = spark.createDataFrame([], "session_id string, Item int, Kind string, Driver string, Other string, Value1 double, Value2 double")
    paths = CP.build_report({"insights": insights, "pairs": insights}, many, laps(spark).withColumn("Compound", F.lit("S")), str(tmp_path))
    files = [x for at, _, names in os.walk(paths["channel_overlay"]) for x in names if x.endswith(".parquet")]
    assert len(files) == 2 and spark.read.parquet(paths["channel_overlay"]).count() == 400
