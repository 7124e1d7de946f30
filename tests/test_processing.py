"""Cleaning and alignment (expectations of the reference's processing tests + properties)."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tracekit.operators import align as AL
from tracekit.operators import clean as CL


def test_cleaner_sorts_dedupes_and_derives_channels(spark):
    td = dt.timedelta
    raw = spark.createDataFrame(
        [("s", "AAA", 1, 1, 10, td(seconds=1), td(seconds=101), 200, False, 0),
         ("s", "AAA", 1, 2, 0, td(seconds=0), td(seconds=100), 180, True, 12),
         ("s", "AAA", 1, 3, 20, td(seconds=2), td(seconds=102), 210, False, 14)],
        "session_id string, driver string, lap_number int, sample_id long, Distance int, "
        "Time interval day to second, SessionTime interval day to second, Speed int, Brake boolean, DRS int")
    out = CL.clean_samples(raw).orderBy("Distance").collect()
    assert [r["Distance"] for r in out] == [0.0, 10.0, 20.0]
    assert [r["Brake"] for r in out] == [1, 0, 0]
    assert [r["DRSActive"] for r in out] == [1, 0, 1]
    assert [r["TimeSeconds"] for r in out] == [0.0, 1.0, 2.0]
    assert [r["SessionTimeSeconds"] for r in out] == [100.0, 101.0, 102.0]


def test_coercion_text_and_nan(spark):
    raw = spark.createDataFrame([("s", "A", 1, 1, 1.0, "True", "n/a", float("nan"))],
                                "session_id string, driver string, lap_number int, sample_id long, "
                                "Distance double, Brake string, Speed string, RPM double")
    r = CL.clean_samples(raw).first()
    assert r["Brake"] == 0 and r["Speed"] is None and r["RPM"] is None


def test_dedupe_keeps_earliest_sample(spark):
    raw = spark.createDataFrame(
        [("s", "A", 1, 2, 5.0, 1.0, 100.0), ("s", "A", 1, 1, 5.0, 2.0, 200.0), ("s", "A", 1, 3, None, 0.5, 1.0)],
        "session_id string, driver string, lap_number int, sample_id long, Distance double, "
        "TimeSeconds double, Speed double")
    out = CL.dedupe_samples(raw).collect()
    assert [(r["sample_id"], r["Speed"]) for r in out] == [(2, 100.0)]


def _pair_samples(spark):
    rows = []
    for d, (times, speeds) in {"AAA": ([0, 10, 20], [100, 150, 200]),
                               "BBB": ([0, 11, 22], [100, 145, 190])}.items():
        for i, dist in enumerate([0, 50, 100]):
            rows.append(("s", d, 1, i, float(dist), float(times[i]), float(speeds[i])))
    return spark.createDataFrame(rows, "session_id string, driver string, lap_number int, sample_id long, "
                                       "Distance double, TimeSeconds double, Speed double")


def test_pair_delta_three_points(spark):
    s = _pair_samples(spark)
    pairs = spark.createDataFrame([("s", 1, "AAA", "BBB")],
                                  "session_id string, lap_number int, ref_driver string, cmp_driver string")
    out = AL.align_pairs(s, pairs, points=3).orderBy("grid_index").collect()
    assert [r["DeltaSeconds"] for r in out] == [0.0, 1.0, 2.0]
    assert [r["Distance"] for r in out] == [0.0, 50.0, 100.0]
    assert [r["cmp_Speed"] for r in out] == [100.0, 145.0, 190.0]


def test_interpolation_matches_numpy_and_stays_in_range(spark):
    rng = np.random.default_rng(7)
    rows = []
    for lap in range(4):
        xs = np.sort(rng.choice(np.arange(0, 500), size=40, replace=False)).astype(float) + lap
        ys = rng.normal(size=40)
        ys[rng.random(40) < 0.2] = np.nan
        for i, (x, y) in enumerate(zip(xs, ys)):
            rows.append(("s", "D", lap, i, float(x), None if np.isnan(y) else float(y)))
    s = spark.createDataFrame(rows, "session_id string, driver string, lap_number int, sample_id long, "
                                    "Distance double, Speed double")
    dom = AL.lap_domain(s)
    out = AL.align(s, dom, group_keys=["session_id", "driver", "lap_number"], member_keys=[],
                   channels=("Speed",), points=57).toPandas()
    pdf = s.toPandas()
    for lap, g in out.groupby("lap_number"):
        src = pdf[pdf.lap_number == lap].sort_values("Distance")
        grid = np.linspace(src.Distance.min(), src.Distance.max(), 57)
        cl = src[["Distance", "Speed"]].dropna()
        exp = np.interp(grid, cl.Distance.to_numpy(), cl.Speed.to_numpy())
        got = g.sort_values("grid_index").Speed.to_numpy()
        assert np.array_equal(exp, got)
        assert got.min() >= cl.Speed.min() and got.max() <= cl.Speed.max()


def test_delta_of_lap_with_itself_is_zero_and_partitioning_invariant(spark):
    s = _pair_samples(spark).filter(F.col("driver") == "AAA")
    s2 = s.withColumn("driver", F.lit("ZZZ"))
    both = s.unionByName(s2).repartition(7)
    pairs = spark.createDataFrame([("s", 1, "AAA", "ZZZ")],
                                  "session_id string, lap_number int, ref_driver string, cmp_driver string")
    out = AL.align_pairs(both, pairs, points=11).collect()
    assert len(out) == 11 and all(r["DeltaSeconds"] == 0.0 for r in out)


def test_single_point_channel_is_null_and_empty_domain_drops(spark):
    rows = [("s", "A", 1, 0, 0.0, 1.0, None), ("s", "A", 1, 1, 10.0, 2.0, 5.0),
            ("s", "B", 1, 0, 20.0, 1.0, 1.0), ("s", "B", 1, 1, 30.0, 2.0, 2.0)]
    s = spark.createDataFrame(rows, "session_id string, driver string, lap_number int, sample_id long, "
                                    "Distance double, TimeSeconds double, Speed double")
    dom = AL.lap_domain(s)
    one = AL.align(s, dom.filter("driver = 'A'"), group_keys=["session_id", "lap_number"],
                   member_keys=["driver"], channels=("Speed", "TimeSeconds"), points=5).collect()
    assert len(one) == 5 and all(r["Speed"] is None for r in one)
    assert all(r["TimeSeconds"] is not None for r in one)
    none = AL.align(s, dom, group_keys=["session_id", "lap_number"], member_keys=["driver"],
                    channels=("Speed",), points=5)
    assert none.count() == 0


def test_resample_time_grid(spark):
    rows = [("s", "A", 1, i, float(i * 7), t, float(i)) for i, t in enumerate([0.0, 0.4, 1.0, 2.05])]
    s = spark.createDataFrame(rows, "session_id string, driver string, lap_number int, sample_id long, "
                                    "Distance double, TimeSeconds double, Speed double")
    out = AL.resample_time(s, frequency_hz=2.0, channels=("Speed",)).orderBy("grid_index").collect()
    assert [r["TimeSeconds"] for r in out] == [0.0, 0.5, 1.0, 1.5, 2.0]
    exp = np.interp([0.0, 0.5, 1.0, 1.5, 2.0], [0.0, 0.4, 1.0, 2.05], [0.0, 1.0, 2.0, 3.0])
    assert np.allclose([r["Speed"] for r in out], exp)


def test_derive_distance_two_level_matches_running_sum(spark):
    rng = np.random.default_rng(4)
    rows = []
    for lap in range(3):
        t = np.cumsum(rng.uniform(0.05, 40.0, 80))
        for i, ti in enumerate(t):
            sp = None if rng.random() < 0.05 else float(rng.uniform(50, 330))
            rows.append(("s", "D", lap, i, float(ti), sp))
    s = spark.createDataFrame(rows, "session_id string, driver string, lap_number int, sample_id long, "
                                    "TimeSeconds double, Speed double")
    got = CL.derive_distance(s, bucket_s=97.0).toPandas().sort_values(["lap_number", "TimeSeconds"])
    for lap, g in got.groupby("lap_number"):
        sp = g.Speed.to_numpy(float)
        dt_ = np.r_[np.nan, np.diff(g.TimeSeconds.to_numpy())]
        exp = np.cumsum(np.nan_to_num(sp / 3.6 * dt_))
        assert np.allclose(g.Distance.to_numpy(), exp, rtol=1e-12, atol=1e-9)
