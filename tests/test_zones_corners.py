"""Braking zones and corner windows against brute-force pandas on small fixtures."""

import numpy as np
import pandas as pd

from tracekit.operators import corners as CO
from tracekit.operators import zones as ZN


def _laps(spark, seed=3, laps=3, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for lap in range(laps):
        xs = np.sort(rng.choice(np.arange(0, 1000), size=n, replace=False)).astype(float)
        brake = (rng.random(n) < 0.45).astype(int)
        for i, x in enumerate(xs):
            speed = None if rng.random() < 0.05 else float(rng.integers(50, 330))
            rows.append(("s", "D", lap, i, float(x), float(i) * 0.1, speed, int(brake[i])))
    return spark.createDataFrame(rows, "session_id string, driver string, lap_number int, sample_id long, "
                                       "Distance double, TimeSeconds double, Speed double, Brake int")


def brute_zones(pdf, minimum):
    out = []
    for lap, f in pdf.sort_values("Distance").groupby("lap_number"):
        f = f.copy()
        f["b"] = f.Brake.fillna(0).astype(float) > 0.5
        f["z"] = (f.b != f.b.shift()).cumsum()
        for z, g in f[f.b].groupby("z"):
            length = g.Distance.max() - g.Distance.min()
            if length < minimum:
                continue
            entry = g.Speed.iloc[0]
            out.append((lap, int(z), g.Distance.min(), g.Distance.max(), entry, g.Speed.min(),
                        g.TimeSeconds.max() - g.TimeSeconds.min()))
    return sorted(out)


def test_braking_zones_match_brute_force(spark):
    s = _laps(spark)
    pdf = s.toPandas()
    for bucket in (7.0, 100.0, 5000.0):
        got = ZN.braking_zones(s, minimum_distance_m=20.0, bucket_m=bucket).toPandas()
        mine = sorted((r.Lap, int(r.ZoneId), r.StartDistance, r.EndDistance,
                       None if pd.isna(r.EntrySpeed) else r.EntrySpeed, r.MinimumSpeed, r.DurationS)
                      for r in got.itertuples())
        exp = [tuple(None if (isinstance(v, float) and np.isnan(v)) else v for v in t)
               for t in brute_zones(pdf, 20.0)]
        assert mine == exp
        assert (got.LengthM >= 20.0).all()


def test_zone_ids_equal_flag_change_count(spark):
    s = _laps(spark, seed=5, laps=2, n=60)
    got = ZN.zone_ids(s, bucket_m=33.0).toPandas().sort_values(["lap_number", "Distance"])
    for lap, f in got.groupby("lap_number"):
        b = f.Braking.to_numpy()
        exp = np.cumsum(np.r_[1, (b[1:] != b[:-1]).astype(int)])
        assert (f.ZoneId.to_numpy() == exp).all()


def test_corner_speeds_match_brute_force(spark):
    s = _laps(spark, seed=9, laps=2, n=80)
    corners = spark.createDataFrame([(1, "", 100.0), (2, "a", 130.0), (3, None, 990.0), (4, "b", 2000.0)],
                                    "Number int, Letter string, Distance double")
    got = CO.corner_speeds(s, corners, window_m=70.0).toPandas()
    pdf = s.toPandas().sort_values("Distance")
    exp = []
    for lap, f in pdf.groupby("lap_number"):
        for num, let, d in [(1, "", 100.0), (2, "a", 130.0), (3, None, 990.0), (4, "b", 2000.0)]:
            seg = f[f.Distance.between(d - 70.0, d + 70.0)]
            if seg.empty:
                continue
            exp.append((lap, f"{num}{let or ''}", d, seg.Speed.iloc[0], seg.Speed.min(), seg.Speed.iloc[-1]))
    norm = lambda t: tuple(None if isinstance(v, float) and np.isnan(v) else v for v in t)
    mine = sorted(norm((r.Lap, r.Corner, r.Distance, r.EntrySpeed, r.ApexMinimumSpeed, r.ExitSpeed))
                  for r in got.itertuples())
    assert mine == sorted(norm(t) for t in exp)


def test_corner_window_per_session_and_overlap(spark):
    s = spark.createDataFrame([("a", "D", 1, 1, 10.0, 100.0), ("a", "D", 1, 2, 15.0, 90.0),
                               ("b", "D", 1, 3, 10.0, 80.0)],
                              "session_id string, driver string, lap_number int, sample_id long, "
                              "Distance double, Speed double")
    corners = spark.createDataFrame([("a", 1, None, 12.0), ("a", 2, None, 16.0)],
                                    "session_id string, Number int, Letter string, Distance double")
    out = CO.corner_window(s, corners, window_m=4.0).collect()
    assert sorted((r["sample_id"], r["Number"]) for r in out) == [(1, 1), (2, 1), (2, 2)]


def test_corner_window_salted_path_equals_broadcast(spark):
    s = _laps(spark, seed=11, laps=2, n=50)
    corners = spark.createDataFrame([(i, None, float(i * 40)) for i in range(25)],
                                    "Number int, Letter string, Distance double")
    a = sorted(CO.corner_window(s, corners, window_m=30.0).collect())
    b = sorted(CO.corner_window(s, corners, window_m=30.0, broadcast_max_rows=0).collect())
    assert a == b and len(a) > 0
