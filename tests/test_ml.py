"""k-means and isolation forest properties (labels are not comparable to another engine's
random stream, so the checks are structural and on planted structure)."""

import numpy as np
from pyspark.sql import functions as F

from tracekit.operators import ml as ML
from tracekit.sources.store import LAPS


def _laps(spark, n=60, outliers=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for sess in ("a", "b"):
        for i in range(n):
            grp = i % 3
            s1, s2, s3 = (np.array([25.0, 30.0, 26.0]) + grp * 3.0 + rng.normal(0, 0.05, 3)).tolist()
            if i < outliers:
                s1 += 40.0
            rows.append((sess, f"D{i % 7}", i + 1, s1 + s2 + s3, s1, s2, s3, "SOFT", float(i % 11), 1, "T", "1",
                         None, None))
    rows.append(("c", "X", 1, 80.0, 20.0, 30.0, 30.0, "SOFT", 1.0, 1, "T", "1", None, None))
    return spark.createDataFrame(rows, LAPS)


def test_standardize_zero_variance(spark):
    df = spark.createDataFrame([("s", 1.0, 5.0), ("s", 3.0, 5.0)], "session_id string, a double, b double")
    r = ML.standardize(df, ["a", "b"]).orderBy("a").collect()
    assert [x["z_a"] for x in r] == [-1.0, 1.0] and [x["z_b"] for x in r] == [0.0, 0.0]


def test_cluster_laps_structure(spark):
    laps = _laps(spark, outliers=0)
    out = ML.cluster_laps(laps, clusters=3).toPandas()
    assert len(out) == 120 and set(out.session_id) == {"a", "b"}   # session c has 1 row < 3
    for sess, g in out.groupby("session_id"):
        assert set(g.Cluster) == {0, 1, 2}
        means = g.groupby("Cluster").LapTimeSeconds.mean()
        assert list(means.index[np.argsort(means.to_numpy())]) == [0, 1, 2]   # relabelled by pace
        truth = (g.LapNumber - 1) % 3
        assert (g.groupby(truth).Cluster.nunique() == 1).all()            # planted groups recovered


def test_assign_clusters_nearest(spark):
    pts = spark.createDataFrame([("s", 1, 0.1, 0.0), ("s", 2, 4.9, 5.0), ("s", 3, 2.5, 2.5)],
                                "session_id string, id int, x double, y double")
    cen = spark.createDataFrame([("s", 0, 0.0, 0.0), ("s", 1, 5.0, 5.0)],
                                "session_id string, cluster int, f0 double, f1 double")
    got = {r["id"]: r["Cluster"] for r in ML.assign_clusters(pts, cen, ["x", "y"]).collect()}
    assert got == {1: 0, 2: 1, 3: 0}   # tie -> lower cluster id


def test_isolation_forest_flags_planted_outliers(spark):
    laps = _laps(spark, outliers=3)
    out = ML.detect_anomalies(laps).toPandas()
    assert len(out) == 120                                   # session c (1 row) is below 8 rows
    assert ((out.AnomalyScore == -1) == out.IsAnomaly).all()
    assert ((out.Score > 0.5) == out.IsAnomaly).all()
    for sess, g in out.groupby("session_id"):
        top = g.sort_values("Score", ascending=False).head(3)
        assert set(top.LapNumber) == {1, 2, 3}
        assert g[g.LapNumber <= 3].IsAnomaly.all()
    again = ML.detect_anomalies(laps.repartition(5)).toPandas()
    a = out.set_index(["session_id", "LapNumber"]).Score.sort_index()
    b = again.set_index(["session_id", "LapNumber"]).Score.sort_index()
    assert np.allclose(a.to_numpy(), b.to_numpy())          # deterministic under repartitioning


def test_average_path_length():
    c = ML.average_path_length(np.array([0, 1, 2, 256]))
    assert c[0] == 0 and c[1] == 0 and c[2] == 1
    assert abs(c[3] - (2 * (np.log(255) + ML.EULER_GAMMA) - 2 * 255 / 256)) < 1e-12


def _points(rng, sizes):
    return [(s, i, *map(float, rng.normal(3 * (i % 3), 0.6, 2))) for s, n in sizes.items() for i in range(n)]


def test_lloyd_in_blocks_equals_lloyd_in_groups_and_plain_steps(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = _points(rng, {"a": 90, "b": 40, "c": 2, "far": 60})
    rows += [("same", i, 1.0, 1.0) for i in range(10)]
    pts = spark.createDataFrame(rows, "session_id string, id int, x double, y double")
    start = [(s, j, float(j), 0.5 * j) for s in ("a", "b", "far", "same") for j in range(3)] + [("c", 0, 0.0, 0.0)] + [("none", 0, 1.0, 1.0)]
    cen = spark.createDataFrame(start, "session_id string, cluster int, f0 double, f1 double")

    def plain(x, c):
        while True:
            at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
            if ((new - c) ** 2).sum() <= 1e-4:
                return new
            c = new

    want = {}
    for s in {r[0] for r in start} & {r[0] for r in rows}:
        own = plain(np.array([r[2:] for r in rows if r[0] == s]), np.array([r[2:] for r in start if r[0] == s]))
        want |= {(s, j): tuple(c) for j, c in enumerate(own)}
    for most in (100_000, 50, 0):
        monkeypatch.setattr(ML, "LOCAL_ROWS", most)
        got = {(r.session_id, r.cluster): (r.f0, r.f1) for r in ML.lloyd(pts, cen, ["x", "y"], k=3).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_lloyd_group_keeps_its_bounds_right():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(300, 3)) * rng.uniform(0.1, 3)
        c = x[:5].copy()
        got, done = ML.lloyd_group(x, c, 300, 0.0)
        at = ((x[:, None] - got[None]) ** 2).sum(2).argmin(1)
        assert done and np.allclose(got, [x[at == j].mean(0) for j in range(5)])  # a fixed point of the step
    assert ML.lloyd_group(x, c, 1, 0.0)[1] is False


def test_score_forest_walks_as_a_plain_walk(spark):
    rng = np.random.default_rng(5)
    forest, nodes = {}, []
    for s in ("a", "b"):
        for t in range(3):
            x = rng.normal(size=(40, 2))
            forest[s, t] = ML.grow_tree(x, rng, ML.max_depth(40))
            nodes += [(s, t, 40, i, *n) for i, n in enumerate(zip(*forest[s, t]))]
    table = spark.createDataFrame([(*n[:4], int(n[4]), float(n[5]), int(n[6]), int(n[7]), float(n[8])) for n in nodes],
                                  "session_id string, tree int, psi int, node int, feat int, thr double, left int, right int, length double")
    rows = [(s, i, *map(float, rng.normal(size=2)), "clash") for s in ("a", "b", "no trees") for i in range(70)]
    rows.append(rows[0])  # a repeated row stays repeated
    pts = spark.createDataFrame(rows, "session_id string, id int, x double, y double, _rows string")
    got = ML.score_forest(pts, ML.forest_from_nodes(table), ["x", "y"], depth=ML.max_depth(40), chunk_rows=16).collect()
    assert len(got) == 141 and set(got[0].asDict()) == {"session_id", "id", "x", "y", "_rows", "Score"}
    c = float(ML.average_path_length(np.array([40]))[0])
    for r in got:
        total = 0.0
        for t in range(3):
            feat, thr, left, right, length = forest[r.session_id, t]
            at = 0
            while feat[at] >= 0:
                at = left[at] if (r.x, r.y)[feat[at]] < thr[at] else right[at]
            total += length[at]
        assert abs(r.Score - 2 ** (-total / 3 / c)) < 1e-12


def test_ranked_anomalies(spark):
    df = spark.createDataFrame([("s", "A", 1, False), ("s", "B", 2, True), ("r", "B", 1, True), ("r", "A", 9, False)], "session_id string, Driver string, LapNumber int, IsAnomaly boolean")
    got = sorted(ML.ranked_anomalies(df).collect(), key=lambda r: r.Position)
    assert [(r.Position, r.session_id, r.Driver) for r in got] == [(1, "r", "B"), (2, "s", "B"), (3, "r", "A"), (4, "s", "A")]
