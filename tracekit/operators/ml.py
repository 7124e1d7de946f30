"""Lap clustering and anomaly detection (ML1-ML4), one model per session, all sessions at once.

* ML2 standardisation: per-session mean / population std as an aggregate joined back.
* ML3 k-means: greedy k-means++ seeds by aggregates, then Lloyd steps. Groups of bounded size make all their steps in
  one job, one task each. Larger groups make ``BLOCK_STEPS`` steps in a job: the centroids travel as one row joined to
  their points (fan-out 1), a step's new centroids are one aggregate by group, and only the small centroid table is
  checkpointed, once a block. Either way triangle-inequality bounds spare the distances of points that stay where they are.
* ML4 isolation forest (Liu, Ting, Zhou 2008): per (session, tree) a sample of at most 256
  rows chosen by hash rank (deterministic under any partitioning, pre-filtered before the
  shuffle), trees grown in ``applyInPandas`` on those bounded groups. Rows are scored by the engine: bounded arrays of a
  session's rows meet one array of its trees, and higher-order functions walk the trees' nodes.
"""

from __future__ import annotations

import math
import sys
import warnings
import zlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from tracekit.operators.clean import complete_cases
from tracekit.operators.order import with_position
from tracekit.schemas import ANOMALY_FEATURES, CLUSTER_FEATURES, present
from tracekit.session import ensure_checkpoint_dir, materialize, settle

# The pandas functions below run in Python workers: ship this module by value so executors
# need no copy of the package (no py-files, any working directory).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAP_ID = ("session_id", "Driver", "LapNumber")
EULER_GAMMA = 0.5772156649015329


def lap_features(laps: DataFrame, features: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    """ML1: complete cases on the feature columns present (all columns kept)."""
    return complete_cases(laps, features)


def standardize(df: DataFrame, features: Sequence[str], *, by: Sequence[str] = ("session_id",),
                prefix: str = "z_") -> DataFrame:
    """ML2: z = (x - mean) / std_pop per group; zero variance divides by 1 (centred only)."""
    feats = present(df, features)
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in feats],
                                *[F.stddev_pop(c).alias(f"_s_{c}") for c in feats])
    j = df.join(stats, list(by))
    z = [((F.col(c) - F.col(f"_m_{c}")) /
          F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))).alias(f"{prefix}{c}")
         for c in feats]
    return j.select(*df.columns, *z)


def _d2(point: Sequence[str], centroid) -> F.Column:
    total = None
    for i, c in enumerate(point):
        term = (F.col(c) - centroid.getField(f"f{i}")) * (F.col(c) - centroid.getField(f"f{i}"))
        total = term if total is None else total + term
    return total


def assign_clusters(points: DataFrame, centroids: DataFrame, features: Sequence[str], *,
                    by: Sequence[str] = ("session_id",), out: str = "Cluster") -> DataFrame:
    """ML3b: nearest centroid (ties -> lower cluster id) for every point.

    ``centroids``: (by..., cluster, f0..f{k-1}) in the order of ``features``.
    """
    feats = list(features)
    packed = centroids.groupBy(*by).agg(F.collect_list(F.struct(
        "cluster", *[F.col(f"f{i}") for i in range(len(feats))])).alias("_cs"))
    j = points.join(packed, list(by))
    best = F.array_min(F.transform("_cs", lambda c: F.struct(_d2(feats, c).alias("d2"),
                                                             c.getField("cluster").alias("cluster"))))
    return j.withColumn(out, best.getField("cluster").cast("int")).drop("_cs")


def _hash01(*cols) -> F.Column:
    """Uniform [0, 1) number from a 64-bit hash of the columns."""
    h = F.xxhash64(*cols)
    return (F.abs(h % F.lit(1 << 52)).cast("double")) / float(1 << 52)


def _kmeans_plus_plus(pts: DataFrame, feats: Sequence[str], *, k: int, by: Sequence[str],
                      key: Sequence[str], seed: int) -> DataFrame:
    """Greedy k-means++ seeding per group: first centre by hash rank; each round draws
    2 + ln(k) candidates with probability proportional to D^2 (weighted pick = max of
    log(u) / D^2, one aggregate) and keeps the one that lowers the potential most (a second
    aggregate). Groups with fewer distinct points get fewer centres."""
    fcols = [F.col(c).alias(f"f{i}") for i, c in enumerate(feats)]
    trials = 2 + int(math.log(k)) if k > 1 else 1
    w = Window.partitionBy(*by).orderBy("_h", *key)
    cents = (pts.withColumn("_h", _hash01(*[F.col(c) for c in key], F.lit(seed)))
             .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
             .select(*by, F.lit(0).alias("cluster"), *fcols)).transform(materialize)
    ids = [F.col(c) for c in key]
    for r in range(1, k):
        packed = cents.groupBy(*by).agg(F.collect_list(F.struct(
            "cluster", *[F.col(f"f{i}") for i in range(len(feats))])).alias("_cs"))
        d2 = F.array_min(F.transform("_cs", lambda c: _d2(feats, c)))
        scored = pts.join(packed, list(by)).withColumn("_d2", d2).drop("_cs")
        picks = []
        for t in range(trials):
            u = F.greatest(_hash01(*ids, F.lit(seed), F.lit(r), F.lit(t)), F.lit(1e-300))
            picks.append(F.max_by(F.struct(*fcols), F.when(F.col("_d2") > 0, F.log(u) / F.col("_d2")))
                         .alias(f"_c{t}"))
        cand = scored.groupBy(*by).agg(*picks)
        cand = cand.select(*by, F.array(*[F.col(f"_c{t}") for t in range(trials)]).alias("_cand"))
        pot = scored.join(cand, list(by)).select(*by, F.posexplode("_cand").alias("_t", "_c"), "_d2", *feats)
        pot = pot.filter(F.col("_c").isNotNull()).groupBy(*by, "_t", "_c").agg(
            F.sum(F.least(F.col("_d2"), _d2(feats, F.col("_c")))).alias("_pot"))
        best = pot.groupBy(*by).agg(F.min_by("_c", F.struct("_pot", "_t")).alias("_p"))
        new = best.select(*by, F.lit(r).alias("cluster"), *[F.col(f"_p.f{i}") for i in range(len(feats))])
        cents = cents.unionByName(new).transform(materialize)
    return cents


BLOCK_STEPS = 5  # Lloyd steps of large groups in one job
LOCAL_ROWS = 100_000  # groups of at most so many points are settled by one task each, all in one job


MODEL_NUMBERS = 2_000_000  # centroid coordinates that are broadcast; larger models are joined


def _wide(centroids: DataFrame, k: int, n: int, by: Sequence[str]) -> DataFrame:
    """One row a group: coordinate i of centroid j as ``c<j>_<i>`` (null where a group has fewer centroids)."""
    return centroids.groupBy(*by).agg(*[F.max(F.when(F.col("cluster") == j, F.col(f"f{i}"))).alias(f"c{j}_{i}") for j in range(k) for i in range(n)])


def _square(feats: Sequence[str], j: int, model: str = "c") -> str:
    return " + ".join(f"(`{c}` - {model}{j}_{i}) * (`{c}` - {model}{j}_{i})" for i, c in enumerate(feats))


def _least(columns: Sequence[str]) -> str:
    return f"least({', '.join(columns)})" if len(columns) > 1 else columns[0]


def _nearest(k: int) -> str:
    """Number of the least of the squares _q0, _q1, ... (ties: the lower)."""
    least = _least([f"_q{j}" for j in range(k)])
    return f"CASE {' '.join(f'WHEN _q{j} = {least} THEN {j}' for j in range(k))} END"


def _near(points: DataFrame, model: DataFrame, feats: Sequence[str], k: int) -> DataFrame:
    """Points with the number of their nearest centroid (_at), their distance to it (_d) and to the second nearest (_d2)."""
    own = [f"`{c}`" for c in points.columns]
    rows = points.join(model, [c for c in points.columns if c in model.columns])
    rows = rows.selectExpr(*own, *[f"{_square(feats, j)} AS _q{j}" for j in range(k)]).selectExpr("*", f"{_nearest(k)} AS _at")
    others = _least([f"CASE WHEN _at <> {j} THEN _q{j} END" for j in range(k)])
    return rows.selectExpr(*own, "_at", f"sqrt({_least([f'_q{j}' for j in range(k)])}) AS _d", f"coalesce(sqrt({others}), double('Infinity')) AS _d2")


def _steps(near: DataFrame, start: DataFrame, feats: Sequence[str], k: int, by: Sequence[str], steps: int, tol: float, sent) -> DataFrame:
    """(by..., c<j>_<i>..., _done) after ``steps`` Lloyd steps from the centroids that ``near`` was made with, as one plan.

    A group's centroids stay as they are from the step on whose total squared shift is at most ``tol``. Expressions are
    SQL texts, which the engine takes in whole; as nested columns they would cost more time than the job.
    """
    n = len(feats)
    names, keys = [f"{j}_{i}" for j in range(k) for i in range(n)], [f"`{c}`" for c in by]
    move = lambda j: f"sqrt({' + '.join(f'(c{j}_{i} - b{j}_{i}) * (c{j}_{i} - b{j}_{i})' for i in range(n))}) AS _m{j}"
    most = f"greatest({', '.join(f'_m{j}' for j in range(k))})" if k > 1 else "_m0"
    own = f"CASE {' '.join(f'WHEN _at = {j} THEN _m{j}' for j in range(k))} END"
    # a little below what the triangle inequality allows, for rounding
    stays = f"_d + {own} < (_d2 - {most}) * (1 - 1e-9D) - 1e-12D AS _stays"
    kept = [f"{x}{y}" for x in "cb" for y in names] + ["_done"]
    means = [f"avg(CASE WHEN _now = {j} THEN `{c}` END) AS n{j}_{i}" for j in range(k) for i, c in enumerate(feats)]
    shift = " + ".join(f"coalesce((n{x} - c{x}) * (n{x} - c{x}), 0D)" for x in names)
    state = start.selectExpr(*keys, *[f"c{x}" for x in names], *[f"c{x} AS b{x}" for x in names], "false AS _done")
    for _ in range(steps):
        rows = near.join(sent(state.selectExpr("*", *map(move, range(k)))), list(by)).selectExpr("*", stays)
        rows = rows.selectExpr("*", *[f"CASE WHEN NOT _stays THEN {_square(feats, j)} END AS _q{j}" for j in range(k)])
        rows = rows.selectExpr("*", f"CASE WHEN _stays THEN _at ELSE {_nearest(k)} END AS _now")
        new = rows.groupBy(*by).agg(*map(F.expr, means + [f"first({x}) AS {x}" for x in kept]))
        new = new.selectExpr(*keys, *kept, *[f"CASE WHEN _done THEN c{x} ELSE coalesce(n{x}, c{x}) END AS n{x}" for x in names])
        state = new.selectExpr(*keys, *[f"n{x} AS c{x}" for x in names], *[f"b{x}" for x in names], f"_done OR ({shift}) <= {tol!r}D AS _done")
    return state.drop(*[f"b{x}" for x in names])


def kmeans(points: DataFrame, features: Sequence[str], *, k: int = 3, by: Sequence[str] = ("session_id",),
           key: Sequence[str] = LAP_ID, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """Per-group Lloyd k-means. Returns the centroid table (by..., cluster, f0..).

    A group is left out of later steps once its total squared centre shift is at most ``tol``
    (standardised data). Groups that have not converged after ``max_iter`` steps are reported by a warning.
    """
    feats = list(features)
    ensure_checkpoint_dir(points.sparkSession)
    pts = points.select(*dict.fromkeys([*by, *key, *feats])).persist(StorageLevel.MEMORY_AND_DISK)
    cents = _kmeans_plus_plus(pts, feats, k=k, by=by, key=key, seed=seed)
    return lloyd(pts, cents, feats, k=k, by=by, max_iter=max_iter, tol=tol)


def lloyd_group(x: np.ndarray, c: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, bool]:
    """(centroids, converged) of one group: a point's distances are computed anew only if its bounds do not tell the nearest.

    ``upper`` is at least the distance to the nearest centroid and ``lower`` at most that to any other; both
    move with the centroids (triangle inequality).
    """
    at, upper, lower = np.zeros(len(x), int), np.full(len(x), np.inf), np.zeros(len(x))
    for _ in range(max_iter):
        due = np.flatnonzero(~(upper < lower * (1 - 1e-9) - 1e-12))
        sq = ((x[due, None, :] - c[None]) ** 2).sum(axis=2)
        at[due] = sq.argmin(axis=1)
        two = np.sqrt(np.partition(np.column_stack([sq, np.full(len(due), np.inf)]), 1, axis=1)[:, :2])
        upper[due], lower[due] = two[:, 0], two[:, 1]
        n = np.bincount(at, minlength=len(c))
        sums = np.column_stack([np.bincount(at, x[:, i], minlength=len(c)) for i in range(x.shape[1])])
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        move = np.sqrt(((new - c) ** 2).sum(axis=1))
        c = new
        if (move ** 2).sum() <= tol:
            return c, True
        upper += move[at]
        lower -= move.max()
    return c, False


def _settled_groups(points: DataFrame, centroids: DataFrame, feats: Sequence[str], by: Sequence[str], max_iter: int, tol: float) -> DataFrame:
    """The centroids (and _done) of groups of bounded size after all their Lloyd steps: one job for all of them."""
    names = [f"f{i}" for i in range(len(feats))]

    def settle(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if p.empty or c.empty:
            return c.iloc[:0].assign(_done=True)
        c = c.sort_values("cluster")
        new, done = lloyd_group(p[list(feats)].to_numpy(float), c[names].to_numpy(float), max_iter, tol)
        return c.assign(**{f: new[:, i] for i, f in enumerate(names)}, _done=done)

    rows = points.select(*dict.fromkeys([*by, *feats]))
    schema = T.StructType([*centroids.schema.fields, T.StructField("_done", T.BooleanType())])
    return rows.groupBy(*by).cogroup(centroids.groupBy(*by)).applyInPandas(settle, schema)


def lloyd(points: DataFrame, centroids: DataFrame, features: Sequence[str], *, k: int, by: Sequence[str] = ("session_id",),
          max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """Lloyd steps from the given centroids (by..., cluster below k, f0..) until every group has converged.

    Releases the cache of ``points`` in the end.
    """
    feats, closed, left = list(features), [], max_iter
    centroids = centroids.select(*[F.col(c).alias(c) for c in centroids.columns])  # columns of their own, apart from the points'
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).transform(materialize)
    large = sizes.where(F.col("_n") > LOCAL_ROWS).select(*by)
    local = _settled_groups(points.join(large, list(by), "left_anti"), centroids, feats, by, max_iter, tol).transform(materialize)
    start = _wide(centroids.join(large, list(by), "left_semi"), k, len(feats), by).transform(materialize)
    groups = start.count()
    sent = F.broadcast if groups * k * len(feats) <= MODEL_NUMBERS else (lambda model: model)
    while groups and left > 0:
        near = _near(points.select(*dict.fromkeys([*by, *feats])), sent(start), feats, k).persist(StorageLevel.MEMORY_AND_DISK)
        state = _steps(near, start, feats, k, by, min(BLOCK_STEPS, left), tol, sent).transform(materialize)
        near.unpersist()
        left -= BLOCK_STEPS
        closed.append(state.where("_done"))
        start = state.where(~F.col("_done")).drop("_done")
        groups = start.count()
    groups += local.where(~F.col("_done")).select(*by).distinct().count()
    if groups:
        warnings.warn(f"k-means: {groups} groups have not converged in {max_iter} steps", stacklevel=3)
    closed.append(start.withColumn("_done", F.lit(False)))
    points.unpersist()
    each = F.array(*[F.struct(F.lit(j).alias("cluster"), *[F.col(f"c{j}_{i}").alias(f"f{i}") for i in range(len(feats))]) for j in range(k)])
    far = reduce(DataFrame.unionByName, closed).select(*by, F.explode(each).alias("_c")).where("_c.f0 is not null").select(*by, "_c.*")
    return local.drop("_done").unionByName(far)


def lloyd_step(points: DataFrame, centroids: DataFrame, features: Sequence[str], *,
               by: Sequence[str] = ("session_id",)) -> DataFrame:
    """One Lloyd step: (by..., cluster, f0..), the means of the points nearest to each centroid.
    Only groups that have centroids take part; a centroid without points has no row."""
    assigned = assign_clusters(points, centroids, features, by=by, out="cluster")
    return assigned.groupBy(*by, "cluster").agg(*[F.avg(c).alias(f"f{i}") for i, c in enumerate(features)])


def cluster_laps(laps: DataFrame, *, clusters: int = 3, features: Sequence[str] = CLUSTER_FEATURES,
                 by: Sequence[str] = ("session_id",), seed: int = 42, max_iter: int = 300) -> DataFrame:
    """ML3: k-means lap clusters per session on standardised features.

    Complete cases only; sessions with fewer than max(2, clusters) rows are left out;
    k = min(clusters, rows). Cluster numbers are relabelled by mean lap time (0 = fastest)
    so results do not depend on initialisation order.
    """
    feats = present(laps, features)
    data = settle(lap_features(laps, feats), "laps")  # every step below reads them
    n = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= max(2, clusters))
    data = data.join(n, list(by), "left_semi")
    z = standardize(data, feats, by=by)
    zf = [f"z_{c}" for c in feats]
    cents = kmeans(z, zf, k=clusters, by=by, seed=seed, max_iter=max_iter)
    labelled = assign_clusters(z, cents, zf, by=by, out="_c")
    order = (labelled.groupBy(*by, "_c").agg(F.avg("LapTimeSeconds").alias("_mean"))
             .withColumn("Cluster", (F.row_number().over(
                 Window.partitionBy(*by).orderBy("_mean", "_c")) - 1).cast("int")).transform(materialize))
    return labelled.join(order.drop("_mean"), [*by, "_c"]).select(*laps.columns, "Cluster")


# ---------------------------------------------------------------- isolation forest

def average_path_length(n: np.ndarray) -> np.ndarray:
    """c(n) of the isolation forest paper: expected path length of an unsuccessful BST search."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def max_depth(rows: int) -> int:
    return int(math.ceil(math.log2(max(rows, 2))))


def grow_tree(x: np.ndarray, rng: np.random.Generator, deepest: int):
    """Isolation tree as flat arrays (feature, threshold, left, right, length); leaves have feature -1.

    ``length``: the depth of the node plus the expected rest of a path among the rows that ended there.
    """
    feat, thr, left, right, size, level = [], [], [], [], [], []

    def node(idx: np.ndarray, depth: int) -> int:
        me = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx)); level.append(depth)
        if depth >= deepest or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        f = int(usable[rng.integers(usable.size)])
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        feat[me], thr[me] = f, t
        left[me] = node(idx[go_left], depth + 1)
        right[me] = node(idx[~go_left], depth + 1)
        return me

    node(np.arange(len(x)), 0)
    return feat, thr, left, right, (np.array(level) + average_path_length(np.array(size))).tolist()


TREES_PER_GROUP = 10
POOL = 32  # rows of a session from which trees draw, in samples of one tree
TREE_FIELDS = "tree int, psi int, feat array<int>, thr array<double>, left array<int>, right array<int>, length array<double>"


def forest_from_nodes(nodes: DataFrame, by: str = "session_id") -> DataFrame:
    """A forest (``by`` and ``TREE_FIELDS``) from a table of nodes (by, tree, psi, node, feat, thr, left, right, length).

    A tree's nodes are numbered 0, 1, ... from its root; inner nodes send a row to ``left`` if its feature number
    ``feat`` is below ``thr``, leaves have feat -1, and their ``length`` is the path length of the rows that end there.
    """
    node = F.sort_array(F.collect_list(F.struct("node", "feat", "thr", "left", "right", "length")))
    packed = nodes.groupBy(by, "tree").agg(F.max("psi").alias("psi"), node.alias("n"))
    return packed.select(by, "tree", "psi", *[F.col(f"n.{c}").alias(c) for c in ("feat", "thr", "left", "right", "length")])


def score_forest(points: DataFrame, forest: DataFrame, features: Sequence[str], *, by: str = "session_id", depth: int,
                 chunk_rows: int = 20_000) -> DataFrame:
    """Adds Score, 2 ** (-mean path length / c(psi)), to each row of a group that has trees; trees are ``depth`` deep at most.

    A group's rows meet in arrays of about ``chunk_rows`` with one copy of the group's trees for each array; the walk down the
    trees is a fold over ``depth`` steps within the engine.
    """
    feats = list(features)
    n = points.groupBy(by).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(float(chunk_rows)))).cast("int").alias("_chunks"))
    trees = forest.groupBy(by).agg(F.max("psi").alias("_psi"), F.sort_array(F.collect_list(F.struct("tree", "feat", "thr", "left", "right", "length"))).alias("_trees"))
    copies = trees.join(n, by).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    row = F.struct(F.array(*[F.col(c).cast("double") for c in feats]).alias("x"), F.struct(*points.columns).alias("row"))
    chunk = F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.col("_chunks")).cast("int")
    held = points.join(n, by).withColumn("_chunk", chunk).groupBy(by, "_chunk").agg(F.collect_list(row).alias("_rows"))

    def leaf(p: F.Column, t: F.Column) -> F.Column:
        def down(at: F.Column, _: F.Column) -> F.Column:
            f = F.get(t["feat"], at)
            return F.when(f < 0, at).when(F.get(p["x"], f) < F.get(t["thr"], at), F.get(t["left"], at)).otherwise(F.get(t["right"], at))
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down)

    length = lambda p: F.aggregate("_trees", F.lit(0.0), lambda a, t: a + F.get(t["length"], leaf(p, t)))
    psi = F.col("_psi").cast("double")
    usual = F.when(psi > 2, 2 * (F.log(psi - 1) + EULER_GAMMA) - 2 * (psi - 1) / psi).otherwise(F.lit(1.0))
    lengths = F.transform("_rows", lambda p: F.struct(p["row"].alias("row"), length(p).alias("total")))
    scored = held.join(copies, [by, "_chunk"]).select(F.size("_trees").alias("_n"), usual.alias("_c"), F.explode(lengths).alias("_p"))
    return scored.select("_p.row.*", F.pow(F.lit(2.0), -F.col("_p.total") / F.col("_n") / F.col("_c")).alias("Score"))


def anomaly_labels(scored: DataFrame) -> DataFrame:
    """Replaces Score by AnomalyScore (-1 anomaly, above 0.5, or 1 normal), IsAnomaly and Score."""
    label = F.when(F.col("Score") > 0.5, F.lit(-1)).otherwise(F.lit(1))
    return scored.select(*[c for c in scored.columns if c != "Score"], label.alias("AnomalyScore"), (label == -1).alias("IsAnomaly"), "Score")


def detect_anomalies(laps: DataFrame, *, features: Sequence[str] = ANOMALY_FEATURES,
                     by: str = "session_id", key: Sequence[str] = LAP_ID, trees: int = 100,
                     max_samples: int = 256, seed: int = 42, min_rows: int = 8,
                     chunk_rows: int = 20_000) -> DataFrame:
    """ML4: isolation-forest anomalies per session on complete cases (sessions with fewer than
    ``min_rows`` rows are left out). Adds AnomalyScore (-1 anomaly / 1 normal, as the
    reference labels), IsAnomaly and Score (2^(-E[h]/c(psi)); automatic cut at 0.5)."""
    feats = present(laps, features)
    ensure_checkpoint_dir(laps.sparkSession)
    data = settle(complete_cases(laps, feats), "laps")  # counted, drawn from and scored
    n = data.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).transform(materialize)
    data = data.join(n, by)

    # 1. a bounded pool for each session by one hash a row (POOL times psi rows, far more than one tree
    #    draws), then each tree's psi rows from the pool by a hash rank
    psi = F.least(F.col("_n"), F.lit(max_samples))
    pool = data.select(*dict.fromkeys([by, *key, *feats]), "_n").filter(
        _hash01(*[F.col(c) for c in key], F.lit(seed)) < F.lit(float(POOL)) * psi / F.col("_n"))
    t = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    t = t.withColumn("_u", _hash01(*[F.col(c) for c in key], F.col("tree"), F.lit(seed)))
    w = Window.partitionBy(by, "tree").orderBy("_u", *key)
    sample = t.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= psi)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        # one block of a session's trees: at most TREES_PER_GROUP x psi rows
        sid = pdf[by].iloc[0]
        out = []
        pdf = pdf.drop(columns=["_block"])
        for tree, sub in pdf.groupby("tree", sort=True):
            sub = sub.sort_values(list(key))
            rng = np.random.default_rng([seed, int(tree), zlib.crc32(str(sid).encode())])
            size_ = len(sub)
            f, th, le, ri, length = grow_tree(sub[list(feats)].to_numpy(float), rng, max_depth(size_))
            out.append((sid, int(tree), size_, f, th, le, ri, length))
        return pd.DataFrame(out, columns=[by, "tree", "psi", "feat", "thr", "left", "right", "length"])

    # the model (trees x <= 2 psi nodes per session) is trained once and kept in the shared
    # checkpoint folder; scoring then makes a single pass over the rows
    forest = (sample.select(*dict.fromkeys([by, "tree", *key, *feats]))
              .withColumn("_block", (F.col("tree") / F.lit(TREES_PER_GROUP)).cast("int"))
              .groupBy(by, "_block").applyInPandas(train, f"`{by}` {data.schema[by].dataType.simpleString()}, {TREE_FIELDS}").transform(materialize))

    # 2. the engine scores whole rows
    rows = data.select(*laps.columns)
    return anomaly_labels(score_forest(rows, forest, feats, by=by, depth=max_depth(max_samples), chunk_rows=chunk_rows))


def order_anomalies(df: DataFrame) -> DataFrame:
    """SL3: anomalies first (a sink-side sort)."""
    return df.orderBy(F.col("IsAnomaly").desc(), *LAP_ID)


def ranked_anomalies(df: DataFrame) -> DataFrame:
    """SL3 as a column: each row's Position, anomalies first."""
    return with_position(df, F.col("IsAnomaly").desc(), *[F.col(c) for c in LAP_ID])
