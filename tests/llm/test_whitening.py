import math
import random

import numpy as np
import pytest

from tracekit.llm import bidiagonal, whitening
from tracekit.llm.queries import Q

SCHEMA = "vec_id long, embedding array<float>, dim string, x int"


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, k=4):
    """{(vec_id, component, deviation): [(n, whitened, explained)]}, by numpy's eigenvectors; the sign as the operator's."""
    quantised = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if usable(v)]
    out = []
    for dim in sorted({len(x) for _, x in quantised if len(x)}):
        own = [(i, x) for i, x in quantised if len(x) == dim]
        fit = sorted({x for _, x in own})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        y = np.array([[float(n * c - t) / n for c, t in zip(x, s)] for x in fit])
        _, sv, vt = np.linalg.svd(y, full_matrices=False)
        e, trace = sv ** 2 / n, (y ** 2).sum() / n
        for j in range(min(k, len(e))):
            if sv[j] <= max(n, dim) * 1e-14 * sv[0] or sv[0] == 0:
                continue
            v = vt[j] * np.sign(vt[j][np.abs(vt[j]).argmax()])
            for i, x in own:
                z = np.array([float(n * c - t) / n for c, t in zip(x, s)])
                out.append((i, j + 1, n, sum((n * c - t) ** 2 for c, t in zip(x, s)), float(z @ v / math.sqrt(e[j])), e[j] / trace))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in whitening.whitened(df, **options).collect()), key=lambda r: (r[0] is not None, r))


def check(got, want):
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], rtol=1e-8, atol=1e-8)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9) and all(r[6] <= 1e-9 for r in got)


def test_against_singular_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 7)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(150)] + [(5, rows[5][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, [None] * 6), (2002, [math.nan] * 6), (2003, [-math.inf] * 6), (2004, [])]
    rows += [(3000 + i, [rng.random(), rng.random()]) for i in range(40)] + [(4000, [1.0] * 9), (4001, [1.0] * 9)]
    check(run(spark, rows), brute(rows))


def test_rank_and_extremes(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]
    check(run(spark, line), brute(line))
    large = [(i, [float(2 ** 52 * (i % 5)), float(-(i ** 2))]) for i in range(12)]
    got, want = run(spark, large, components=1), brute(large, 1)
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == [r[3] if r[3] < 2**63 else None for r in want]
    assert run(spark, []) == [] and run(spark, [(1, [1.0, 2.0])]) == [] and run(spark, [(1, None)]) == []


def test_models_in_packs(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PACK", 12)
    rng = random.Random(4)
    rows = [(d * 100 + i, [rng.gauss(0, 1) for _ in range(d)]) for d in (1, 2, 3, 5) for i in range(20)]
    check(run(spark, rows, components=2), brute(rows, 2))


def test_whole_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in Q["op13_whitening"](spark, sf).collect())
    assert len(got) == 4 * len(rows)
    check(got, brute(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["random", "graded", "equal", "zero columns", "low rank", "zero", "diagonal", "reversed"])
def test_singular_values_and_vectors(n, kind):
    rng = np.random.default_rng(n)
    m = rng.standard_normal((3 * n, n))
    if kind in ("graded", "reversed"):
        m = m * 10.0 ** (-np.arange(n) / 4)[::1 if kind == "graded" else -1]
    elif kind == "equal":
        m = np.linalg.qr(m)[0] * 3
    elif kind == "zero columns":
        m[:, ::2] = 0
    elif kind == "low rank":
        m = m[:, :1] * np.arange(n)
    elif kind == "zero":
        m = m * 0
    elif kind == "diagonal":
        m = np.diag(np.repeat(rng.random(n), 2)[:n])
    r = np.linalg.qr(m, mode="r")
    a, b, turned = bidiagonal.bidiagonal(r)
    assert np.allclose(turned.T @ turned, np.eye(n), atol=1e-12)
    want = np.linalg.svd(m, compute_uv=False)
    top = max(want[0], 1e-30)
    assert np.allclose(np.sqrt(np.abs(bidiagonal.squared_values(a, b))), want, rtol=1e-10, atol=1e-12 * top)
    k = min(4, n)
    values, found = bidiagonal.leading(r, k)
    if kind == "zero":
        return
    solid = np.sqrt(values) > 1e-9 * top
    found, values = found[solid], values[solid]
    assert np.allclose(found @ found.T, np.eye(len(found)), atol=1e-10)
    assert np.abs(m.T @ (m @ found.T) - found.T * values).max(initial=0) <= 1e-11 * top ** 2


def test_values_to_high_relative_accuracy():
    """dqds keeps the digits of values that are tiny beside the greatest."""
    a, b = 10.0 ** -np.arange(0.0, 40.0, 4), np.full(9, 1e-60)
    assert np.allclose(np.sqrt(bidiagonal.squared_values(a, b)), a, rtol=1e-14)
