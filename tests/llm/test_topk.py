import math
import random

import numpy as np
import pytest

from tracekit.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, k=5, every=50):
    vecs = {}
    for i, v in rows:
        if i is not None and usable(v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            vecs[i] = min(vecs.get(i, q), q)
    out = []
    for q in vecs:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, **options).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "LISTED", 4)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(9)]) for i in range(700)]
    common = [rng.gauss(0, 2) for _ in range(9)]
    rows += [(1000 + i, common) for i in range(300)]  # one vector very often, ties in every list
    rows += [(3000, None), (3050, [None] * 9), (3100, [math.nan] * 9), (3150, [math.inf] + [0.0] * 8), (None, common), (50, rows[50][1]), (100, common)]
    rows += [(4000, [1.0, 2.0]), (4001, [3.0, -1.0]), (4050, []), (4100, []), (-50, common), (4200, [5.0])]
    assert run(spark, rows) == brute(rows)


def test_large_components(spark):
    rows = [(i, [float((-1) ** i * 10 ** (i % 9)), float(i), 1.0]) for i in range(60)]
    assert run(spark, rows, k=3, every=20) == brute(rows, 3, 20)


def test_whole_small_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_and_alone(spark):
    assert run(spark, []) == [] and run(spark, [(50, [1.0])]) == []
    assert run(spark, [(50, [1.0]), (51, [1.0])]) == [(50, 1, 51, 65536)]


@pytest.mark.parametrize("most", [2**10, 2**28, 2**45])
def test_products_are_exact(most):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-most, most, (4, 6)) for _ in range(2))
    want = [[max(-2**63, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(r, c)))) for c in b] for r in a]
    assert topk.products(a, b).tolist() == want
