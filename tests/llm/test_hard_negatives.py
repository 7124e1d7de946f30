import math
import random

import numpy as np
import pytest

from tracekit.llm import hard_negatives, hilbert
from tracekit.llm.queries import Q

SCHEMA = "vec_id long, label int, embedding array<float>, dim int, block string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, every=100, n_pos=5, n_neg=5):
    of = {}
    for i, label, v in rows:
        if i is not None and label is not None and usable(v):
            x = (label, [math.floor(256 * float(np.float32(c))) for c in v])
            of[i] = min(of.get(i, x), x)
    out = []
    for a, (label, v) in of.items():
        if a % every == 0:
            scores = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, other) for i, (other, w) in of.items() if i != a and len(w) == len(v))
            for p, pos, _ in [s for s in scores if s[2] == label][:n_pos]:
                hits = [s for s in scores if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:n_neg]
                out += [(a, pos, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(hits)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, **options).collect())


def test_against_brute_force(spark, monkeypatch):
    for name, size in (("BLOCK", 64), ("CHUNK", 3), ("PAGE", 4), ("NUMBERS", 600)):
        monkeypatch.setattr(hard_negatives, name, size)
    rng = random.Random(9)
    rows = [(i, rng.randrange(4), [rng.gauss(i % 3, 1) for _ in range(9)]) for i in range(900)]
    common = [rng.gauss(0, 2) for _ in range(9)]
    rows += [(1000 + i, i % 3, common) for i in range(450)]  # one vector very often, ties in every list
    rows += [(3000, 1, None), (3100, 1, [None] * 9), (3200, 1, [math.nan] * 9), (3300, None, common), (None, 1, common), (100, *rows[100][1:]), (200, 0, common)]
    rows += [(4000, 1, [1.0, 2.0]), (4001, 2, [3.0, -1.0]), (4002, 1, [3.0, 1.0]), (4100, 1, []), (4101, 1, []), (4102, 2, []), (-100, 2, common), (-300, 1, [5.0])]
    want = brute(rows)
    assert len(want) > 100 and run(spark, rows) == want


def test_many_labels_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    rng = random.Random(10)
    rows = [(i, i // 3, [rng.gauss(3, 1) for _ in range(4)]) for i in range(400)]
    assert run(spark, rows) == brute(rows)
    rows = [(i, i % 2, [float((-1) ** i * 10 ** (i % 9)), float(i), 1.0]) for i in range(60)]
    assert run(spark, rows, anchors_every=20, positives=3, negatives=2) == brute(rows, 20, 3, 2)


def test_empty_and_alone(spark):
    assert run(spark, []) == [] and run(spark, [(100, 1, [1.0])]) == [] and run(spark, [(100, 1, [1.0]), (101, 2, [1.0])]) == []
    assert run(spark, [(100, 1, [1.0]), (101, 1, [1.0]), (7, 2, [0.9])]) == [(100, 101, 1, 7, 65536, 256 * 230)]


def test_whole_small_table(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in Q["op12_hard_negatives"](spark, "/root/testdata/sf0.001").collect()) == brute(rows)


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 4), (3, 3), (4, 2), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = [k.tobytes() for k in hilbert.position(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("most", [2**8, 2**29, 2**55])
def test_bounds_hold(most):
    rng = np.random.default_rng(5)
    a, v = (rng.integers(-most, most, (n, 5)) for n in (4, 40))
    low, high = hard_negatives.bounds(a, v.min(axis=0)[None], v.max(axis=0)[None])
    for i, x in enumerate(a):
        scores = [max(-2**63, min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(x, y)))) for y in v]
        assert low[i, 0] <= min(scores) and max(scores) <= high[i, 0]


def test_zone_maps_leave_blocks_unread():
    """Anchors of one cluster do not read blocks of clusters whose scores are out of their windows."""
    import pyarrow as pa

    a = np.array([[100, 0], [0, 100]])
    chunk = {"dim": [2], "q_id": [[1, 2]], "q_label": [[0, 0]], "q_data": [a.ravel().tolist()], "q_low": [[5000, 5000]], "q_high": [[10**6, 10**6]], "q_done": [[-1, -1]],
             "z_block": [[10, 11, 12]], "z_label_lo": [[1, 1, 0]], "z_label_hi": [[1, 2, 0]], "z_lo": [[90, 0, 0, 90, 90, 90]], "z_hi": [[110, 5, 5, 110, 99, 99]]}
    types = {c: pa.list_(pa.int64()) for c in chunk} | {"dim": pa.int32()}
    batch = pa.RecordBatch.from_pydict({c: pa.array(v, types[c]) for c, v in chunk.items()})
    reads = [(b.column("block")[0].as_py(), b.column("q_id")[0].as_py()) for b in hard_negatives._needed(False, False)([batch])]
    assert reads == [(10, [1]), (11, [2])]  # block 12 holds only the anchors' own label
