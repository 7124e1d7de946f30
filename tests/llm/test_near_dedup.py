import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tracekit.llm import near_dedup
from tracekit.llm.components import components

SCHEMA = "doc_id long, text string, lang string, component_id string"


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    ids = sorted({i for i, _ in rows})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t, k)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in ids}


def check(spark, rows, k=3, percent=85):
    df = spark.createDataFrame([(i, t, "xx", "clash") for i, t in rows], SCHEMA)
    got = near_dedup.near_duplicates(df, k=k, percent=percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, k, percent)
    assert {r.doc_id: r.component_id for r in got} == want
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, len(shingle_set(t, k))) for i, t in rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def drifting(rng, n, words=80):
    """Near copies of near copies: most pairs are too far apart, the group hangs together by chains."""
    texts = [[f"w{rng.randrange(500)}" for _ in range(words)]]
    for _ in range(n - 1):
        t = list(rng.choice(texts[-20:]))
        t[rng.randrange(words)] = f"z{rng.randrange(10_000)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_chains_copies_and_edges(spark, monkeypatch):
    rng = random.Random(3)
    texts = drifting(rng, 60) + drifting(rng, 25, 200)
    texts += [texts[0]] * 5 + [texts[0].upper() + "  "] + [None, "", " \t\n", "one", "One", "one two", "a b c", "A b C", "b c a"]
    texts += [" ".join(f"u{rng.randrange(99999)}" for _ in range(9000))] * 2
    rng.shuffle(texts)
    monkeypatch.setattr(near_dedup, "PACK", 500)
    monkeypatch.setattr(near_dedup, "SHARD", 10)
    check(spark, list(enumerate(texts)))


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d", None, None), (1, "a b c d", None, None), (None, "a b c d", None, None), (None, None, None, None)], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, k=3).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True), (None, 2, None, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_whole_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)
    check(spark, rows, 5, 80)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60))
def test_min_max_signature(values):
    s = np.array(sorted(values), np.uint64)
    sig = near_dedup.min_max_signature([s, s[:1]], 8)
    mult, add = near_dedup._functions(8)
    for i in range(8):
        h = [(int(v) * int(mult[i]) + int(add[i])) % 2**64 for v in values]
        assert (int(sig[0, i]), int(sig[0, 8 + i])) == (min(h), max(h))
    assert (sig[1, :8] == sig[1, 8:]).all()


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 1300, dtype=np.uint64)
    sig = near_dedup.min_max_signature([np.sort(pool[:1000]), np.sort(pool[300:])], 400)
    assert abs((sig[0] == sig[1]).mean() - 700 / 1300) < 0.07


@pytest.mark.parametrize("n", [2, 40])
def test_components(spark, n):
    rng = random.Random(n)
    edges = [(i, i + 1) for i in range(100, 100 + n)] + [(5, 9), (9, 5), (7, 7), (None, 3)] + [(1000, 1000 + rng.randrange(1, 50)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 101 + n)} | {5: 5, 9: 5} | {x: 1000 for e in edges[-60:] for x in e}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
