import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracekit.llm import mix

SCHEMA = "doc_id long, text string, source string, size string, copies string"


def water(sizes, weights=(3, 1, 2), percent=150, ceiling=2):
    """Targets by pouring again and again until none is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    done, open_ = {}, set(order)
    while open_:
        left = percent * sum(sizes.values()) / 100 - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= ceiling * sizes[s]}
        if not over:
            return done | share
        done |= {s: float(ceiling * sizes[s]) for s in over}
        open_ -= over
    return done


def test_targets_and_words(spark):
    docs = [(i, " ".join(["w"] * (1 + i * 37 % 90)), f"s{i * i % 11}" if i % 13 else None, "", "") for i in range(3000)]
    docs += [(5000, None, "s1", "", ""), (5001, " ", "only blank", "", ""), (None, "a b", "s3", "", ""), (7, docs[7][1], docs[7][2], "", ""),
             (5002, "long " * 5000, "é", "", ""), (5003, "one", "zz", "", "")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = mix.mixture(df.drop("size", "copies")).collect()
    assert len(got) == len(docs)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        assert 0 <= r.copies <= 2
    want = water(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
    largest = {s: max(r.size for r in got if r.source == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], s
    again = mix.mixture(df.repartition(3).drop("size", "copies")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    rows = mix.mixed_documents(df)
    assert rows.columns == df.columns
    assert rows.count() == sum(r.copies for r in got)


def test_pareto_order(spark):
    """The cut equals the one of a plain sort by Pareto rank, also with unequal inclusion probabilities."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2], float(1 + i % 5)) for i in range(2000)], "doc_id long, text string, source string, q double")
    base, plan = mix.mix_plan(df, weight="q", percent=90)
    got = mix.apply_plan(base, plan)
    plans = {r.source: r for r in plan.collect()}
    assert abs(sum(r.taken for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()) - 0.9 * base.agg(F.sum("size")).first()[0]) <= 7
    rows = base.collect()
    for s, p in plans.items():
        assert math.isclose(sum(r.size * min(2, p._c * r._weight) for r in rows if r.source == s), p.target, rel_tol=1e-9)
        order, left = [], p.target
        for r in rows:
            if r.source == s:
                e = min(2.0, p._c * r._weight)
                left -= math.floor(e) * r.size
                frac = e - math.floor(e)
                if frac:
                    order.append((r._u / (1 - r._u) / (frac / (1 - frac)), r.doc_id, r.size))
        extra = set()
        for _, i, n in sorted(order):
            if 2 * left <= n:
                break
            extra.add(i)
            left -= n
        c = {r.doc_id: r._weight for r in rows}
        assert {r.doc_id: r.copies for r in got.where(F.col("source") == s).collect()} == {
            i: math.floor(min(2.0, p._c * c[i])) + (i in extra) for i in c if "ab"[i % 2] == s}


def test_unequal_odds_near_and_at_the_ceiling(spark):
    """Sources that are taken whole twice, nearly so, and once; long documents are taken more often than short ones."""
    rows = [(i, "w " * (150 if i % 3 else 20), s) for s, k in (("a", 40), ("b", 900), ("c", 300), ("d", 3)) for i in range(hash_start(s), hash_start(s) + k)]
    rows += [(90_000, None, "blank"), (90_001, " ", "blank")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("odds", mix.length_odds())
    got = mix.mixture(df, weight="odds").collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        assert 0 <= r.copies <= 2
    want = water(sizes)
    assert any(want[s] == 2 * sizes[s] > 0 for s in sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 150
        if want[s] == 2 * sizes[s] > 0:
            assert taken[s] == want[s]
    mean = lambda of: sum(r.copies for r in of) / len(of)
    free = [r for r in got if want[r.source] < 1.5 * sizes[r.source]]
    assert mean([r for r in free if r.size == 150]) > 1.3 * mean([r for r in free if r.size == 20])


def hash_start(source):
    return 1000 * ("abcd".index(source) + 1)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix.mixture(df).count() == 0 and mix.mixed_documents(df).count() == 0
    blank = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mix.mixture(blank).select("size", "source_size", "target", "copies").collect()] == [(0, 0, 0.0, 0)]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10}, {"a": 5}, {"a": 0, "b": 7, None: 9}])
def test_water(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: pytest.approx(r.target) for r in mix.targets(df).collect()} == water(sizes)
