import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_contamination import brute as brute_contained
from tests.llm.test_mix import water
from tests.llm.test_near_dedup import brute as brute_components
from tracekit.llm.queries import Q, tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that each stage gets and returns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.first()
    extra = [(9001, None, "en", "src1", 0), (9002, "12345 *** ???", None, "src1", 5), (9003, "", "en", None, 0), (9004, "\t\n", None, None, 2),
             (9005, some.text + " tail", None, None, 1), tuple(some), tuple(some), (9006, "one", "en", "src2", 3), (None, "a text without any id at all", "en", "src2", 9)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = tempfile.mkdtemp() + "/" + name
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "token_output"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert all(a.count() > 0 for a in stages)


def test_language_id_keeps_all_text_with_letters(stages):
    want = [r for r in rows(stages[0]) if r[1] and any(c.isalpha() for c in r[1])]
    assert Counter(rows(stages[1])) == Counter(want)


def test_near_dedup(stages):
    before, after = rows(stages[1]), rows(stages[2])
    component = brute_components([(r[0], r[1]) for r in before if r[0] is not None], 5, 80)
    assert sorted(r[0] for r in after if r[0] is not None) == sorted(set(component.values()))
    assert set(after) <= set(before) and sum(r[0] is None for r in after) == 1


def test_decontaminate(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, *_ in brute_contained([(r[0], r[1]) for r in rows(stages[2])], items)}
    assert Counter(rows(stages[3])) == Counter(r for r in rows(stages[2]) if r[0] not in bad) and bad


def test_mix(stages):
    before, after = rows(stages[3]), Counter(rows(stages[4]))
    size = lambda r: len((r[1] or "").split())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r[3]] += size(r)
    for r, n in after.items():
        assert r in before and n <= 2
        taken[r[3]] += n * size(r)
    for s, want in water(sizes).items():
        assert abs(taken[s] - want) <= max(size(r) for r in before if r[3] == s)


def test_token_output(stages):
    whole = Tokenizer.from_file(tokenizer_file())
    want, start = [], 0
    for r in sorted(rows(stages[4]), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = whole.encode(r[1], add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert Counter(rows(stages[5])) == Counter(want)


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()
    assert {n.partition("_")[0] for n in Q} == {f"op{i}" for i in range(1, 14)}
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_take_an_empty_table(spark, stages):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages[0].limit(0), SF).count() == 0
