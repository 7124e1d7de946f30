import random

import pytest

from tracekit.llm import contamination

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def brute(docs, items, k=5, percent=80):
    out = []
    for d, t in docs:
        own = contamination.word_shingles(t, k)
        for i, x in set(items):
            want = contamination.word_shingles(x, k)
            n = len(want & own)
            if want and 100 * n >= percent * len(want):
                out.append((d, i, len(want), n))
    return sorted(out, key=str)


def cases():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 8, 30, 90])))) for i in range(40)]
    items += [(40, None), (41, ""), (42, items[3][1]), (3, items[3][1]), (None, "a null id has a text too")]
    docs = []
    for d in range(60):
        words = [word() for _ in range(rng.choice([5, 100, 4000]))]
        passage = rng.choice(items[:40])[1].split()
        if d % 3 == 0:
            words[len(words) // 2:len(words) // 2] = passage
        if d % 5 == 0:  # an edited passage, just inside or outside the threshold
            passage[len(passage) // 2] = "edited"
            words += [w.upper() for w in passage]
        docs.append((d, "\n ".join(words)))
    docs += [(60, None), (61, " "), (62, items[0][1]), (62, items[0][1]), (None, "x a null id has a text too")]
    return docs, items


@pytest.mark.parametrize("limit", [contamination.MAX_BROADCAST, 0])
def test_against_all_pairs(spark, limit):
    docs, items = cases()
    d = spark.createDataFrame([(*r, "x") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    got = contamination.contained_items(d, i, max_broadcast=limit).collect()
    want = brute(docs, items)
    assert len(want) > 15
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got), key=str) == want
    clean = contamination.uncontaminated(d, i, max_broadcast=limit)
    bad = {r[0] for r in want}
    assert sorted(map(str, clean.collect())) == sorted(map(str, d.where("true").rdd.filter(lambda r: r.doc_id not in bad).collect()))
    for limit in (limit,):
        assert contamination.contained_items(d.limit(0), i, max_broadcast=limit).count() == 0
        assert contamination.contained_items(d, i.limit(0), max_broadcast=limit).count() == 0


@pytest.mark.parametrize("limit", [contamination.MAX_BROADCAST, 0])
def test_rows_of_one_id_are_judged_by_their_texts(spark, limit):
    item = "one two three four five six seven"
    docs = [(None, "a clean text without an id"), (None, f"x {item} y"), (7, "clean"), (7, item), (8, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {tuple(r) for r in contamination.uncontaminated(d, i, max_broadcast=limit).collect()}
    assert got == {docs[0], docs[2], docs[4]}
