import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracekit.llm import lang_id

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", lang_id.held_out().alias("held_out"))
    model = lang_id.train(docs.where("not held_out"))
    got = lang_id.predict(docs, model, ("doc_id", "held_out", "lang")).where("held_out and lang is not null")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.95
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def brute(rows, text):
    """The method without bounds on the model, word by word."""
    words, langs = {}, sorted({x for x, t in rows if x is not None and t is not None})
    for x, t in rows:
        if x is not None and t is not None:
            words.setdefault(x, Counter()).update(lang_id.LETTERS.findall(t.lower()))
    tables = [words] + [{x: Counter() for x in words} for _ in range(lang_id.LONGEST)]
    for x, c in words.items():
        for w, n in c.items():
            for size in range(1, lang_id.LONGEST + 1):
                for i in range(len(w) + 3 - size):
                    if (g := f" {w} "[i:i + size]) != " ":
                        tables[size][x][g] += n
    floors = [min(math.log(n / c.total()) for c in t.values() for n in c.values()) - lang_id.PENALTY if any(t.values()) else 0 for t in tables]

    def value(level, entry):
        t = tables[level]
        if not any(entry in c for c in t.values()):
            return None
        return [math.log(t[x][entry] / t[x].total()) if t[x].get(entry) else floors[level] for x in langs]

    scores = []
    for w in lang_id.LETTERS.findall((text or "").lower()):
        v = value(0, w)
        for size in range(min(lang_id.LONGEST, len(w) + 2), 0, -1):
            if v is not None:
                break
            found = [f for i in range(len(w) + 3 - size) if (f := value(size, f" {w} "[i:i + size])) is not None]
            v = np.mean(found, axis=0).tolist() if found else None
        if v is not None:
            scores.append(v)
    return np.mean(scores, axis=0) if scores else None


def test_backoff_against_brute_force(spark):
    rows = [("en", "the cat and the hat"), ("en", "And this is the other"), ("de", "der Hund und die Katze"), ("fr", "le chat et la souris"),
            (None, "not learned from"), ("xx", None), ("en", "the cat and the hat"), ("de", "")]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = lang_id.train(df)
    assert model.languages == ["de", "en", "fr"]
    texts = ["the Katze", "hats", "qqq", "undie chats", "123 ½ _", None, "", "日本 the", "日本", "Привет, мир", "Thé", "x" * 100_000]
    got = lang_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        want = brute(rows, texts[r.doc_id])
        if want is None and any(c.isalpha() for c in texts[r.doc_id] or ""):  # letters that the model has never seen
            assert (r.lang_pred, r.score) == ("en", 0.0), texts[r.doc_id]
        elif want is None:
            assert (r.lang_pred, r.score) == ("und", 0.0), texts[r.doc_id]
        else:
            assert r.lang_pred == model.languages[int(want.argmax())], texts[r.doc_id]
    for w in ["the", "hats", "undie"]:
        assert np.allclose(lang_id.score_word(model, w), brute(rows, w))


def test_edges(spark):
    empty = spark.createDataFrame([], "lang string, text string, doc_id long")
    model = lang_id.train(empty)
    rows = spark.createDataFrame([("en", "some text", 1, "clash"), (None, None, 2, "clash")], "lang string, text string, doc_id long, lang_pred string")
    assert [tuple(r) for r in lang_id.predict(rows, model).collect()] == [(1, "und", 0.0), (2, "und", 0.0)]
    assert lang_id.predict(empty, model).count() == 0
    kept = lang_id.identified(rows, lang_id.train(rows))
    assert kept.columns == rows.columns and [r.doc_id for r in kept.collect()] == [1]


def test_rare_language_keeps_its_share(spark):
    rng = np.random.default_rng(4)

    def word(letters):
        return "".join(rng.choice(list(letters), 7))

    rare = [word("aeioubdfg") for _ in range(40)]
    rows = [("en", " ".join(word("aeioustrn") for _ in range(400))) for _ in range(5)] * 3 + [("xx", " ".join(rare))]
    model = lang_id.train(spark.createDataFrame(rows, "lang string, text string"), max_words=100, max_grams=200)
    assert set(rare) <= set(model.words) and len(model.words) == 100 and all(len(t) <= 200 for t in model.grams)
    got = lang_id.predict(spark.createDataFrame([(i, w) for i, w in enumerate(rare)], "doc_id long, text string"), model).collect()
    assert all(r.lang_pred == "xx" for r in got)
    assert lang_id.shares({"a": 3, "b": 90, "c": 50}, 100) == {"a": 3, "c": 48, "b": 49}
