"""Language identification by word-first backoff.

Method
* Training: every labelled text is split into lower-cased runs of letters; word counts per language are
  added up in each task and then over the cluster. Character n-gram counts of each language come
  from its word counts (a word is padded with one space on both sides), so the text is read once.
* A word that the model knows is scored in each language by its log relative frequency. A word it does
  not know falls back to its n-grams of the greatest length of which the model knows one, the mean of
  their log relative frequencies standing for the word; then to the next shorter length, down to 1. Where a
  language lacks a word or n-gram that another has, it gets ``PENALTY`` below the rarest known entry.
* A text's score in a language is the mean over its words; the best language wins, ties to the smaller
  name. ``score`` is the softmax of the means at the winner, times the share of words the
  model could score.

The model holds up to ``MAX_WORDS`` words and up to ``MAX_GRAMS`` n-grams of each length; that bound is what makes it safe to
send to each task. If there are more, each language has an equal share of it for its own most frequent ones (what a language
does not need goes to the others), ties by entry, so that a frequent language does not displace a rare one's.

Defined results: null text or text without a letter gives ``und`` and 0.0, as does every text when
nothing was learned; a text whose letters the model has never seen gets the language of most words and 0.0; null languages are not learned from; repeated rows count as often as they occur.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tracekit.llm.common import forget_worker_state, release, settle, ship, slices

ship(__name__)

MAX_WORDS = 100_000
MAX_GRAMS = 20_000
LONGEST = 5
PENALTY = 2.0
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
COUNTED = 200_000  # distinct words a task holds before it hands on their counts, or scores anew


@dataclass
class Model:
    """Log frequencies as Arrow and NumPy columns, which are small on the driver; tasks look entries up in dictionaries."""

    languages: list[str]
    tables: list[tuple[pa.Array, np.ndarray]]  # entries and a row for each: of words, then of n-grams by length, from 1
    common: str | None = None  # the language of most words

    @cached_property
    def words(self) -> dict[str, list[float]]:
        return _lookup(*self.tables[0])

    @cached_property
    def grams(self) -> list[dict[str, list[float]]]:
        return [_lookup(*t) for t in self.tables[1:]]


def _lookup(entries: pa.Array, rows: np.ndarray) -> dict[str, list[float]]:
    return dict(zip(entries.to_pylist(), rows.tolist()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_worker_state()
    held: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                           pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    for part in slices(batches):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            held.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        if sum(map(len, held.values())) > COUNTED:
            yield out()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all labelled texts."""
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    return known.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, length: int) -> DataFrame:
    """(lang, gram, n) of one length, from word counts."""
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    last = F.length("word") + 3 - length
    at = F.explode(F.sequence(F.lit(1), last)).alias("at")
    return (words.where(last >= 1).select("lang", "n", padded.alias("p"), at)
            .select("lang", "n", F.substring("p", F.col("at"), F.lit(length)).alias("gram"))
            .where("gram <> ' '").groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def shares(sizes: dict[str, int], limit: int) -> dict[str, int]:
    """``limit`` dealt out evenly, to none more than its size."""
    out, left = {}, limit
    for i, (size, lang) in enumerate(sorted((n, x) for x, n in sizes.items())):
        out[lang] = min(size, left // (len(sizes) - i))
        left -= out[lang]
    return out


def _most_frequent(counts: DataFrame, entry: str, limit: int, languages: list[str]) -> pa.Table:
    """(entry, counts by language) of the most frequent entries of each language, at most ``limit`` together.

    The order within a language is that of relative frequency; nothing beyond the limit reaches the driver.
    """
    rows = counts.groupBy(entry).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    if counts.select(entry).distinct().count() > limit:
        sizes = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
        share = F.create_map(*(F.lit(x) for pair in shares(sizes, limit).items() for x in pair))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), entry))
        # the constant bound lets each task drop what cannot be among the first
        kept = counts.withColumn("rank", rank).where((F.col("rank") <= limit) & (F.col("rank") <= share[F.col("lang")]))
        rows = rows.join(kept.select(entry).distinct(), entry)
    every = F.array(*map(F.lit, languages)).cast("array<string>")
    return rows.select(F.col(entry).alias("entry"), F.transform(every, lambda x: F.coalesce(F.col("by")[x], F.lit(0))).alias("n")).orderBy("entry").toArrow()


def _log_table(rows: pa.Table, languages: list[str], totals: dict[str, int]) -> tuple[pa.Array, np.ndarray]:
    total = np.array([max(1, totals.get(x, 0)) for x in languages], np.float64)
    counts = pc.list_flatten(rows["n"]).to_numpy().astype(np.float64).reshape(rows.num_rows, len(languages))
    with np.errstate(divide="ignore"):
        logs = np.log(counts / total)
    floor = logs[np.isfinite(logs)].min(initial=0.0) - PENALTY
    return rows["entry"].combine_chunks(), np.where(np.isfinite(logs), logs, floor)


def train(docs: DataFrame, *, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, longest: int = LONGEST) -> Model:
    """Fit on all labelled rows of ``docs``. What reaches the driver is the bounded model."""
    words = settle(word_counts(docs))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals, key=lambda x: x.encode())
    tables = [_log_table(_most_frequent(words, "word", max_words, languages), languages, totals)]
    for length in range(1, longest + 1):
        counts = settle(gram_counts(words, length))
        sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        tables.append(_log_table(_most_frequent(counts, "gram", max_grams, languages), languages, sums))
    release(docs.sparkSession)
    return Model(languages, tables, max(languages, key=totals.get, default=None))


def score_word(model: Model, word: str) -> list[float] | None:
    """Log frequencies of one word by language; None if even its letters are unknown."""
    if (known := model.words.get(word)) is not None:
        return known
    padded = f" {word} "
    for length in range(min(len(model.grams), len(padded)), 0, -1):
        table = model.grams[length - 1]
        found = [v for i in range(len(padded) - length + 1) if (v := table.get(padded[i:i + length])) is not None]
        if found:
            return [sum(v) / len(found) for v in zip(*found)]
    return None


class Scorer:
    """Scores texts with a model, remembering the words of the texts before."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.scores = np.full((1 << 16, len(model.languages)), np.nan)

    def _new(self, word: str) -> int:
        if len(self.index) == len(self.scores):
            self.scores = np.concatenate([self.scores, np.full_like(self.scores, np.nan)])
        i = self.index[word] = len(self.index)
        if (s := score_word(self.model, word)) is not None:
            self.scores[i] = s
        return i

    def __call__(self, text: str | None) -> tuple[str, float]:
        if len(self.index) > COUNTED:
            self.index.clear()
            self.scores[:] = np.nan
        words = LETTERS.findall(text.lower()) if text is not None and self.model.languages else []
        if not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        at = [self.index[w] if w in self.index else self._new(w) for w in words]
        rows = self.scores[at]
        rows = rows[~np.isnan(rows[:, 0])]
        if not len(rows):
            return self.model.common, 0.0
        mean = rows.mean(0)
        best = int(mean.argmax())
        return self.model.languages[best], float(len(rows) / len(words) / np.exp(mean - mean[best]).sum())


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker_state()
        score = Scorer(Model(*shared.value))
        for part in slices(batches):
            out = [score(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                                             ["_row", "lang_pred", "score"])
    return run


def _identified(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker_state()
        score = Scorer(Model(*shared.value))
        for part in slices(batches):
            yield part.filter(pa.array([score(t)[1] > 0 for t in part.column("text").to_pylist()], pa.bool_()))
    return run


def _sent(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast((model.languages, model.tables, model.common))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row with ``lang_pred`` and ``score``; only the text is looked at."""
    shared = _sent(docs, model)
    rows = docs.select(F.struct(*keep).alias("_row"), "text")
    schema = T.StructType([rows.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(shared), schema).select("_row.*", "lang_pred", "score")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, in whose text the model finds a language."""
    return docs.mapInArrow(_identified(_sent(docs, model)), docs.schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """One third of the rows, by id, from which the query does not learn."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
