"""Corpus pipeline: language ID, near-dedup, decontamination, source mix, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracekit.llm import contamination, lang_id, mix, near_dedup, token_files
from tracekit.llm.common import table
from tracekit.llm.queries import tokenizer_file
from tracekit.session import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which the model finds no language (null, no letters, nothing it can score)."""
    return lang_id.identified(docs, lang_id.train(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates, and one row of each repeated (doc_id, text).

    Rows without an id are in no group and stay; different texts under one kept id stay; columns besides doc_id and text
    only decide which of several repeated rows stays (the least).
    """
    judged = near_dedup.near_duplicates(docs)
    gone = judged.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    again = judged.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    if again.isEmpty():
        return left.select(*docs.columns)
    place = "_".join(["place", *docs.columns])  # no column has this name
    row = Window.partitionBy("doc_id", "text").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")])
    once = left.join(again, "doc_id", "left_semi").withColumn(place, F.row_number().over(row)).where(F.col(place) == 1)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item (80 % of its five-word shingles); null and empty texts contain none."""
    return contamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix asks for: not at all, once or twice.

    Null sources are a source; blank documents have no words and get their source's certain copies; repeated rows are rows.
    """
    return mix.mixed_documents(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns each document's digest, read back from them.

    Null texts are empty; the order is that of doc_id (null first), then text; columns besides doc_id and text are not read.
    """
    path = shared_dir(spark, f"tokens-{uuid.uuid4().hex}")
    token_files.write_token_files(docs, tokenizer_file(), path)
    return token_files.read_token_digests(spark, path)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("token_output", token_output)]

# The tokenizer and the trained language model have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = shared_dir(spark, f"pipeline-{uuid.uuid4().hex}/{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
