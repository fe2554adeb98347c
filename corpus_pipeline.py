"""The corpus pipeline: stages over documents, each written as Parquet and read again for the next.

Languages are identified and unknown ones go, lines that recur from other documents go, one document of each group of near
copies stays, documents that hold benchmark items go, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontaminate, language_id, line_templates, near_copies
from tallyloom.session import scratch_path, scratch_scope

#: Documents whose language is less certain are rejected.
MIN_LANGUAGE_SCORE = 0.5
VOCABULARY = "word_bpe_49k.json"

#: The stages can't be written in SQL: language models, fingerprints and token ids. The tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null texts, texts without a letter and doubtful ones go."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_identified(docs, model, MIN_LANGUAGE_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs from another; those of which only white space is left go. ``n_chars`` follows the text."""
    slim = line_templates.drop_recurring_lines(docs, count_col=None, drop_emptied=True)
    return slim.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else slim


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies: five-word shingles, a similarity of 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit integers) of each document."""
    encoded = bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY))
    return encoded.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near_copies),
    ("decontaminate", drop_benchmark),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The tables that a stage stores for itself go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
