"""From raw documents to packed training sequences, in five stages.

Each stage is a function of ``(spark, docs, sf_dir)`` and works on everything its
predecessor kept; its result is written as Parquet and read again.  All stages but
the last return the columns of ``documents``.

All stages share the executors, whose memory rarely shrinks again: the JVMs' heaps stay as
large as the largest stage made them, and the workers are used again with all they hold.
So every stage hands small batches to its workers, and they remember little.
"""

from __future__ import annotations

import public_tokenizers as tokenizer_files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.llm.langid import keep_identified, train_language_model
from urbanframe.llm.near_duplicates import keep_one_of_each
from urbanframe.llm.packing import pack_sequences
from urbanframe.llm.quality import keep_quality
from urbanframe.llm.queries import held_out
from urbanframe.llm.substrings import cut_repeated_passages
from urbanframe.session import materialize, small_batches

REMEMBERED = 200_000  # words whose ids a worker keeps: it goes on to other stages and keeps them


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and blank texts are rejected, repeated rows stay repeated."""
    small_batches(spark)
    return keep_quality(docs, "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; without any labelled document none can.

    Null texts and texts without a letter go; repeated rows stay repeated.
    """
    small_batches(spark)
    net = train_language_model(docs, "doc_id", "text", "lang", ~held_out())
    return keep_identified(docs, "text", net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id (nulls last).

    Texts without words are one class; of rows that repeat one stays.
    """
    small_batches(spark)
    return keep_one_of_each(docs, "doc_id", "text")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated 35-word windows.

    A changed text is its kept words joined by one space (empty if none is left);
    other texts stay as they are.  ``n_chars`` follows the text.
    """
    small_batches(spark)
    cut = cut_repeated_passages(docs, "doc_id", "text")
    if "n_chars" not in cut.columns:
        return cut
    kind = cut.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed as often as they occur.
    """
    small_batches(spark)
    path = tokenizer_files.path("byte_bpe_50k.json")
    return pack_sequences(docs, "doc_id", "text", path, end_id=0, capacity=2048, remembered=REMEMBERED)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

# a trained network, sketches and a linear program are not expressible in SQL;
# tests/llm/test_pipeline.py compares every stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
