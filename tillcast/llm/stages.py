"""The stages of the corpus pipeline: (spark, docs, sf_dir) → DataFrame.

Each takes all columns of its predecessor's documents and returns the columns of ``documents``, but for the
last, which returns digests of the encoded texts.  Null texts, empty tables and extra columns are as in the
operator that each one calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import bpe, langid, line_dedup, mixing, superminhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else c for c in COLUMNS])


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without a letter go."""
    return langid.keep_known(docs.select(*COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line nearly repeats; n_chars follows the text."""
    return _documents(line_dedup.dedup(docs.select(*COLUMNS)))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8)."""
    return superminhash.dedup(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows repeat."""
    return mixing.repeat(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document's ids and of the bytes they decode to."""
    return bpe.digests(docs).withColumnRenamed("id", "doc_id")
