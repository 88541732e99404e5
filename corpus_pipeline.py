"""The corpus pipeline: STAGES applied to the documents table one after the other.

Each stage takes (spark, docs, sf_dir), reads all its predecessor kept, and returns a DataFrame; the next
stage reads what was written as Parquet in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillcast.llm.common import input_table, materialize
from tillcast.llm.stages import dedup_documents, dedup_lines, drop_unknown_languages, mix_sources, tokenize

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", drop_unknown_languages),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The stages fit classifiers, hash and encode; SQL can't express them.  tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = input_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
