"""Shuffles whose number of partitions follows the rows, so that no task's memory grows with the table.

The session's number of shuffle partitions is fixed, and adaptive execution only merges partitions.  Behind such a
shuffle a task sorts or aggregates a share of the table that grows with it, and spills once that exceeds its memory."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task of a dealt table sorts or aggregates, in expectation.
ROWS_PER_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` with equal keys in one partition: one partition per ROWS_PER_TASK of its ``rows``, and one per core at
    least.  Windows and groups by the keys (and further columns) need no other shuffle."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    return df.repartition(n, *keys)
