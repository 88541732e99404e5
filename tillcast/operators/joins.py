"""Dimension joins with an explicit size check before broadcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension is broadcast only when it provably has at most this many rows;
# beyond it the join stays a shuffle join (AQE may still convert it at run
# time from the measured shuffle size).
BROADCAST_MAX_ROWS = 2_000_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    ``limit(max_rows + 1).count()`` stops reading once the bound is passed,
    so the check costs at most max_rows + 1 rows even on a huge table.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, materialize: bool = False) -> DataFrame:
    """Broadcast ``df`` only if it provably has ≤ ``max_rows`` rows.

    ``materialize=True`` is for tables *derived from the fact* (group statistics, encodings, quantile
    brackets): they are written once with a reliable checkpoint, the bound is checked on the written copy
    and the join reads that copy, so the fact pipeline behind them runs once instead of twice."""
    if materialize:
        from tillcast.session import cut_lineage

        df = cut_lineage(df)
    return F.broadcast(df) if is_small(df, max_rows) else df


def join_store(sales: DataFrame, stores: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """sales ⟕ stores on store = id (stores without a row keep NULL attributes)."""
    dim = maybe_broadcast(stores.withColumnRenamed("id", "store"), max_rows)
    return sales.join(dim, on="store", how="left")


def join_small_literal(df: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Join with a dimension whose size is fixed by construction (calendar, weekdays, 1-row stats)."""
    return df.join(F.broadcast(dim), on=on, how=how)
