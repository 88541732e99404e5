"""Exact running (expanding) quantiles per group.

Spark's ``percentile`` over an UNBOUNDED PRECEDING frame is exact but
re-sorts the growing frame for every row (quadratic per group).  Here rows
are shuffled by the group key, sorted, and streamed through Arrow: one
batch holds many groups, whose running quantiles come from one call of
pandas' skip-list (O(log n) per row, linear interpolation, NaN skipped), so
the cost of a small group is that of its rows.  Only a group that a batch
cuts is kept for the next one; a group is one store (one row per day), so
what is kept is bounded by the length of the history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.api.indexers import BaseIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions.percentiles import exact_percentiles  # noqa: F401  (used from here by the operators)


def running_quantiles(df: DataFrame, keys, order: str, value: str, probs: dict[str, float],
                      placed: bool = False) -> DataFrame:
    """Add one column per ``{name: q}``: quantile q of ``value`` over all rows up to and including this one.

    NULL / NaN values are skipped (pandas ``expanding().quantile``).  ``placed``: every group is already in one
    partition, as after ``repartition(*keys)``, so the rows aren't shuffled again.
    """
    keys = list(keys)
    names = list(probs)
    qs = [probs[n] for n in names]
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, T.DoubleType(), True) for n in names])

    class SinceGroupStart(BaseIndexer):  # in here, so that it is sent to the tasks with the function
        """Windows from the first row of a row's group up to the row itself."""

        def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
            return self.first, np.arange(1, num_values + 1, dtype=np.int64)

    def quantiles(rows: pa.Table, first: np.ndarray, n_old: int) -> pa.RecordBatch:
        """The rows from ``n_old`` on, with their quantiles; the rows before it were given out already."""
        vals = pd.Series(rows.column(value).cast(pa.float64()).to_numpy())
        roll = vals.rolling(SinceGroupStart(first=first), min_periods=1)  # skip-list in C, NaN skipped
        out = rows.slice(n_old)
        for n, q in zip(names, qs):
            found = roll.quantile(q, interpolation="linear").to_numpy()[n_old:]
            out = out.append_column(n, pa.array(found, pa.float64(), from_pandas=True))  # none seen yet: NULL, as a SQL window
        return out

    def run(batches):
        held, n_held = [], 0  # the last group's rows that were given out, needed by its later ones
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            new = np.zeros(rows.num_rows, dtype=bool)
            new[0] = True
            for k in keys:
                code = pc.dictionary_encode(rows.column(k).combine_chunks(), null_encoding="encode")
                code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
                code = code.indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            first = starts[np.cumsum(new) - 1].astype(np.int64)
            yield from quantiles(rows, first, n_held).to_batches()
            rest = rows.slice(int(starts[-1]))
            held, n_held = rest.combine_chunks().to_batches(), rest.num_rows

    rows = df if placed else df.repartition(*keys)
    return rows.sortWithinPartitions(*keys, F.col(order).asc_nulls_last()).mapInArrow(run, schema)


#: Rows of the (partition, group) counts up to which they are broadcast.
BROADCAST_RANK_ROWS = 500_000


def rank_within(df: DataFrame, group: str | None, order, out: str = "pct_rank", partitions: int | None = None,
                index_out: str | None = None) -> DataFrame:
    """Exact ``percent_rank`` (and optionally the 0-based position) of rows inside ``group`` ordered by
    ``order`` (a total order), without one task holding a group: rows are range-partitioned on
    (group, order), numbered inside each range partition, and shifted by the counts of the earlier
    partitions of the same group (a (partition, group) count table, broadcast only after a check of its
    size).  Without ``partitions`` the session's shuffle settings decide how many there are."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    order = list(order)
    if group is None:
        out_df = rank_within(df.withColumn("_g0", F.lit(0)), "_g0", order, out, partitions, index_out)
        return out_df.drop("_g0")
    from tillcast.session import cut_lineage

    from tillcast.operators.joins import maybe_broadcast

    ranged = df.repartitionByRange(*([partitions] if partitions else []), group, *order)
    # Range bounds are sampled from the input, whose order after a shuffle is not deterministic, so the
    # partitioned rows (with their partition id) are written once and both the local ranks and the
    # per-partition counts read that same copy.
    r = cut_lineage(ranged.withColumn("_pid", F.spark_partition_id()))
    local = r.withColumn("_lr", F.row_number().over(Window.partitionBy("_pid", group).orderBy(*order)) - 1)
    cnt = local.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("_c"))
    off = cnt.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tot = cnt.groupBy(group).agg(F.sum("_c").alias("_n"))
    off = off.join(tot, group).select("_pid", group, "_off", "_n")
    j = local.join(maybe_broadcast(off, BROADCAST_RANK_ROWS, materialize=True), ["_pid", group])
    rank = F.when(F.col("_n") > 1, (F.col("_off") + F.col("_lr")) / (F.col("_n") - F.lit(1))).otherwise(F.lit(0.0))
    j = j.withColumn(out, rank.cast("double"))
    if index_out:
        j = j.withColumn(index_out, (F.col("_off") + F.col("_lr")).cast("bigint"))
    return j.drop("_pid", "_lr", "_off", "_n")
