"""Connected components of an edge table by alternating large-star and small-star steps.

The small-star step is done by tasks that hold all edges of their larger ends: what hangs together in a task becomes one
star, which is at least as much.  So a larger end has an edge a task at most, whatever its degree, and no task holds a
hub; the large-star step joins written tables, so adaptive execution can split the rows of one.  Nothing but two flags
and a number per round reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import lean, materialize

#: Edges that a task makes into stars at once, and those it has in expectation in all rounds but the first.
EDGES = 1 << 20
TASK_EDGES = 1 << 16


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (v, smallest id of its component) that connect what the edges (a, b) connect."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    v = np.flatnonzero(root < np.arange(len(ids)))
    return ids[v], ids[root[v]]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Stars (see ``stars``) of the edges in each task, which has all those of a larger end ``a``."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
            n += batch.num_rows
            if n >= EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*held)))], ["a", "b"])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*held)))], ["a", "b"])

    return materialize(edges.select("a", "b").repartition(parts, "a").mapInArrow(lean(run), "a bigint, b bigint"), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a, b: bigint); component is the smallest id reachable.

    Null ends and loops are ignored; repeated edges count once; an empty table gives an empty one."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = _contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), parts)
    while True:
        low = materialize(e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        large = e.join(low.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        large = materialize(large, "large")
        # Stars only: every vertex has one edge to a smaller one, which has none.
        n, moved = large.agg(F.count(F.lit(1)), F.max("moved")).first()
        if not moved and not (low.agg(F.max("n")).first()[0] or 0) > 1:
            break
        e = _contracted(large, -(-n // TASK_EDGES))
    leaves = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
