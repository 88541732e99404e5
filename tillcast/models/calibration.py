"""Per-cluster isotonic calibration of interval positions, as step tables that an expression searches.

A cluster's fit sees one row per bin (at most ``CALIBRATION_BINS``), which come out of a mergeable aggregation.
Pooling adjacent violators is itself mergeable: blocks are (weight, mean) pairs, and pooling the blocks of two
neighbouring ranges again gives the fit of both.  A fit is two sorted arrays (bin centre, fitted position); rows
join their cluster's arrays and find their place by a binary search inside the array, so all clusters are
calibrated in one scan and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.quantiles import rank_within
from tillcast.operators import intervals as I
from tillcast.operators.joins import maybe_broadcast


def pool(blocks: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Merge neighbouring (weight, mean) blocks until the means ascend."""
    out: list[tuple[float, float]] = []
    for w, m in blocks:
        while out and out[-1][1] >= m:
            pw, pm = out.pop()
            w, m = w + pw, (w * m + pw * pm) / (w + pw)
        out.append((w, m))
    return out


def fit(binned: DataFrame, cluster: str = "store_cluster") -> DataFrame:
    """(cluster, centers, fitted): the isotonic fit of bin centre to mean position, one row per cluster."""
    def pav(key, pdf):
        import pandas as pd

        pdf = pdf.dropna().sort_values("bin_center", kind="mergesort")
        fitted = [m for w, m in pool([(1.0, y) for y in pdf["binned_position"]]) for _ in range(round(w))]
        return pd.DataFrame({cluster: [key[0]], "centers": [pdf["bin_center"].tolist()], "fitted": [fitted]})

    kind = binned.schema[cluster].dataType.simpleString()
    rows = binned.select(cluster, F.col("bin_center").cast("double"), F.col("binned_position").cast("double")).where(F.col(cluster).isNotNull())
    return rows.groupBy(cluster).applyInPandas(pav, f"{cluster} {kind}, centers array<double>, fitted array<double>")


def last_at_most(xs: Column, x: Column, bits: int = 7) -> Column:
    """0-based place of the last element of the ascending array that is <= x, -1 without one (< 2 ** bits elements)."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(-1), lambda at, step: F.when(F.get(xs, at + step) <= x, at + step).otherwise(at))


def interpolate(xs: Column, ys: Column, x: Column) -> Column:
    """Linear between the table's points, constant beyond its ends; null for a null table or x."""
    def at(i: Column) -> Column:
        x0, y0, x1, y1 = F.get(xs, i), F.get(ys, i), F.get(xs, i + 1), F.get(ys, i + 1)
        return F.when(i < 0, F.get(ys, F.lit(0))).when(x1.isNull(), y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))

    place = F.transform(F.array(last_at_most(xs, x)), at)  # the place is found once
    return F.when(xs.isNotNull() & x.isNotNull(), F.get(place, F.lit(0)))


def cluster_stats(df: DataFrame, y: str = "revenue", cluster: str = "store_cluster") -> DataFrame:
    inside = ((F.col(y) >= F.col("p10")) & (F.col(y) <= F.col("p90"))).cast("double")
    return df.groupBy(cluster).agg(F.avg("uncertainty").alias("mean_uncertainty"),
                                   F.stddev_pop("uncertainty").alias("std_uncertainty"),
                                   F.avg(inside).alias("coverage_rate"))


def apply(df: DataFrame, models: DataFrame, cluster: str = "store_cluster") -> DataFrame:
    """Normal band of the uncertainty, re-shaped by the cluster's isotonic map of the row's position
    (percent rank of p50 inside its cluster); unknown clusters keep the raw band."""
    raw = rank_within(I.normal_band(df), cluster, ["p50", "store", "date"], out="bin_center")
    out = raw.join(maybe_broadcast(models, materialize=True), cluster, "left")
    out = out.withColumn("calibrated_position", interpolate(F.col("centers"), F.col("fitted"), F.col("bin_center")))
    width, pos = F.col("p90") - F.col("p10"), F.col("calibrated_position")
    return out.withColumns({
        "p10": F.when(pos.isNull(), F.col("p10")).otherwise(F.col("p50") - pos * width),
        "p90": F.when(pos.isNull(), F.col("p90")).otherwise(F.col("p50") + (F.lit(1.0) - pos) * width),
    }).drop("bin_center", "centers", "fitted")
