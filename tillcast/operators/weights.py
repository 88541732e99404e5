"""§2.8 training weights as columns (never positional arrays).

Global statistics (max date, 95th percentile, means, sums) are 1-row
aggregates cross-joined back; the weight of a row is a column expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.quantiles import exact_percentiles


def _age(df: DataFrame, date: str = "date") -> DataFrame:
    mx = df.agg(F.max(date).alias("_maxd"))
    return df.crossJoin(F.broadcast(mx)).withColumn("_age", F.datediff(F.col("_maxd"), F.col(date)))


def weights_blend(df: DataFrame, value: str = "revenue") -> DataFrame:
    """0.6·normalised 1/(1+log1p(age)) + 0.4·normalised log1p(min(rev, p95)), rescaled to mean 1."""
    d = _age(df)
    p95 = exact_percentiles(df, value, [0.95]).select(F.col("q0").alias("_p95"))
    d = d.crossJoin(F.broadcast(p95))
    d = d.withColumn("_td", F.lit(1.0) / (F.lit(1.0) + F.log1p(F.col("_age").cast("double"))))
    d = d.withColumn("_lw", F.log1p(F.least(F.col(value), F.col("_p95"))))
    m = d.agg(F.avg("_td").alias("_mtd"), F.avg("_lw").alias("_mlw"))
    d = d.crossJoin(F.broadcast(m)).withColumn("_c", F.col("_td") / F.col("_mtd") * 0.6 + F.col("_lw") / F.col("_mlw") * 0.4)
    m2 = d.agg(F.avg("_c").alias("_mc"))
    d = d.crossJoin(F.broadcast(m2)).withColumn("weight", F.col("_c") / F.col("_mc"))
    return d.drop("_maxd", "_age", "_p95", "_td", "_lw", "_mtd", "_mlw", "_c", "_mc")


def _normalise_sum(d: DataFrame, raw: str) -> DataFrame:
    s = d.agg(F.sum(raw).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    d = d.crossJoin(F.broadcast(s))
    return d.withColumn("weight", F.col(raw) / F.col("_sum")).withColumn(
        "weight_x_n", F.col(raw) / F.col("_sum") * F.col("_n")).drop("_sum", "_n", raw)


def weights_decay(df: DataFrame, decay: float = 0.1, date: str = "date") -> DataFrame:
    """exp(−decay·log1p(age)) × 1.5 on weekends, normalised to sum 1 (``weight_x_n`` = weight·n, mean 1)."""
    d = _age(df, date)
    raw = F.exp(F.lit(-decay) * F.log1p(F.col("_age").cast("double"))) * F.when(F.weekday(date) >= 5, 1.5).otherwise(1.0)
    return _normalise_sum(d.withColumn("_raw", raw), "_raw").drop("_maxd", "_age")


def weights_recent(df: DataFrame, weight: str = "weight", days: int = 90, boost: float = 1.5) -> DataFrame:
    """Rows after (max date − days) get ×boost, then the weights are renormalised to sum 1."""
    d = df.crossJoin(F.broadcast(df.agg(F.max("date").alias("_maxd"))))
    raw = F.when(F.col("date") > F.date_sub(F.col("_maxd"), days), F.col(weight) * boost).otherwise(F.col(weight))
    d = d.withColumn("_raw", raw).drop(weight, "weight_x_n")
    return _normalise_sum(d, "_raw").drop("_maxd")


def weights_cluster(df: DataFrame, rates: DataFrame, cluster: str = "store_cluster") -> DataFrame:
    """Cluster-specific decay: exp(−rate[cluster]·log1p(age)), normalised to sum 1.

    ``rates`` is one row per cluster (its size is the number of clusters)."""
    d = _age(df).join(F.broadcast(rates), cluster, "left")
    raw = F.exp(-F.col("decay") * F.log1p(F.col("_age").cast("double")))
    return _normalise_sum(d.withColumn("_raw", raw), "_raw").drop("_maxd", "_age", "decay")


def weight_profile(df: DataFrame, by: str, weight: str = "weight_x_n") -> DataFrame:
    return df.groupBy(by).agg(F.avg(weight).alias("mean"), F.stddev_samp(weight).alias("std"), F.count(weight).alias("count"))


def percentile_report(df: DataFrame, col: str, pcts=(0, 10, 25, 50, 75, 90, 100)) -> DataFrame:
    q = exact_percentiles(df, col, [p / 100.0 for p in pcts])
    return q.select(F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in pcts]).alias("percentile"),
                                            F.array(*[F.col(f"q{i}") for i in range(len(pcts))]).alias("value"))).alias("z")
                    ).select("z.percentile", "z.value")
