"""§2.7 encoding and bucketing, plus the discount target encoding and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.columns import bucket_left_closed, bucket_right_closed, xavg
from tillcast.functions.quantiles import exact_percentiles
from tillcast.operators.joins import maybe_broadcast
from tillcast.operators.reports import tiers

TIER_LABELS = ("D", "C", "B", "A")


def discount_target_encode(df: DataFrame, value: str = "revenue", cluster: str = "PREMIUM_OFFLINE") -> DataFrame:
    """Mean revenue per discount level inside one cluster (grouped aggregate joined back)."""
    sub = df.where(F.col("store_cluster") == cluster)
    enc = sub.groupBy("store_cluster", "discount_pct").agg(xavg(value).alias("discount_target_encoded"))
    return df.join(maybe_broadcast(enc, materialize=True), ["store_cluster", "discount_pct"], "left")


def tiers_filled(df: DataFrame, key: str) -> DataFrame:
    """Tier table with groups of undefined score (single row → NULL std) put in the lowest tier."""
    t = tiers(df, key)
    code = F.coalesce(F.col("tier_code"), F.lit(0))
    return t.withColumn("tier_code", code).withColumn(
        "tier", F.element_at(F.array(*[F.lit(x) for x in TIER_LABELS]), code + 1))


def apply_tiers(df: DataFrame, fitted: DataFrame, key: str) -> DataFrame:
    """``df`` with ``{key}_tier`` and ``{key}_tier_encoded`` by a saved tier table; unseen and null values are in tier D."""
    t = fitted.select(F.col("value").alias("_v"), F.col("tier").alias("_t"), F.col("tier_code").alias("_c"))
    j = df.join(maybe_broadcast(t, materialize=True), F.col(key) == F.col("_v"), "left")
    return j.withColumns({f"{key}_tier": F.coalesce("_t", F.lit(TIER_LABELS[0])), f"{key}_tier_encoded": F.coalesce("_c", F.lit(0))}).drop("_v", "_t", "_c")


def area_impute(df: DataFrame, col: str = "store_area") -> DataFrame:
    """Missing store area → the exact median over the rows (distributed two-pass percentile)."""
    med = exact_percentiles(df, col, [0.5]).select(F.col("q0").alias("_med"))
    return df.crossJoin(F.broadcast(med)).withColumn(col, F.coalesce(F.col(col), F.col("_med"))).drop("_med")


def kbins_fit(stores_df: DataFrame, col: str = "store_area", n_bins: int = 5) -> DataFrame:
    """Quantile bin edges (linear, exact) of ``col`` over the stores: a 1-row table ``edges ARRAY<DOUBLE>``."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = exact_percentiles(stores_df, col, probs)
    return q.select(F.array(*[F.col(f"q{i}") for i in range(n_bins + 1)]).alias("edges"))


def kbins_apply(df: DataFrame, edges: DataFrame, col: str = "store_area", out: str = "store_area_bucket",
                closed: str = "left", default: int = 2) -> DataFrame:
    """Apply saved edges: left-closed when fitting (KBinsDiscretizer), right-closed when scoring (``pd.cut``), where
    NULL and values outside the edges are in bucket 0; no edges (failed fit) → ``default``."""
    j = df.crossJoin(F.broadcast(edges))
    x = F.col(col)
    inside = (x >= F.get("edges", F.lit(0))) & (x <= F.element_at("edges", -1))
    b = bucket_left_closed(x, F.col("edges")) if closed == "left" else F.when(inside, bucket_right_closed(x, F.col("edges"))).otherwise(F.lit(0))
    return j.withColumn(out, F.coalesce(F.when(F.col("edges").isNotNull(), b), F.lit(default))).drop("edges")


# --- Fixed values: equal-width area classes ---
EQUAL_WIDTH_LABELS = ("SMALL_OFFLINE", "MEDIUM_OFFLINE", "LARGE_OFFLINE")
# ----------------------------------------------


def equal_width3(stores_df: DataFrame, col: str = "store_area") -> DataFrame:
    """``pd.cut(x, bins=3, include_lowest=True)`` labels: 3 equal-width, right-closed bins over [min, max]."""
    mm = stores_df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    j = stores_df.crossJoin(F.broadcast(mm))
    w = (F.col("_mx") - F.col("_mn")) / 3.0
    e1, e2 = F.col("_mn") + w, F.col("_mn") + w * 2.0
    x = F.col(col)
    idx = F.when(x.isNull(), F.lit(None)).when(x <= e1, 0).when(x <= e2, 1).otherwise(2)
    label = F.element_at(F.array(*[F.lit(v) for v in EQUAL_WIDTH_LABELS]), idx + 1)
    return j.withColumn("area_class_code", idx).withColumn("area_class", label).drop("_mn", "_mx")


def category_index(df: DataFrame, category: Column, prefix: str, out: str) -> DataFrame:
    """Sparse one-hot: the category string ``{prefix}_{value}`` and its column index among the sorted
    distinct categories (``pd.get_dummies`` column order).  The index table is built on the distinct
    categories only and joined back."""
    cat = F.concat(F.lit(prefix + "_"), category)
    d = df.withColumn(out, cat)
    from tillcast.functions.quantiles import rank_within

    idx = rank_within(d.select(out).where(F.col(out).isNotNull()).distinct(), None, [out], out="_pr",
                      index_out=f"{out}_index").drop("_pr")
    return d.join(maybe_broadcast(idx, materialize=True), out, "left")


def onehot_weekday_store(df: DataFrame) -> DataFrame:
    return category_index(df, F.concat_ws("_", F.col("day_of_week").cast("string"), F.col("store")), "wdst", "wdst")


def onehot_rcm(df: DataFrame) -> DataFrame:
    c = F.concat_ws("_", F.col("region"), F.col("channel"), F.col("month").cast("string"))
    return category_index(df, c, "rcm", "rcm")


def cluster_month(df: DataFrame) -> DataFrame:
    """Only the matching cluster × month dummy product is 1: its name is the sparse index."""
    c = F.concat(F.lit("cluster_"), F.col("store_cluster"), F.lit("_month_"), F.col("month").cast("string"),
                 F.lit("_interaction"))
    return df.withColumn("cluster_month_interaction", c)


def onehot_vectors(df: DataFrame, input_col: str, output_col: str) -> DataFrame:
    """Spark ML form of a one-hot: ``StringIndexer`` (alphabetical) + sparse ``OneHotEncoder`` (no column dropped)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    idx = StringIndexer(inputCol=input_col, outputCol=f"{output_col}_idx", stringOrderType="alphabetAsc",
                        handleInvalid="keep")
    enc = OneHotEncoder(inputCols=[f"{output_col}_idx"], outputCols=[output_col], dropLast=False, handleInvalid="keep")
    return Pipeline(stages=[idx, enc]).fit(df).transform(df)
