"""§2.4 aggregations and reports over the daily table.

Each report is one (or two) aggregations; global statistics are 1-row
aggregates, never an unpartitioned window, and quantiles of whole columns use
the distributed exact ``exact_percentiles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.columns import safe_div, xavg, xsum
from tillcast.functions.quantiles import exact_percentiles
from tillcast.operators.joins import maybe_broadcast

DESCRIBE_PROBS = (0.25, 0.5, 0.75)


def _long(df: DataFrame, cols, name="column", value="value") -> DataFrame:
    return df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], name, value)


def describe(df: DataFrame, cols) -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max per column (``Series.describe``)."""
    long = _long(df.select(*cols), cols)
    base = long.groupBy("column").agg(
        F.count("value").alias("count"),
        xavg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = exact_percentiles(long, "value", DESCRIBE_PROBS, by=["column"])
    q = q.select("column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    return base.join(q, "column", "left")


def discount_stats(df: DataFrame) -> DataFrame:
    base = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("disc_perc") > 0).alias("n_discounted"),
        F.min("disc_perc").alias("min_disc_perc"),
        F.avg("disc_perc").alias("mean_disc_perc"),
        F.max("disc_perc").alias("max_disc_perc"),
        xavg("revenue").alias("mean_revenue"),
        xavg("disc_value").alias("mean_disc_value"),
    )
    med = exact_percentiles(df.select("disc_perc", "disc_value").unpivot([], ["disc_perc", "disc_value"], "c", "v"),
                            "v", [0.5], by=["c"])
    med = med.groupBy().pivot("c", ["disc_perc", "disc_value"]).agg(F.first("q0"))
    return base.crossJoin(med.select(F.col("disc_perc").alias("median_disc_perc"),
                                     F.col("disc_value").alias("median_disc_value")))


def discount_ranges(df: DataFrame, edges=(0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100), value: str = "disc_perc") -> DataFrame:
    """Count and share of rows per half-open range (lo, hi]; empty ranges are kept.

    The range index is an expression (count of upper edges below the value),
    so this is a plain grouped count; the fixed list of ranges is then
    joined back (size fixed by ``edges``) to keep empty ranges.
    """
    spark = df.sparkSession
    rows = [(i, float(lo), float(hi), f"{lo}-{hi}%") for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))]
    rng = spark.createDataFrame(rows, "range_idx int, lo double, hi double, range string")
    uppers = F.array(*[F.lit(float(e)) for e in edges[1:]])
    x = F.col(value)
    idx = F.when((x > F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1]))),
                 F.size(F.filter(uppers, lambda e: e < x)))
    counts = df.select(idx.alias("range_idx")).groupBy("range_idx").agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    out = F.broadcast(rng).join(counts, "range_idx", "left").crossJoin(F.broadcast(total))
    return out.select(
        "range", "lo", "hi",
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        (F.coalesce(F.col("count"), F.lit(0)) / F.col("_total") * F.lit(100.0)).alias("percentage"),
    )


def high_discounts(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("disc_perc") > F.lit(float(threshold)))


def high_discount_metrics(df: DataFrame, threshold: float) -> DataFrame:
    h = high_discounts(df, threshold)
    base = h.agg(
        F.count(F.lit(1)).alias("n_high"),
        xavg("revenue").alias("mean_revenue"),
        xavg("disc_value").alias("mean_disc_value"),
        F.avg("disc_perc").alias("mean_disc_perc"),
        F.count_if(F.col("disc_value") > F.col("revenue")).alias("n_discount_gt_revenue"),
        F.count_if(F.col("revenue") == 0).alias("n_zero_revenue"),
    )
    long = h.select("revenue", "disc_value", "disc_perc").unpivot([], ["revenue", "disc_value", "disc_perc"], "c", "v")
    med = exact_percentiles(long, "v", [0.5], by=["c"]).groupBy().pivot("c", ["revenue", "disc_value", "disc_perc"]).agg(F.first("q0"))
    return base.crossJoin(med.select(F.col("revenue").alias("median_revenue"),
                                     F.col("disc_value").alias("median_disc_value"),
                                     F.col("disc_perc").alias("median_disc_perc")))


def high_discount_month(df: DataFrame, threshold: float) -> DataFrame:
    h = high_discounts(df, threshold)
    by = h.groupBy(F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("count"))
    tot = h.agg(F.count(F.lit(1)).alias("_n"))
    return by.crossJoin(F.broadcast(tot)).select("month", "count", (F.col("count") / F.col("_n") * 100.0).alias("percentage"))


def high_discount_weekend(df: DataFrame, threshold: float) -> DataFrame:
    h = high_discounts(df, threshold)
    kind = F.when(F.weekday("date") >= 5, F.lit("Weekend")).otherwise(F.lit("Weekday"))
    by = h.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("count"))
    tot = h.agg(F.count(F.lit(1)).alias("_n"))
    return by.crossJoin(F.broadcast(tot)).select("type", "count", (F.col("count") / F.col("_n") * 100.0).alias("percentage"))


def data_quality(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("revenue") == 0).alias("n_zero_revenue"),
        F.count_if(F.col("revenue") < 0).alias("n_negative_revenue"),
        F.count_if(F.col("disc_value") < 0).alias("n_negative_discount"),
        F.count_if(F.col("revenue").isNull() | F.isnan("revenue")).alias("n_missing_revenue"),
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_distinct("store").alias("n_stores"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.count(F.lit(1)).alias("n_store_days"),
    )


def column_profile(df: DataFrame, numeric, categorical) -> DataFrame:
    """Per numeric feature: mean, std, min, max, zero and non-zero counts;
    per categorical feature: number of distinct values and the mode (ties → smallest value)."""
    num = _long(df.select(*numeric), numeric, "feature", "v").groupBy("feature").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.count_if(F.col("v") == 0).alias("n_zero"), F.count_if(F.col("v") != 0).alias("n_nonzero"),
    )
    cat_long = df.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot([], categorical, "feature", "v")
    freq = cat_long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("cnt"))
    cat = freq.groupBy("feature").agg(
        F.count("v").alias("n_unique"),
        F.min_by("v", F.struct(-F.col("cnt"), F.col("v"))).alias("mode"),
    )
    return num, cat


def category_lists(stores_df: DataFrame, cols=("channel", "region", "city")) -> DataFrame:
    """Sorted distinct values per categorical column, one row per (column, value, position)."""
    long = stores_df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    from tillcast.functions.quantiles import rank_within

    d = long.where(F.col("value").isNotNull()).distinct()
    return rank_within(d, "column", ["value"], out="_pr", index_out="position").drop("_pr")


def target_encoding_table(df: DataFrame, key: str, value: str = "revenue") -> DataFrame:
    return df.groupBy(key).agg(xavg(value).alias(f"{key}_encoded"))


def target_encoding_tables(fit: DataFrame, keys, value: str = "revenue") -> DataFrame:
    """All encodings in one pass: the keys are unpivoted to (key, category) and grouped once."""
    long = fit.select(F.col(value).alias("_v"), *[F.col(k).cast("string").alias(k) for k in keys]).unpivot(
        "_v", list(keys), "_kind", "_cat")
    return long.groupBy("_kind", "_cat").agg(xavg("_v").alias("_enc"))


def target_encode(df: DataFrame, keys=("city", "region", "channel"), value: str = "revenue", fit: DataFrame | None = None) -> DataFrame:
    """Mean revenue per category learnt on ``fit`` (default: df), unseen → 0 (D2).

    One aggregation serves every key; the (small, category-sized) result is written once, its size is
    checked once, and each key joins its slice of it."""
    from tillcast.operators.joins import BROADCAST_MAX_ROWS, is_small
    from tillcast.session import cut_lineage

    fit = df if fit is None else fit
    enc = cut_lineage(target_encoding_tables(fit, keys, value))
    small = is_small(enc, BROADCAST_MAX_ROWS)
    out = df
    for k in keys:
        e = enc.where(F.col("_kind") == k).select(F.col("_cat").alias(k), F.col("_enc").alias(f"{k}_encoded"))
        out = out.join(F.broadcast(e) if small else e, k, "left").withColumn(
            f"{k}_encoded", F.coalesce(F.col(f"{k}_encoded"), F.lit(0.0)))
    return out


def tiers(df: DataFrame, key: str, value: str = "revenue") -> DataFrame:
    """Tier per category: score 0.6·mean + 0.2·std + 0.2·count, quartile label D<C<B<A on exact edges.

    Duplicate edges are dropped (D15), so fewer than 4 tiers can occur;
    labels are given from D upwards.
    """
    g = df.groupBy(key).agg(
        xavg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")
    ).withColumn("score", F.col("mean") * 0.6 + F.col("std") * 0.2 + F.col("count") * 0.2)
    edges = g.agg(F.percentile("score", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("_e"))
    from tillcast.functions.columns import bucket_right_closed

    t = g.crossJoin(F.broadcast(edges)).withColumn("tier_code", bucket_right_closed(F.col("score"), F.col("_e")))
    label = F.element_at(F.array(*[F.lit(x) for x in ("D", "C", "B", "A")]), F.col("tier_code") + 1)
    return t.select(F.col(key).alias("value"), "mean", "std", "count", "score", "tier_code", label.alias("tier"))


def store_month_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("store", "month").agg(
        F.coalesce(xavg("revenue"), F.lit(0.0)).alias("store_month_revenue_mean"),
        F.coalesce(F.stddev_samp("revenue"), F.lit(0.0)).alias("store_month_revenue_std"),
        F.coalesce(F.min("revenue"), F.lit(0.0)).alias("store_month_revenue_min"),
        F.coalesce(F.max("revenue"), F.lit(0.0)).alias("store_month_revenue_max"),
        F.coalesce(xavg("qty_sold"), F.lit(0.0)).alias("store_month_quantity_mean"),
        F.coalesce(F.stddev_samp("qty_sold"), F.lit(0.0)).alias("store_month_quantity_std"),
        F.coalesce(xavg("disc_value"), F.lit(0.0)).alias("store_month_discount_mean"),
        F.coalesce(F.stddev_samp("disc_value"), F.lit(0.0)).alias("store_month_discount_std"),
    )


def store_season_profile(sms: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return sms.groupBy("store").agg(
        z(F.avg("store_month_revenue_mean")).alias("store_month_revenue_mean_avg"),
        z(F.stddev_samp("store_month_revenue_mean")).alias("store_month_revenue_mean_std"),
        z(F.max("store_month_revenue_mean")).alias("store_month_revenue_mean_max"),
        z(F.avg("store_month_revenue_std")).alias("store_month_revenue_std_avg"),
        z(F.stddev_samp("store_month_revenue_std")).alias("store_month_revenue_std_std"),
        z(F.avg("store_month_quantity_mean")).alias("store_month_quantity_mean_avg"),
        z(F.stddev_samp("store_month_quantity_mean")).alias("store_month_quantity_mean_std"),
        z(F.avg("store_month_discount_mean")).alias("store_month_discount_mean_avg"),
        z(F.stddev_samp("store_month_discount_mean")).alias("store_month_discount_mean_std"),
    )


HOLIDAY_MONTHS = (12, 1, 2)
SUMMER_MONTHS = (4, 5, 6)


def season_ratios(df: DataFrame) -> DataFrame:
    m = F.col("month")
    hol = xavg(F.when(m.isin(*HOLIDAY_MONTHS), F.col("revenue")))
    summ = xavg(F.when(m.isin(*SUMMER_MONTHS), F.col("revenue")))
    reg = xavg(F.when(~m.isin(*HOLIDAY_MONTHS, *SUMMER_MONTHS), F.col("revenue")))
    return df.groupBy("store").agg(
        F.coalesce(safe_div(hol, reg), F.lit(1.0)).alias("holiday_revenue_ratio"),
        F.coalesce(safe_div(summ, reg), F.lit(1.0)).alias("summer_revenue_ratio"),
    )


def geo_profile(df: DataFrame, key: str) -> DataFrame:
    """Per group mean/std revenue, mean qty and discount, each z-scored across groups (sample std)."""
    g = df.groupBy(key).agg(
        F.coalesce(xavg("revenue"), F.lit(0.0)).alias("revenue_avg"),
        F.coalesce(F.stddev_samp("revenue"), F.lit(0.0)).alias("revenue_std"),
        F.coalesce(xavg("qty_sold"), F.lit(0.0)).alias("quantity_avg"),
        F.coalesce(xavg("disc_value"), F.lit(0.0)).alias("discount_avg"),
    )
    cols = ["revenue_avg", "revenue_std", "quantity_avg", "discount_avg"]
    mom = g.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    out = g.crossJoin(F.broadcast(mom))
    return out.select(key, *[safe_div(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(f"{key}_{c}") for c in cols])


def store_density(stores_df: DataFrame) -> DataFrame:
    """Stores per city and per state (grouped counts joined back; NULL keys get NULL)."""
    out = stores_df
    for key in ("city", "state"):
        cnt = stores_df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"{key}_store_density"))
        out = out.join(maybe_broadcast(cnt, materialize=True), key, "left")
    return out.select("id", "city", "state", "city_store_density", "state_store_density")


def by_year(df: DataFrame, keys=("store",)) -> DataFrame:
    """Per key and year: sum & mean revenue and qty, mean & count discount %, rounded to 2 decimals."""
    from tillcast.functions.columns import round2

    return df.groupBy(*keys, F.year("date").alias("year")).agg(
        round2(xsum("revenue")).alias("revenue_sum"),
        round2(xavg("revenue")).alias("revenue_mean"),
        round2(xsum("qty_sold")).alias("qty_sum"),
        round2(xavg("qty_sold")).alias("qty_mean"),
        round2(F.avg("disc_perc")).alias("disc_perc_mean"),
        F.count("disc_perc").alias("disc_perc_count"),
    )


def monthly_by_year(df: DataFrame, month: int, before=None) -> DataFrame:
    d = df.where(F.month("date") == month)
    if before is not None:
        d = d.where(F.col("date") < F.lit(before).cast("date"))
    return by_year(d)


def same_day_by_year(df: DataFrame, month: int, day: int, before=None) -> DataFrame:
    from tillcast.functions.columns import round2

    d = df.where((F.month("date") == month) & (F.dayofmonth("date") == day))
    if before is not None:
        d = d.where(F.col("date") < F.lit(before).cast("date"))
    return d.groupBy("store", F.year("date").alias("year")).agg(
        round2(F.min_by("revenue", "date")).alias("revenue"),
        round2(F.min_by("qty_sold", "date")).alias("qty_sold"),
        round2(F.min_by("disc_perc", "date")).alias("disc_perc"),
        F.count("disc_perc").alias("disc_perc_count"),
    )


def season_index_table(df: DataFrame) -> DataFrame:
    return df.groupBy("store", "month", F.col("day_of_week").alias("weekday")).agg(
        xavg("revenue").alias("store_month_weekday_avg"))


def weekday_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("day_of_week").agg(xavg("revenue").alias("weekday_avg"), F.stddev_samp("revenue").alias("weekday_std"))


def store_median_impute(df: DataFrame, value: str = "revenue") -> DataFrame:
    """Missing value → the store's median (a store has one row per day, so the group is bounded)."""
    med = F.percentile(F.col(value), 0.5).over(Window.partitionBy("store"))
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return df.withColumn(value, F.coalesce(v, med))


def feature_bounds(df: DataFrame, cols, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    long = _long(df.select(*cols), cols, "feature", "v")
    q = exact_percentiles(long, "v", [lo, hi], by=["feature"])
    return q.select("feature", F.col("q0").alias("p_low"), F.col("q1").alias("p_high"))


def corr_pairs(df: DataFrame, cols, threshold: float = 0.8) -> DataFrame:
    """Pairs with |Pearson r| > threshold, one aggregation computing every pair."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    spark = df.sparkSession
    names = spark.createDataFrame([(a, b, f"{a}__{b}") for a, b in pairs], "feature_1 string, feature_2 string, k string")
    stacked = row.unpivot([], [f"{a}__{b}" for a, b in pairs], "k", "r")
    return stacked.join(F.broadcast(names), "k").where(F.abs("r") > threshold).select("feature_1", "feature_2", "r")


def dynamic_test_size(df: DataFrame) -> DataFrame:
    n = F.col("n_rows")
    size = F.when(n < 30, 0.1).when(n < 90, 0.15).when(n < 180, 0.2).otherwise(0.3)
    return df.groupBy("store").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("test_size", size)
