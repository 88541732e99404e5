"""§2.10 interval rules on a table of predictions (store, date, p10, p50, p90, …).

Rules are column expressions in one fixed order; group statistics they need
(store × weekday std, store × month × weekday mean / min, batch means, the
conformal quantile) are pre-aggregated and joined, never computed per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.columns import safe_div, xavg
from tillcast.functions.quantiles import exact_percentiles

# --- Fixed values ---
Z90 = 1.2815515655446004      # standard normal 0.9 quantile (p10/p90 of a normal band)
CONFORMAL_ALPHA = 0.1          # 90 % nominal coverage
CONFORMAL_MIN_ROWS = 100       # fewer calibration rows → no calibration
CALIBRATION_BINS = 100         # edges of the position histogram (99 bins)
# --------------------


def past_predictions(daily: DataFrame, window: int = 28) -> DataFrame:
    """Prediction table derived from the sales history (FIXTURES F8):
    p50 = mean of the previous ``window`` rows, p10/p90 = p50 ∓ their sample std."""
    w = Window.partitionBy("store").orderBy("date").rowsBetween(-window, -1)
    out = daily.withColumn("p50", xavg("revenue", w)).withColumn("_s", F.stddev_samp("revenue").over(w))
    out = out.where(F.col("p50").isNotNull() & F.col("_s").isNotNull())
    return out.withColumn("p10", F.col("p50") - F.col("_s")).withColumn("p90", F.col("p50") + F.col("_s")).drop("_s")


def interval_spread(df: DataFrame, median: str = "p50", spread: str = "spread") -> DataFrame:
    return df.withColumn("p10", F.col(median) - F.col(spread)).withColumn("p90", F.col(median) + F.col(spread))


def band_residual(df: DataFrame, history: DataFrame) -> DataFrame:
    """p10/p90 = p50 ∓ std of the store×weekday history (std(actual − const) = std(actual)); none → p50."""
    s = history.groupBy("store", F.weekday("date").alias("_dow")).agg(F.stddev_samp("revenue").alias("_sr"),
                                                                      F.count("revenue").alias("_n"))
    j = df.withColumn("_dow", F.weekday("date")).join(s, ["store", "_dow"], "left")
    has = F.col("_n").isNotNull()
    sr = F.col("_sr")
    return (j.withColumn("p10", F.when(has, F.col("p50") - sr).otherwise(F.col("p50")))
            .withColumn("p90", F.when(has, F.col("p50") + sr).otherwise(F.col("p50")))
            .drop("_dow", "_sr", "_n"))


def band_sort(df: DataFrame) -> DataFrame:
    """p10 ≥ 0, then (p10, p50, p90) sorted ascending (NULLs first, as ``sort_array``)."""
    arr = F.sort_array(F.array(F.greatest(F.col("p10"), F.lit(0.0)), F.col("p50"), F.col("p90")))
    return df.withColumn("_a", arr).withColumns({"p10": F.col("_a")[0], "p50": F.col("_a")[1], "p90": F.col("_a")[2]}).drop("_a")


def p10_floor(df: DataFrame, history: DataFrame, share: float = 0.7) -> DataFrame:
    m = history.groupBy("store", F.month("date").alias("_m"), F.weekday("date").alias("_dow")).agg(
        xavg("revenue").alias("_smw"))
    j = df.withColumn("_m", F.month("date")).withColumn("_dow", F.weekday("date")).join(m, ["store", "_m", "_dow"], "left")
    floor = F.coalesce(F.col("_smw") * share, F.lit(0.0))
    return j.withColumn("p10", F.greatest(F.col("p10"), floor)).drop("_m", "_dow", "_smw")


def p10_floor_weekday(df: DataFrame, history: DataFrame, share: float = 0.7) -> DataFrame:
    """p10 is at least ``share`` of the store's mean revenue on that weekday; stores without one keep it."""
    m = history.groupBy("store", F.weekday("date").alias("_dow")).agg(xavg("revenue").alias("_sw"))
    j = df.withColumn("_dow", F.weekday("date")).join(m, ["store", "_dow"], "left")
    return j.withColumn("p10", F.greatest(F.col("p10"), F.col("_sw") * share)).drop("_dow", "_sw")


def wide_fallback(df: DataFrame, history: DataFrame, std_col: str = "revenue_std", factor: float = 3.0) -> DataFrame:
    """If the batch's mean width exceeds factor × mean revenue_std: p50 = history mean, bands 0.8 / 1.2."""
    st = df.agg(F.avg(F.col("p90") - F.col("p10")).alias("_mw"), F.avg(std_col).alias("_ms"))
    g = history.agg(xavg("revenue").alias("_gm"))
    j = df.crossJoin(F.broadcast(st)).crossJoin(F.broadcast(g))
    wide = F.col("_mw") > F.col("_ms") * factor
    return (j.withColumn("p50", F.when(wide, F.col("_gm")).otherwise(F.col("p50")))
            .withColumn("p10", F.when(wide, F.col("p50") * 0.8).otherwise(F.col("p10")))
            .withColumn("p90", F.when(wide, F.col("p50") * 1.2).otherwise(F.col("p90")))
            .withColumn("wide_fallback", wide.cast("int")).drop("_mw", "_ms", "_gm"))


def reject_wide(df: DataFrame) -> DataFrame:
    width = F.col("p90") - F.col("p10")
    bad = (F.col("p50") < 1e-3) | (width > F.lit(15.0) * F.greatest(F.col("p50"), F.lit(1.0)))
    return df.withColumns({c: F.when(bad, F.lit(None).cast("double")).otherwise(F.col(c)) for c in ("p10", "p50", "p90")})


def blend_rules(df: DataFrame) -> DataFrame:
    """p50 ← ½p50 + ½(store×month×weekday mean, 0 if missing); ½ + ½ 3-row mean; ½ + ½ mean of lags 7/14/30."""
    p = F.col("p50") * 0.5 + F.coalesce(F.col("store_month_weekday_avg"), F.lit(0.0)) * 0.5
    out = df.withColumn("p50", p)
    out = out.withColumn("p50", F.col("p50") * 0.5 + F.col("revenue_last_3_days") * 0.5)
    lag_mean = (F.col("revenue_lag_7") + F.col("revenue_lag_14") + F.col("revenue_lag_30")) / 3.0
    return out.withColumn("p50", F.col("p50") * 0.5 + lag_mean * 0.5)


def model_vs_fallback(df: DataFrame, pred: str, fallback: str) -> DataFrame:
    """½/½ blend when the model differs from the fallback by more than twice the fallback."""
    far = F.abs(F.col(pred) - F.col(fallback)) > F.col(fallback) * 2.0
    return df.withColumn("p50", F.when(far, F.col(fallback) * 0.5 + F.col(pred) * 0.5).otherwise(F.col(pred)))


def band_rules(df: DataFrame) -> DataFrame:
    """Widen ×1.2 when 3-day volatility > 0.4; sort; p90 ≤ 2·seasonal_index·p50; p90 ≤ median + 2·std; p90 += 0.1·premium."""
    vol = F.coalesce(F.col("revenue_volatility_3d"), F.lit(0.0))
    out = df.withColumns({
        "p10": F.when(vol > 0.4, F.col("p50") - (F.col("p50") - F.col("p10")) * 1.2).otherwise(F.col("p10")),
        "p90": F.when(vol > 0.4, F.col("p50") + (F.col("p90") - F.col("p50")) * 1.2).otherwise(F.col("p90")),
    })
    arr = F.sort_array(F.array("p10", "p50", "p90"))
    out = out.withColumn("_a", arr).withColumns({"p10": F.col("_a")[0], "p50": F.col("_a")[1], "p90": F.col("_a")[2]}).drop("_a")
    out = out.withColumn("p90", F.least(F.col("p90"), F.col("store_seasonal_index") * 2.0 * F.col("p50")))
    out = out.withColumn("p90", F.least(F.col("p90"), F.col("store_month_revenue_median") + F.col("store_month_revenue_std") * 2.0))
    return out.withColumn("p90", F.col("p90") + F.col("premium_location_discount") * 0.1)


def weak_signal(df: DataFrame, attribution_sum: str = "shap_sum") -> DataFrame:
    weak = F.col(attribution_sum) < 0.05
    out = df.withColumn("p50", F.when(weak, F.col("revenue_rolling_mean_7d")).otherwise(F.col("p50")))
    fb = F.col("revenue_last_3_days") * 0.5 + F.col("city_encoded") * 0.5
    return out.withColumn("p50", F.when(weak, fb).otherwise(F.col("p50")))


def min_history(df: DataFrame, history: DataFrame) -> DataFrame:
    """p50 below the store×weekday×month historical minimum → that group's mean."""
    g = history.groupBy("store", F.weekday("date").alias("_dow"), F.month("date").alias("_m")).agg(
        F.min("revenue").alias("_min"), xavg("revenue").alias("_avg"))
    j = df.withColumn("_dow", F.weekday("date")).withColumn("_m", F.month("date")).join(g, ["store", "_dow", "_m"], "left")
    return j.withColumn("p50", F.when(F.col("p50") < F.col("_min"), F.col("_avg")).otherwise(F.col("p50"))).drop(
        "_dow", "_m", "_min", "_avg")


def fallback_invalid(df: DataFrame, pred: str = "p50", custom: str = "yoy_fallback", low: float = 1000.0) -> DataFrame:
    """NULL / non-finite / 0 prediction → custom (YoY) fallback; p50 < low → max(store_dayofweek_avg, store_month_avg)."""
    x = F.col(pred)
    invalid = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x == 0)
    out = df.withColumn("p50", F.when(invalid, F.col(custom)).otherwise(x))
    fb = F.greatest(F.col("store_dayofweek_avg"), F.col("store_month_avg"))
    return out.withColumn("fallback_triggered", (invalid | (F.col("p50") < low)).cast("int")).withColumn(
        "p50", F.when(F.col("p50") < low, fb).otherwise(F.col("p50")))


def sparse_input(features) -> Column:
    """Whether more than half of the features are null or NaN, or the others add up to 0."""
    values = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    nulls = sum((v.isNull().cast("int") for v in values), F.lit(0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return (nulls * 2 > len(features)) | (total == 0)


def fallback_sparse(df: DataFrame, features, custom: str = "yoy_fallback") -> DataFrame:
    """p50 → the custom fallback where the input is sparse (see ``sparse_input``)."""
    sparse = sparse_input(list(features))
    return df.withColumn("fallback_triggered", sparse.cast("int")).withColumn("p50", F.when(sparse, F.col(custom)).otherwise(F.col("p50")))


def final_floor(df: DataFrame, floor: str = "yoy_fallback") -> DataFrame:
    return df.withColumns({c: F.greatest(F.col(c), F.col(floor)) for c in ("p10", "p50", "p90")})


def conformal_scores(df: DataFrame, y: str = "revenue") -> DataFrame:
    d = safe_div(F.col(y) - F.col("p50"), F.col("p90") - F.col("p10"))
    inside = (F.col(y) >= F.col("p10")) & (F.col(y) <= F.col("p90"))
    return df.withColumn("score", F.when(inside, F.abs(d)).otherwise(F.lit(1.0) + F.abs(d)))


def conformal_fit(df: DataFrame, y: str = "revenue", alpha: float = CONFORMAL_ALPHA,
                  min_rows: int = CONFORMAL_MIN_ROWS) -> DataFrame:
    """1-row table: n and the (1 − α) quantile of the nonconformity scores (NULL if n < min_rows)."""
    q = exact_percentiles(conformal_scores(df, y), "score", [1.0 - alpha])
    return q.select("n", F.when(F.col("n") >= min_rows, F.col("q0")).alias("q_adjust"))


def conformal_apply(df: DataFrame, fit: DataFrame) -> DataFrame:
    j = df.crossJoin(F.broadcast(fit.select("q_adjust")))
    width = F.col("p90") - F.col("p10")
    q = F.coalesce(F.col("q_adjust"), F.lit(0.0))
    # both ends move by the width of the band *before* calibration
    return j.withColumns({"p10": F.col("p10") - q * width, "p90": F.col("p90") + q * width}).drop("q_adjust")


def normal_band(df: DataFrame, pred: str = "p50", unc: str = "uncertainty") -> DataFrame:
    return df.withColumn("p10", F.col(pred) - F.lit(Z90) * F.col(unc)).withColumn("p90", F.col(pred) + F.lit(Z90) * F.col(unc))


def band_position(df: DataFrame, y: str = "revenue") -> DataFrame:
    inside = (F.col(y) >= F.col("p10")) & (F.col(y) <= F.col("p90"))
    pos = (F.when(inside, (F.col(y) - F.col("p10")) / (F.col("p90") - F.col("p10")))
           .when(F.col(y) < F.col("p10"), F.lit(0.0)).otherwise(F.lit(1.0)))
    return df.withColumn("position", pos)


def binned_position(df: DataFrame, cluster: str = "store_cluster", n_bins: int = CALIBRATION_BINS) -> DataFrame:
    """Mean position per (cluster, bin) over bins [i/(n−1), (i+1)/(n−1)); empty bins → bin centre."""
    k = n_bins - 1
    b = F.floor(F.col("position") * k).cast("int")
    agg = df.where(F.col("position") < 1.0).groupBy(cluster, b.alias("bin")).agg(F.avg("position").alias("_mp"))
    scaffold = df.select(cluster).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    out = scaffold.join(agg, [cluster, "bin"], "left")
    centre = (F.col("bin") + F.lit(0.5)) / F.lit(float(k))
    return out.select(cluster, "bin", centre.alias("bin_center"), F.coalesce(F.col("_mp"), centre).alias("binned_position"))


def forecast_metrics(df: DataFrame, y: str = "revenue") -> DataFrame:
    e = F.col(y) - F.col("p50")
    inside = (F.col(y) >= F.col("p10")) & (F.col(y) <= F.col("p90"))
    return df.agg(
        (F.avg(inside.cast("double")) * 100.0).alias("coverage"),
        F.avg(F.col("p90") - F.col("p10")).alias("sharpness"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
    )


def r2(df: DataFrame, y: str = "revenue", pred: str = "p50") -> DataFrame:
    m = df.agg(F.avg(y).alias("_ym"))
    j = df.crossJoin(F.broadcast(m))
    return j.agg((F.lit(1.0) - F.sum(F.pow(F.col(y) - F.col(pred), 2.0)) / F.sum(F.pow(F.col(y) - F.col("_ym"), 2.0))).alias("r2"))


def coverage_miss(df: DataFrame, y: str = "revenue") -> DataFrame:
    miss = (F.col(y) < F.col("p10")) | (F.col(y) > F.col("p90"))
    return df.agg(F.count_if(miss).alias("n_miss"), F.avg(miss.cast("double")).alias("miss_rate"))
