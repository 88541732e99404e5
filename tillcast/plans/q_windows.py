"""§2.5 window-function operators as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.operators import windows as W
from tillcast.plans import base
from tillcast.plans.registry import register
from tillcast.plans.sqlbase import XAVG, sql

K = ["store", "date"]
REGION_CHUNK_ROWS = 20_000  # rows per (region, weekday) chunk; each chunk also reads the 28 rows before it
WS = "WINDOW w AS (PARTITION BY store ORDER BY date)"


def _d(spark, sf_dir):
    return base.daily(spark, sf_dir)


def _by_store(spark, sf_dir):
    return base.daily_by_store(spark, sf_dir)


@register("lags", sql(f"""
SELECT store, date,
       lag(revenue, 1) OVER w AS revenue_lag_1, lag(revenue, 3) OVER w AS revenue_lag_3,
       lag(revenue, 7) OVER w AS revenue_lag_7, lag(revenue, 14) OVER w AS revenue_lag_14,
       lag(revenue, 30) OVER w AS revenue_lag_30
FROM daily {WS}"""))
def q_lags(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.lags).select(*K, *[f"revenue_lag_{n}" for n in W.LAGS])


@register("lag_diffs", sql(f"""
SELECT store, date,
       lag(revenue, 1) OVER w - lag(revenue, 3) OVER w AS revenue_lag_diff_1_3,
       lag(revenue, 3) OVER w - lag(revenue, 7) OVER w AS revenue_lag_diff_3_7,
       lag(revenue, 7) OVER w - lag(revenue, 14) OVER w AS revenue_lag_diff_7_14,
       lag(revenue, 14) OVER w - lag(revenue, 30) OVER w AS revenue_lag_diff_14_30
FROM daily {WS}"""), dbl="revenue_lag_diff_1_3 revenue_lag_diff_3_7 revenue_lag_diff_7_14 revenue_lag_diff_14_30")
def q_lag_diffs(spark, sf_dir):
    d = _by_store(spark, sf_dir).transform(W.lags).transform(W.lag_diffs)
    return d.select(*K, "revenue_lag_diff_1_3", "revenue_lag_diff_3_7", "revenue_lag_diff_7_14", "revenue_lag_diff_14_30")


def _roll_sql(w):
    fr = f"(w ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return (f"{XAVG('revenue', fr)} AS revenue_rolling_mean_{w}d, "
            f"stddev_samp(revenue) OVER {fr} AS revenue_rolling_std_{w}d")


@register("rolling_lagged", sql(f"""
SELECT store, date, {_roll_sql(7)}, {_roll_sql(14)}, {_roll_sql(30)} FROM daily {WS}"""),
          dbl=" ".join(f"revenue_rolling_mean_{w}d revenue_rolling_std_{w}d" for w in W.ROLLING))
def q_rolling_lagged(spark, sf_dir):
    cols = []
    for w in W.ROLLING:
        cols += [f"revenue_rolling_mean_{w}d", f"revenue_rolling_std_{w}d"]
    return _by_store(spark, sf_dir).transform(W.rolling_lagged).select(*K, *cols)


F3 = "(w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@register("last3", sql(f"""
SELECT store, date, {XAVG('revenue', F3)} AS revenue_last_3_days,
       stddev_samp(revenue) OVER {F3} AS revenue_last_3_days_std
FROM daily {WS}"""), dbl="revenue_last_3_days revenue_last_3_days_std")
def q_last3(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.last3).select(*K, "revenue_last_3_days", "revenue_last_3_days_std")


@register("volatility3", sql(f"""
SELECT store, date, stddev_samp(revenue) OVER {F3} / NULLIF({XAVG('revenue', F3)}, 0) AS revenue_volatility_3d
FROM daily {WS}"""), dbl="revenue_volatility_3d")
def q_volatility3(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.volatility3).select(*K, "revenue_volatility_3d")


EXP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@register("expanding_store", sql(f"""
SELECT store, date,
       quantile_cont(revenue, 0.5) OVER (w {EXP}) AS revenue_median,
       stddev_samp(revenue) OVER (w {EXP}) AS revenue_std
FROM daily {WS}"""), dbl="revenue_median revenue_std")
def q_expanding_store(spark, sf_dir):
    return _d(spark, sf_dir).transform(W.expanding_store).select(*K, "revenue_median", "revenue_std")


@register("expanding_store_month", sql(f"""
SELECT store, date, month,
       quantile_cont(revenue, 0.5) OVER (PARTITION BY store, month ORDER BY date {EXP}) AS store_month_revenue_median,
       stddev_samp(revenue) OVER (PARTITION BY store, month ORDER BY date {EXP}) AS store_month_revenue_std
FROM daily"""), dbl="store_month_revenue_median store_month_revenue_std")
def q_expanding_store_month(spark, sf_dir):
    return _d(spark, sf_dir).transform(W.expanding_store_month).select(
        *K, "month", "store_month_revenue_median", "store_month_revenue_std")


@register("seasonal_index", sql(f"""
SELECT store, date,
       quantile_cont(revenue, 0.5) OVER (PARTITION BY store, month ORDER BY date {EXP})
         / NULLIF(quantile_cont(revenue, 0.5) OVER (PARTITION BY store, month), 0) AS seasonal_index
FROM daily"""), dbl="seasonal_index")
def q_seasonal_index(spark, sf_dir):
    return _d(spark, sf_dir).transform(W.seasonal_index).select(*K, "seasonal_index")


SWH = "(PARTITION BY store, day_of_week ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@register("store_weekday_hist", sql(f"""
SELECT store, date, {XAVG('revenue', SWH)} AS store_weekday_avg, stddev_samp(revenue) OVER {SWH} AS store_weekday_std
FROM daily"""), dbl="store_weekday_avg store_weekday_std")
def q_store_weekday_hist(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.store_weekday_hist).select(*K, "store_weekday_avg", "store_weekday_std")


@register("day_over_day", sql(f"""
SELECT store, date, revenue / NULLIF(lag(revenue, 1) OVER w, 0) - 1.0 AS revenue_day_over_day FROM daily {WS}"""),
          dbl="revenue_day_over_day")
def q_day_over_day(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.day_over_day).select(*K, "revenue_day_over_day")


@register("week_over_week", sql("""
SELECT store, date,
       revenue / NULLIF(lag(revenue, 7) OVER (PARTITION BY store, day_of_week ORDER BY date), 0) - 1.0 AS revenue_week_over_week
FROM daily"""), dbl="revenue_week_over_week")
def q_week_over_week(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.week_over_week).select(*K, "revenue_week_over_week")


@register("region_weekday_std", sql("""
SELECT store, date,
       stddev_samp(revenue) OVER (PARTITION BY region, day_of_week ORDER BY store, date
                                  ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS region_weekday_std
FROM daily"""), dbl="region_weekday_std")
def q_region_weekday_std(spark, sf_dir):
    # chunked form: regions × 7 groups would otherwise each sit in a single task
    return W.region_weekday_std(_d(spark, sf_dir), chunk_rows=REGION_CHUNK_ROWS).select(*K, "region_weekday_std")


@register("since_high", sql(f"""
, q AS (
  SELECT store, date, revenue, row_number() OVER w - 1 AS i,
         quantile_cont(revenue, 0.9) OVER (w {EXP}) AS p90
  FROM daily {WS})
SELECT store, date,
       COALESCE(i - max(CASE WHEN revenue > p90 THEN i END)
                  OVER (PARTITION BY store ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), i)
         AS time_since_last_high_revenue
FROM q"""))
def q_since_high(spark, sf_dir):
    return _d(spark, sf_dir).transform(W.since_high).select(*K, "time_since_last_high_revenue")


@register("lag7_percentile", sql(f"""
, q AS (
  SELECT store, date, row_number() OVER w - 1 AS i, lag(revenue, 7) OVER w AS lag7,
         list(revenue) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS prev30
  FROM daily {WS})
SELECT store, date,
       CASE WHEN i >= 30 AND lag7 IS NOT NULL
            THEN CAST(len(list_filter(prev30, lambda v: v < lag7)) AS DOUBLE) / len(prev30) END
         AS revenue_lag_7_percentile
FROM q"""), dbl="revenue_lag_7_percentile")
def q_lag7_percentile(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.lag7_percentile).select(*K, "revenue_lag_7_percentile")


SMA = f"{XAVG('revenue', '(PARTITION BY store, month)')}"


@register("rolling_rank30", sql(f"""
, q AS (
  SELECT store, date, revenue, {SMA} AS store_month_avg,
         list(revenue) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS w30
  FROM daily {WS})
SELECT store, date,
       COALESCE((len(list_filter(w30, lambda v: v < revenue))
                 + (len(list_filter(w30, lambda v: v = revenue)) + 1) / 2.0) / len(w30), store_month_avg)
         AS revenue_rolling_rank_30d
FROM q"""), dbl="revenue_rolling_rank_30d")
def q_rolling_rank30(spark, sf_dir):
    d = _by_store(spark, sf_dir).transform(W.store_baselines).transform(W.rolling_rank30)
    return d.select(*K, "revenue_rolling_rank_30d")


@register("median90", sql(f"""
SELECT store, date,
       COALESCE(quantile_cont(revenue, 0.5) OVER (w ROWS BETWEEN 89 PRECEDING AND CURRENT ROW), {SMA})
         AS revenue_median_last_90d
FROM daily {WS}"""), dbl="revenue_median_last_90d")
def q_median90(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.store_baselines).transform(W.median90).select(*K, "revenue_median_last_90d")


F90 = "(w ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)"
F7 = "(w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@register("demand_trend", sql(f"""
SELECT store, date, {XAVG('revenue', F90)} AS revenue_rolling_mean_90d,
       {XAVG('revenue', F7)} / ({XAVG('revenue', F90)} + 1e-6) AS demand_trend
FROM daily {WS}"""), dbl="revenue_rolling_mean_90d demand_trend")
def q_demand_trend(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.demand_trend).select(*K, "revenue_rolling_mean_90d", "demand_trend")


@register("promo_recency", sql(f"""
, q AS (SELECT store, date, disc_value, row_number() OVER w - 1 AS i FROM daily {WS})
SELECT store, date,
       COALESCE(i - max(CASE WHEN disc_value > 0 THEN i END)
                  OVER (PARTITION BY store ORDER BY date {EXP}), i) AS days_since_last_promo
FROM q"""))
def q_promo_recency(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.promo_recency).select(*K, "days_since_last_promo")


F14 = "(w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"


@register("discount_rolling14", sql(f"""
SELECT store, date, avg(disc_perc) OVER {F14} AS discount_rolling_mean_14d,
       stddev_samp(disc_perc) OVER {F14} AS discount_rolling_std_14d
FROM daily {WS}"""), dbl="discount_rolling_mean_14d discount_rolling_std_14d")
def q_discount_rolling14(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.discount_rolling14).select(
        *K, "discount_rolling_mean_14d", "discount_rolling_std_14d")


@register("first_appearance", sql(f"""
SELECT store, date, CAST(row_number() OVER w = 1 AS INTEGER) AS is_first_appearance_of_store FROM daily {WS}"""))
def q_first_appearance(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.first_appearance).select(*K, "is_first_appearance_of_store")


F30 = "(w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@register("volatility_ratio30", sql(f"""
SELECT store, date, stddev_samp(revenue) OVER {F30} / ({XAVG('revenue', F30)} + 1e-6) AS seasonal_volatility_ratio
FROM daily {WS}"""), dbl="seasonal_volatility_ratio")
def q_volatility_ratio30(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.volatility_ratio30).select(*K, "seasonal_volatility_ratio")


@register("lead_time", sql(f"""
SELECT store, date, COALESCE(date_diff('day', lag(date, 1) OVER w, date), 0) AS lead_time_days FROM daily {WS}"""))
def q_lead_time(spark, sf_dir):
    return _by_store(spark, sf_dir).transform(W.lead_time).select(*K, "lead_time_days")


@register("smooth_residuals", sql(f"""
, q AS (SELECT store, date, revenue - {XAVG('revenue', '(PARTITION BY store, day_of_week)')} AS residual FROM daily)
SELECT store, date, residual,
       quantile_cont(abs(residual), 0.5) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
         AS smoothed_abs_residual
FROM q"""), dbl="residual smoothed_abs_residual")
def q_smooth_residuals(spark, sf_dir):
    d = _by_store(spark, sf_dir).transform(W.store_baselines)
    d = d.withColumn("residual", F.col("revenue") - F.col("store_dayofweek_avg"))
    return d.transform(W.smooth_residuals).select(*K, "residual", "smoothed_abs_residual")
