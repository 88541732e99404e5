"""§2.2 projections / cleaning / targets as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillcast.functions.columns import clip
from tillcast.operators import transforms as T
from tillcast.operators import windows as W
from tillcast.operators.calendar import cyclic_1, cyclic_23, festival_season, weekend_discount
from tillcast.operators.lookups import is_festival
from tillcast.operators.reports import feature_bounds, target_encode
from tillcast.plans import base
from tillcast.plans.registry import register
from tillcast.plans.sqlbase import XAVG, sql
from tillcast.sources.festivals import festivals

K = ["store", "date"]
LOW_ACTIVITY_THRESHOLD = 45000.0  # driver revenue scale (reference default 100)
CLUSTERS = ["ONLINE", "PREMIUM_OFFLINE", "SEASONAL_SPECIALIST", "HOLIDAY_SPECIALIST"]


def feature_base(spark, sf_dir):
    """daily + discount_pct + target encodings + store_area_bucket + row lag 7 + expanding std."""
    d = base.daily(spark, sf_dir).withColumn("discount_pct", clip(F.col("disc_perc") / 100.0, 0.0, 1.0))
    d = target_encode(d)
    d = T.qcut(d, "store_area", 5, "store_area_bucket")
    d = d.withColumn("revenue_lag_7", F.lag("revenue", 7).over(W.wsd()))
    d = d.withColumn("revenue_std", F.stddev_samp("revenue").over(
        W.wsd().rowsBetween(Window.unboundedPreceding, 0)))
    return d


def _enc_sql(k):
    return f"SELECT {k}, {XAVG('revenue')} AS {k}_encoded FROM daily GROUP BY {k}"


FB_SQL = f"""
, ce AS ({_enc_sql('city')}), re AS ({_enc_sql('region')}), ch AS ({_enc_sql('channel')})
, e5 AS (SELECT quantile_cont(store_area, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM daily)
, fb AS (
  SELECT d.*, LEAST(GREATEST(d.disc_perc / 100.0, 0.0), 1.0) AS discount_pct,
         COALESCE(ce.city_encoded, 0.0) AS city_encoded, COALESCE(re.region_encoded, 0.0) AS region_encoded,
         COALESCE(ch.channel_encoded, 0.0) AS channel_encoded,
         CASE WHEN d.store_area IS NOT NULL THEN
           len(list_filter((list_sort(list_distinct(e5.e)))[2:len(list_distinct(e5.e)) - 1], lambda v: v < d.store_area))
         END AS store_area_bucket,
         lag(d.revenue, 7) OVER (PARTITION BY d.store ORDER BY d.date) AS revenue_lag_7,
         stddev_samp(d.revenue) OVER (PARTITION BY d.store ORDER BY d.date
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS revenue_std
  FROM daily d LEFT JOIN ce ON d.city = ce.city LEFT JOIN re ON d.region = re.region
       LEFT JOIN ch ON d.channel = ch.channel CROSS JOIN e5)"""

PI2 = "(2.0 * pi())"


@register("cyclic_1", sql(f"""
SELECT store, date, sin({PI2} * day_of_week / 7.0) AS day_of_week_sin, cos({PI2} * day_of_week / 7.0) AS day_of_week_cos,
       sin({PI2} * month / 12.0) AS month_sin, cos({PI2} * month / 12.0) AS month_cos FROM daily"""),
          dbl="day_of_week_sin day_of_week_cos month_sin month_cos")
def q_cyclic_1(spark, sf_dir):
    return base.daily(spark, sf_dir).transform(cyclic_1).select(*K, "day_of_week_sin", "day_of_week_cos",
                                                                "month_sin", "month_cos")


def _h(h):
    return (f"sin({h} * {PI2} * day_of_year / 365.0) AS day_of_year_sin{h}, "
            f"cos({h} * {PI2} * day_of_year / 365.0) AS day_of_year_cos{h}, "
            f"sin({h} * {PI2} * week_of_year / 52.0) AS week_of_year_sin{h}, "
            f"cos({h} * {PI2} * week_of_year / 52.0) AS week_of_year_cos{h}")


CY23 = [f"{a}{h}" for h in (2, 3) for a in ("day_of_year_sin", "day_of_year_cos", "week_of_year_sin", "week_of_year_cos")]


@register("cyclic_23", sql(f"SELECT store, date, {_h(2)}, {_h(3)} FROM daily"), dbl=" ".join(CY23))
def q_cyclic_23(spark, sf_dir):
    return base.daily(spark, sf_dir).transform(cyclic_23).select(*K, *CY23)


@register("interactions", sql(f"""{FB_SQL}
, i1 AS (SELECT *, store_area * city_encoded AS store_area_city_interaction FROM fb)
SELECT store, date, store_area_city_interaction,
       store_area * region_encoded AS store_area_region_interaction,
       is_online * city_encoded AS online_city_interaction,
       discount_pct * store_area_bucket AS discount_store_tier_interaction,
       discount_pct * region_encoded AS discount_region_interaction,
       discount_pct * city_encoded AS discount_city_interaction,
       month * region_encoded AS month_region_interaction,
       month * store_area_bucket AS month_store_tier_interaction,
       revenue_lag_7 * discount_pct AS revenue_lag_7_discount_interaction,
       revenue_std * discount_pct AS revenue_std_discount_interaction,
       store_area_city_interaction * discount_pct AS premium_location_discount,
       month * store_area_city_interaction AS seasonal_premium_location
FROM i1"""), dbl=" ".join(T.INTERACTIONS))
def q_interactions(spark, sf_dir):
    return feature_base(spark, sf_dir).transform(T.interactions).select(*K, *T.INTERACTIONS)


@register("seasonal_cross", sql(f"""{FB_SQL}
, si AS (SELECT *, quantile_cont(revenue, 0.5) OVER (PARTITION BY store, month ORDER BY date
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                   / NULLIF(quantile_cont(revenue, 0.5) OVER (PARTITION BY store, month), 0) AS seasonal_index FROM fb)
SELECT store, date, store_area_bucket, seasonal_index * store_area_bucket AS store_seasonal_index,
       seasonal_index * region_encoded AS region_seasonal_index FROM si"""),
          dbl="store_seasonal_index region_seasonal_index")
def q_seasonal_cross(spark, sf_dir):
    return feature_base(spark, sf_dir).transform(W.seasonal_index).transform(T.seasonal_cross).select(
        *K, "store_area_bucket", "store_seasonal_index", "region_seasonal_index")


@register("qcut_area", sql(f"""{FB_SQL}
SELECT store, date, store_area, store_area_bucket FROM fb"""), dbl="store_area")
def q_qcut_area(spark, sf_dir):
    return feature_base(spark, sf_dir).select(*K, "store_area", "store_area_bucket")


@register("poly_terms", sql(f"""{FB_SQL}
SELECT store, date, pow(discount_pct, 2) AS discount_pct_squared, pow(store_area, 2) AS store_area_squared FROM fb"""),
          dbl="discount_pct_squared store_area_squared")
def q_poly_terms(spark, sf_dir):
    return feature_base(spark, sf_dir).transform(T.poly_terms).select(*K, "discount_pct_squared", "store_area_squared")


@register("channel_season", sql(f"""{FB_SQL}
SELECT store, date, channel_encoded * sin({PI2} * month / 12.0) AS channel_month_sin,
       channel_encoded * cos({PI2} * month / 12.0) AS channel_month_cos FROM fb"""),
          dbl="channel_month_sin channel_month_cos")
def q_channel_season(spark, sf_dir):
    return feature_base(spark, sf_dir).transform(cyclic_1).transform(T.channel_season).select(
        *K, "channel_month_sin", "channel_month_cos")


@register("event_discount", sql("""
, fd AS (SELECT DISTINCT date FROM festivals)
, e AS (SELECT d.*, CAST((fd.date IS NOT NULL) OR d.is_weekend = 1 AS INTEGER) AS is_event
        FROM daily d LEFT JOIN fd ON fd.date = d.date)
SELECT store, date, is_event, is_event * disc_perc AS event_discount_interaction FROM e"""),
          dbl="event_discount_interaction")
def q_event_discount(spark, sf_dir):
    d = is_festival(base.daily(spark, sf_dir), festivals(spark))
    return d.transform(T.event_discount).select(*K, "is_event", "event_discount_interaction")


@register("weekday_store_ord", sql("""
, o AS (SELECT store, dense_rank() OVER (ORDER BY store) - 1 AS store_id_ord FROM (SELECT DISTINCT store FROM daily))
SELECT d.store, d.date, o.store_id_ord, d.day_of_week * 10000 + o.store_id_ord AS weekday_store_ord
FROM daily d JOIN o ON o.store = d.store"""))
def q_weekday_store_ord(spark, sf_dir):
    return base.daily(spark, sf_dir).transform(T.weekday_store_ord).select(*K, "store_id_ord", "weekday_store_ord")


@register("festival_season", sql(f"""{FB_SQL}
SELECT store, date, CAST(month IN (10, 11, 12, 1, 2) AS INTEGER) AS is_festival_season,
       CAST(month IN (10, 11, 12, 1, 2) AS INTEGER) * discount_pct AS festival_discount_interaction,
       is_weekend * discount_pct AS weekend_discount_interaction FROM fb"""),
          dbl="festival_discount_interaction weekend_discount_interaction")
def q_festival_season(spark, sf_dir):
    d = feature_base(spark, sf_dir).transform(festival_season).transform(weekend_discount)
    return d.select(*K, "is_festival_season", "festival_discount_interaction", "weekend_discount_interaction")


@register("cluster_log", sql("""
SELECT store, date, store_cluster,
       CASE WHEN store_cluster = 'ONLINE' THEN ln(1 + revenue + 100.0)
            WHEN store_cluster IN ('PREMIUM_OFFLINE', 'SEASONAL_SPECIALIST') THEN revenue
            ELSE ln(1 + revenue) END AS revenue_t,
       CASE WHEN store_cluster = 'ONLINE' THEN ln(1 + qty_sold + 10.0)
            WHEN store_cluster IN ('PREMIUM_OFFLINE', 'SEASONAL_SPECIALIST', 'HOLIDAY_SPECIALIST') THEN qty_sold
            ELSE ln(1 + qty_sold) END AS qty_sold_t
FROM daily"""), dbl="revenue_t qty_sold_t")
def q_cluster_log(spark, sf_dir):
    return base.daily(spark, sf_dir).transform(T.cluster_log).select(*K, "store_cluster", "revenue_t", "qty_sold_t")


@register("union_clusters", sql("""
SELECT store, date, store_cluster,
       CASE WHEN store_cluster = 'ONLINE' THEN ln(1 + revenue + 100.0)
            WHEN store_cluster IN ('PREMIUM_OFFLINE', 'SEASONAL_SPECIALIST') THEN revenue
            ELSE ln(1 + revenue) END AS revenue_t
FROM daily"""), dbl="revenue_t")
def q_union_clusters(spark, sf_dir):
    return T.cluster_log_union(base.daily(spark, sf_dir), CLUSTERS).select(*K, "store_cluster", "revenue_t")


@register("cluster_discount", sql(f"""{FB_SQL}
SELECT store, date,
       CASE WHEN store_cluster = 'ONLINE' THEN pow(discount_pct, 2) END AS discount_squared,
       CASE WHEN store_cluster = 'ONLINE' THEN pow(discount_pct, 3) END AS discount_cubed,
       CASE WHEN store_cluster = 'SEASONAL_SPECIALIST' THEN discount_pct * sin({PI2} * month / 12.0) END AS seasonal_discount,
       CASE WHEN store_cluster = 'HOLIDAY_SPECIALIST' THEN CAST(month IN (10, 11, 12, 1, 2) AS INTEGER) END AS is_holiday_month,
       CASE WHEN store_cluster = 'HOLIDAY_SPECIALIST' THEN discount_pct * CAST(month IN (10, 11, 12, 1, 2) AS INTEGER) END
         AS holiday_discount
FROM fb"""), dbl="discount_squared discount_cubed seasonal_discount holiday_discount")
def q_cluster_discount(spark, sf_dir):
    return feature_base(spark, sf_dir).transform(T.cluster_discount).select(
        *K, "discount_squared", "discount_cubed", "seasonal_discount", "is_holiday_month", "holiday_discount")


CLEAN_SQL = """
, raw AS (SELECT store, date,
                 revenue / NULLIF(lag(revenue, 1) OVER w, 0) - 1.0 AS revenue_day_over_day,
                 lag(revenue, 30) OVER w AS revenue_lag_30,
                 stddev_samp(revenue) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS revenue_last_3_days_std,
                 disc_value / NULLIF(revenue - revenue, 0) AS undefined_ratio
          FROM daily WINDOW w AS (PARTITION BY store ORDER BY date))"""
CLEAN_COLS = ["revenue_day_over_day", "revenue_lag_30", "revenue_last_3_days_std", "undefined_ratio"]


def _raw_for_clean(spark, sf_dir):
    from tillcast.functions.columns import safe_div
    d = base.daily_by_store(spark, sf_dir).transform(W.day_over_day).transform(lambda x: W.lags(x, ns=(30,))).transform(W.last3)
    return d.withColumn("undefined_ratio", safe_div(F.col("disc_value"), F.col("revenue") - F.col("revenue")))


@register("clean_matrix", sql(f"""{CLEAN_SQL}
SELECT store, date, {", ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE {c} END AS {c}" for c in CLEAN_COLS)}
FROM raw"""), dbl=" ".join(CLEAN_COLS))
def q_clean_matrix(spark, sf_dir):
    return T.clean_matrix(_raw_for_clean(spark, sf_dir), CLEAN_COLS).select(*K, *CLEAN_COLS)


@register("fill_hist", sql(f"""{CLEAN_SQL}
, sm AS (SELECT store, date, {XAVG('revenue', '(PARTITION BY store, month)')} AS store_month_avg FROM daily)
SELECT raw.store, raw.date, COALESCE(revenue_lag_30, sm.store_month_avg, 0.0) AS revenue_lag_30,
       COALESCE(revenue_last_3_days_std, 0.0) AS revenue_last_3_days_std
FROM raw JOIN sm ON sm.store = raw.store AND sm.date = raw.date"""), dbl="revenue_lag_30 revenue_last_3_days_std")
def q_fill_hist(spark, sf_dir):
    d = _raw_for_clean(spark, sf_dir).transform(W.store_baselines)
    return T.fill_hist(d, ["revenue_lag_30", "revenue_last_3_days_std"]).select(*K, "revenue_lag_30",
                                                                               "revenue_last_3_days_std")


ALIGN_EXPECTED = ["revenue_lag_30", "revenue_rolling_mean_7d", "discount_pct", "missing_feature", "month"]


@register("align_features", sql(f"""
, a AS (SELECT store, date, lag(revenue, 30) OVER w AS revenue_lag_30,
               {XAVG('revenue', '(w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS revenue_rolling_mean_7d,
               LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0) AS discount_pct, CAST(month AS DOUBLE) AS month
        FROM daily WINDOW w AS (PARTITION BY store ORDER BY date))
SELECT store, date,
       COALESCE(last(revenue_lag_30 IGNORE NULLS) OVER f, 0.0) AS revenue_lag_30,
       COALESCE(last(revenue_rolling_mean_7d IGNORE NULLS) OVER f, 0.0) AS revenue_rolling_mean_7d,
       COALESCE(last(discount_pct IGNORE NULLS) OVER f, 0.0) AS discount_pct,
       0.0 AS missing_feature, month
FROM a WINDOW f AS (PARTITION BY store ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
          dbl="revenue_lag_30 revenue_rolling_mean_7d discount_pct missing_feature month")
def q_align_features(spark, sf_dir):
    d = base.daily_by_store(spark, sf_dir).transform(lambda x: W.lags(x, ns=(30,))).transform(
        lambda x: W.rolling_lagged(x, windows=(7,))).withColumn("discount_pct", clip(F.col("disc_perc") / 100.0, 0.0, 1.0))
    d = d.withColumn("extra_feature", F.lit(1.0))
    return T.align_features(T.anchor_features(d), ALIGN_EXPECTED)


@register("drop_qty", sql("SELECT store, date, revenue, disc_value FROM daily"))
def q_drop_qty(spark, sf_dir):
    return T.drop_qty(base.sales(spark, sf_dir))


@register("low_activity", sql(f"""
SELECT store, date, revenue FROM (
  SELECT store, date, revenue, {XAVG('revenue', '(PARTITION BY store, day_of_week)')} AS m FROM daily)
WHERE m >= {LOW_ACTIVITY_THRESHOLD}"""))
def q_low_activity(spark, sf_dir):
    return T.low_activity(base.daily(spark, sf_dir), LOW_ACTIVITY_THRESHOLD).select(*K, "revenue")


@register("drop_leverage", sql("""
SELECT store, date, revenue FROM daily WHERE revenue <= (SELECT quantile_cont(revenue, 0.995) FROM daily)"""))
def q_drop_leverage(spark, sf_dir):
    return T.drop_leverage(base.daily(spark, sf_dir)).select(*K, "revenue")


IQR_SQL = """
, q AS (SELECT quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.75) AS q3 FROM daily)
, b AS (SELECT q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM q)"""


@register("iqr_cap", sql(f"""{IQR_SQL}
SELECT store, date, CASE WHEN revenue < lo THEN lo WHEN revenue > hi THEN hi ELSE revenue END AS revenue
FROM daily CROSS JOIN b"""), dbl="revenue")
def q_iqr_cap(spark, sf_dir):
    return T.iqr_cap(base.daily(spark, sf_dir))[0].select(*K, "revenue")


@register("iqr_report", sql(f"""{IQR_SQL}
SELECT count_if(revenue < lo OR revenue > hi) AS n_outliers, min(lo) AS lower_bound, min(hi) AS upper_bound
FROM daily CROSS JOIN b"""), dbl="lower_bound upper_bound")
def q_iqr_report(spark, sf_dir):
    return T.iqr_cap(base.daily(spark, sf_dir))[1]


@register("cap_store_month", sql("""
SELECT store, date, LEAST(revenue, quantile_cont(revenue, 0.95) OVER (PARTITION BY store, month)) AS revenue FROM daily"""),
          dbl="revenue")
def q_cap_store_month(spark, sf_dir):
    return T.cap_store_month(base.daily(spark, sf_dir)).select(*K, "revenue")


BOUND_COLS = ["revenue", "disc_value", "disc_perc"]


@register("clip_train_range", sql(f"""
, bnd AS (SELECT {", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in BOUND_COLS)} FROM daily)
SELECT store, date, {", ".join(f"CASE WHEN {c} = 0 THEN {c} ELSE LEAST(GREATEST({c}, lo_{c}), hi_{c}) END AS {c}" for c in BOUND_COLS)}
FROM daily CROSS JOIN bnd"""), dbl=" ".join(BOUND_COLS))
def q_clip_train_range(spark, sf_dir):
    d = base.daily(spark, sf_dir)
    return T.clip_train_range(d, feature_bounds(d, BOUND_COLS), BOUND_COLS).select(*K, *BOUND_COLS)


RT_SQL = f"""
, rt AS (SELECT store, date, revenue, {XAVG('revenue', '(PARTITION BY store, day_of_week)')} AS store_dayofweek_avg FROM daily)
, rt2 AS (SELECT *, revenue / NULLIF(store_dayofweek_avg, 0) AS target_ratio,
                 ln(1 + revenue / NULLIF(store_dayofweek_avg, 0)) AS target_log_ratio FROM rt)"""


@register("ratio_target", sql(f"{RT_SQL} SELECT store, date, target_ratio, target_log_ratio FROM rt2"),
          dbl="target_ratio target_log_ratio")
def q_ratio_target(spark, sf_dir):
    return base.daily_by_store(spark, sf_dir).transform(W.store_baselines).transform(T.ratio_target).select(
        *K, "target_ratio", "target_log_ratio")


@register("inverse_target", sql(f"""{RT_SQL}
SELECT store, date, COALESCE(CASE WHEN isinf(v) OR isnan(v) THEN NULL ELSE v END, store_dayofweek_avg) AS revenue_pred
FROM (SELECT *, (exp(LEAST(GREATEST(target_log_ratio, -10.0), 10.0)) - 1) * store_dayofweek_avg AS v FROM rt2)"""),
          dbl="revenue_pred:4")
def q_inverse_target(spark, sf_dir):
    d = base.daily_by_store(spark, sf_dir).transform(W.store_baselines).transform(T.ratio_target)
    return T.inverse_target(d, "target_log_ratio").select(*K, "revenue_pred")


@register("inverse_scaled", sql(f"""
, p AS (SELECT store, date, ln(1 + revenue) AS pred FROM daily)
, m AS (SELECT {XAVG('revenue')} AS target_mean FROM daily)
, pm AS (SELECT avg(pred) AS train_pred_mean FROM p)
SELECT store, date, (exp(pred) - 1) * target_mean / (exp(train_pred_mean) - 1) AS revenue_pred
FROM p CROSS JOIN m CROSS JOIN pm"""), dbl="revenue_pred")
def q_inverse_scaled(spark, sf_dir):
    from tillcast.functions.columns import xavg
    d = base.daily(spark, sf_dir).withColumn("pred", F.log1p("revenue"))
    stats = d.agg(xavg("revenue").alias("target_mean"), F.avg("pred").alias("train_pred_mean"))
    return T.inverse_scaled(d.crossJoin(F.broadcast(stats)), "pred", "target_mean", "train_pred_mean").select(
        *K, "revenue_pred")
