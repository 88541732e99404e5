"""Scoring variants of single operators: saved tiers, lead time, floors and fallbacks of a request."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.functions.columns import clip
from tillcast.operators import encoding as E
from tillcast.operators import intervals as I
from tillcast.operators import transforms as T
from tillcast.operators import windows as W
from tillcast.plans import base
from tillcast.plans.q_intervals import PP_SQL, pp
from tillcast.plans.q_reports import tier_sql
from tillcast.plans.q_transforms import ALIGN_EXPECTED
from tillcast.plans.registry import register
from tillcast.plans.sqlbase import XAVG, sql

K = ["store", "date"]
SEEN = "store_cluster = 'PREMIUM_OFFLINE'"


@register("tiers_apply", sql(f"""
, seen AS (SELECT * FROM daily WHERE {SEEN})
, t AS ({tier_sql('city', 'seen')})
SELECT d.store, d.date, (['D', 'C', 'B', 'A'])[COALESCE(CASE WHEN t.score IS NULL THEN 0 ELSE t.tier_code END, 0) + 1] AS city_tier,
       COALESCE(CASE WHEN t.score IS NULL THEN 0 ELSE t.tier_code END, 0) AS city_tier_encoded
FROM daily d LEFT JOIN t ON t.value = d.city"""))
def q_tiers_apply(spark, sf_dir):
    """Tiers fitted on one cluster's cities, applied to all rows: cities that the fit hasn't seen are in tier D."""
    d = base.daily(spark, sf_dir)
    return E.apply_tiers(d, E.tiers_filled(d.where(SEEN), "city"), "city").select(*K, "city_tier", "city_tier_encoded")


CUT = "2020-06-01"


@register("lead_time_scoring", sql(f"""
SELECT store, date, date_diff('day', (SELECT max(date) FROM daily WHERE date < DATE '{CUT}'), date) AS lead_time_days
FROM daily WHERE date >= DATE '{CUT}'"""))
def q_lead_time_scoring(spark, sf_dir):
    d = base.daily(spark, sf_dir)
    return W.lead_time_scoring(d.where(F.col("date") >= CUT), d.where(F.col("date") < CUT)).select(*K, "lead_time_days")


@register("p10_floor_weekday", sql(f"""{PP_SQL}
, m AS (SELECT store, day_of_week, {XAVG('revenue')} AS sw FROM daily GROUP BY store, day_of_week)
SELECT pp.store, pp.date, GREATEST(pp.p10, m.sw * 0.7) AS p10 FROM pp LEFT JOIN m ON m.store = pp.store AND m.day_of_week = pp.day_of_week"""), dbl="p10")
def q_p10_floor_weekday(spark, sf_dir):
    return I.p10_floor_weekday(pp(spark, sf_dir), base.daily(spark, sf_dir)).select(*K, "p10")


AVG_SQL = f"""
, sw AS (SELECT store, date, {XAVG('revenue', '(PARTITION BY store, day_of_week)')} AS store_dayofweek_avg FROM daily)
, ppf AS (SELECT pp.*, sw.store_dayofweek_avg FROM pp JOIN sw ON sw.store = pp.store AND sw.date = pp.date)"""


@register("model_vs_fallback", sql(f"""{PP_SQL}{AVG_SQL}
SELECT store, date, CASE WHEN abs(p50 * (1 + day_of_week) - store_dayofweek_avg) > store_dayofweek_avg * 2.0
                         THEN store_dayofweek_avg * 0.5 + p50 * (1 + day_of_week) * 0.5 ELSE p50 * (1 + day_of_week) END AS p50 FROM ppf"""), dbl="p50")
def q_model_vs_fallback(spark, sf_dir):
    """A prediction that grows with the weekday, blended with the weekday mean where it is far from it."""
    d = base.daily_by_store(spark, sf_dir).transform(W.store_baselines)
    avg = d.select(*K, "store_dayofweek_avg")
    p = pp(spark, sf_dir).join(avg, K).withColumn("pred", F.col("p50") * (F.col("day_of_week") + 1))
    return I.model_vs_fallback(p, "pred", "store_dayofweek_avg").select(*K, "p50")




@register("fallback_sparse", sql(f"""{PP_SQL}{AVG_SQL}
, f AS (SELECT *, CASE WHEN day_of_week = 1 THEN 0.0 ELSE disc_perc END AS f1, CASE WHEN day_of_week = 2 THEN NULL WHEN day_of_week = 1 THEN 0.0 ELSE s28 END AS f2,
               CASE WHEN day_of_week = 2 THEN NULL WHEN day_of_week = 1 THEN 0.0 ELSE store_area END AS f3 FROM ppf)
SELECT store, date, CAST(day_of_week IN (1, 2) OR f1 + f2 + f3 = 0 AS INTEGER) AS fallback_triggered,
       CASE WHEN day_of_week IN (1, 2) OR f1 + f2 + f3 = 0 THEN store_dayofweek_avg ELSE p50 END AS p50 FROM f"""), dbl="p50")
def q_fallback_sparse(spark, sf_dir):
    """Requests with zero features (Tuesdays) or mostly null ones (Wednesdays) take the fallback."""
    avg = base.daily_by_store(spark, sf_dir).transform(W.store_baselines).select(*K, "store_dayofweek_avg")
    p = pp(spark, sf_dir).join(avg, K)
    dow, null = F.col("day_of_week"), F.lit(None).cast("double")
    p = p.withColumns({"f1": F.when(dow == 1, 0.0).otherwise(F.col("disc_perc")),
                       "f2": F.when(dow == 2, null).when(dow == 1, 0.0).otherwise(F.col("p90") - F.col("p50")),
                       "f3": F.when(dow == 2, null).when(dow == 1, 0.0).otherwise(F.col("store_area"))})
    return I.fallback_sparse(p, ("f1", "f2", "f3"), "store_dayofweek_avg").select(*K, "fallback_triggered", "p50")


@register("anchor_features", sql(f"""
, a AS (SELECT store, date, lag(revenue, 30) OVER w AS revenue_lag_30,
               {XAVG('revenue', '(w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS revenue_rolling_mean_7d,
               LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0) AS discount_pct, CAST(month AS DOUBLE) AS month,
               {XAVG('revenue', '(PARTITION BY store, day_of_week)')} AS store_dayofweek_avg,
               {XAVG('revenue', '(PARTITION BY store, month)')} AS store_month_avg
        FROM daily WINDOW w AS (PARTITION BY store ORDER BY date))
SELECT store, date,
       COALESCE(last(revenue_lag_30 IGNORE NULLS) OVER f, 0.0) AS revenue_lag_30,
       COALESCE(last(revenue_rolling_mean_7d IGNORE NULLS) OVER f, 0.0) AS revenue_rolling_mean_7d,
       COALESCE(last(discount_pct IGNORE NULLS) OVER f, 0.0) AS discount_pct,
       0.0::DOUBLE AS missing_feature, month, 0.0::DOUBLE AS revenue_lag_7, store_dayofweek_avg, store_month_avg
FROM a WINDOW f AS (PARTITION BY store ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
          dbl="revenue_lag_30 revenue_rolling_mean_7d discount_pct missing_feature month revenue_lag_7 store_dayofweek_avg store_month_avg")
def q_anchor_features(spark, sf_dir):
    """Anchors that a pruned table lacks (the 7-row lag) are added as 0, those that it has stay; then the table is aligned."""
    d = base.daily_by_store(spark, sf_dir).transform(lambda x: W.lags(x, ns=(30,))).transform(
        lambda x: W.rolling_lagged(x, windows=(7,))).transform(W.store_baselines)
    d = d.withColumn("discount_pct", clip(F.col("disc_perc") / 100.0, 0.0, 1.0)).withColumn("extra_feature", F.lit(1.0))
    return T.align_features(T.anchor_features(d), [*ALIGN_EXPECTED, *(a for a in T.ANCHORS if a not in ALIGN_EXPECTED)])
