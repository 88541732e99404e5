"""§2.10 interval operators over a prediction table derived from the sales history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.operators import intervals as I
from tillcast.operators import windows as W
from tillcast.plans import base
from tillcast.plans.registry import register
from tillcast.plans.sqlbase import XAVG, sql

K = ["store", "date"]
P = ["p10", "p50", "p90"]
PDBL = "p10 p50 p90"

PP_SQL = f"""
, pp0 AS (SELECT d.*, {XAVG('revenue', 'w28')} AS p50, stddev_samp(revenue) OVER w28 AS s28,
                 stddev_samp(revenue) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS revenue_std
          FROM daily d WINDOW w28 AS (PARTITION BY store ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
, pp AS (SELECT *, p50 - s28 AS p10, p50 + s28 AS p90 FROM pp0 WHERE p50 IS NOT NULL AND s28 IS NOT NULL)"""


def pp(spark, sf_dir):
    d = base.daily_by_store(spark, sf_dir)
    d = d.withColumn("revenue_std", F.stddev_samp("revenue").over(W.wsd().rowsBetween(W.Window.unboundedPreceding, 0)))
    return I.past_predictions(d)


@register("interval_spread", sql(f"{PP_SQL} SELECT store, date, revenue, p10, p50, p90 FROM pp"), dbl=PDBL)
def q_interval_spread(spark, sf_dir):
    d = base.daily_by_store(spark, sf_dir)
    w = W.wsd().rowsBetween(-28, -1)
    from tillcast.functions.columns import xavg
    d = d.withColumn("p50", xavg("revenue", w)).withColumn("spread", F.stddev_samp("revenue").over(w))
    d = d.where(F.col("p50").isNotNull() & F.col("spread").isNotNull())
    return I.interval_spread(d).select(*K, "revenue", *P)


@register("band_residual", sql(f"""{PP_SQL}
, s AS (SELECT store, day_of_week, stddev_samp(revenue) AS sr FROM daily GROUP BY store, day_of_week)
SELECT pp.store, pp.date, pp.p50 - s.sr AS p10, pp.p50, pp.p50 + s.sr AS p90
FROM pp LEFT JOIN s ON s.store = pp.store AND s.day_of_week = pp.day_of_week"""), dbl=PDBL)
def q_band_residual(spark, sf_dir):
    return I.band_residual(pp(spark, sf_dir), base.daily(spark, sf_dir)).select(*K, *P)


SORT_SQL = """
SELECT store, date, list_sort([GREATEST(p10, 0.0), p50, p90])[1] AS p10, list_sort([GREATEST(p10, 0.0), p50, p90])[2] AS p50,
       list_sort([GREATEST(p10, 0.0), p50, p90])[3] AS p90 FROM {src}"""


@register("band_sort", sql(f"""{PP_SQL}
, b AS (SELECT store, date, p50 - 3.0 * (p90 - p50) AS p10, p50, p50 - (p90 - p50) AS p90 FROM pp)
{SORT_SQL.format(src='b')}"""), dbl=PDBL)
def q_band_sort(spark, sf_dir):
    d = pp(spark, sf_dir).select(*K, (F.col("p50") - (F.col("p90") - F.col("p50")) * 3.0).alias("p10"), "p50",
                 (F.col("p50") - (F.col("p90") - F.col("p50"))).alias("p90"))
    return I.band_sort(d).select(*K, *P)


@register("p10_floor", sql(f"""{PP_SQL}
, m AS (SELECT store, month, day_of_week, {XAVG('revenue')} AS smw FROM daily GROUP BY store, month, day_of_week)
SELECT pp.store, pp.date, GREATEST(pp.p10, COALESCE(m.smw * 0.7, 0.0)) AS p10
FROM pp LEFT JOIN m ON m.store = pp.store AND m.month = pp.month AND m.day_of_week = pp.day_of_week"""), dbl="p10")
def q_p10_floor(spark, sf_dir):
    return I.p10_floor(pp(spark, sf_dir), base.daily(spark, sf_dir)).select(*K, "p10")


@register("wide_fallback", sql(f"""{PP_SQL}
, st AS (SELECT avg(p90 - p10) AS mw, avg(revenue_std) AS ms FROM pp), g AS (SELECT {XAVG('revenue')} AS gm FROM daily)
, w AS (SELECT pp.*, st.mw > st.ms * 0.5 AS wide, g.gm FROM pp CROSS JOIN st CROSS JOIN g)
SELECT store, date, CASE WHEN wide THEN gm * 0.8 ELSE p10 END AS p10, CASE WHEN wide THEN gm ELSE p50 END AS p50,
       CASE WHEN wide THEN gm * 1.2 ELSE p90 END AS p90, CAST(wide AS INTEGER) AS wide_fallback FROM w"""), dbl=PDBL)
def q_wide_fallback(spark, sf_dir):
    # factor 0.5 instead of 3 so that the rule fires on the driver tables
    return I.wide_fallback(pp(spark, sf_dir), base.daily(spark, sf_dir), factor=0.5).select(*K, *P, "wide_fallback")


@register("reject_wide", sql(f"""{PP_SQL}
, b AS (SELECT store, date, p10 - 8.0 * p50 AS p10, p50, p90 + 8.0 * p50 * (day_of_week % 2) AS p90 FROM pp)
SELECT store, date,
       CASE WHEN p50 < 1e-3 OR p90 - p10 > 15.0 * GREATEST(p50, 1.0) THEN NULL ELSE p10 END AS p10,
       CASE WHEN p50 < 1e-3 OR p90 - p10 > 15.0 * GREATEST(p50, 1.0) THEN NULL ELSE p50 END AS p50,
       CASE WHEN p50 < 1e-3 OR p90 - p10 > 15.0 * GREATEST(p50, 1.0) THEN NULL ELSE p90 END AS p90 FROM b"""), dbl=PDBL)
def q_reject_wide(spark, sf_dir):
    d = pp(spark, sf_dir).select(*K, (F.col("p10") - F.col("p50") * 8.0).alias("p10"), "p50",
                                 (F.col("p90") + F.col("p50") * 8.0 * (F.col("day_of_week") % 2)).alias("p90"))
    return I.reject_wide(d).select(*K, *P)


@register("blend_rules", sql(f"""{PP_SQL}
, idx AS (SELECT store, month, day_of_week, {XAVG('revenue')} AS smw FROM daily GROUP BY store, month, day_of_week)
, f AS (SELECT pp.*, idx.smw AS store_month_weekday_avg,
               {XAVG('revenue', '(PARTITION BY pp.store ORDER BY pp.date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS revenue_last_3_days,
               lag(revenue, 7) OVER (PARTITION BY pp.store ORDER BY pp.date) AS l7,
               lag(revenue, 14) OVER (PARTITION BY pp.store ORDER BY pp.date) AS l14,
               lag(revenue, 30) OVER (PARTITION BY pp.store ORDER BY pp.date) AS l30
        FROM pp LEFT JOIN idx ON idx.store = pp.store AND idx.month = pp.month AND idx.day_of_week = pp.day_of_week)
SELECT store, date,
       ((p50 * 0.5 + COALESCE(store_month_weekday_avg, 0.0) * 0.5) * 0.5 + revenue_last_3_days * 0.5) * 0.5
         + (l7 + l14 + l30) / 3.0 * 0.5 AS p50
FROM f"""), dbl="p50")
def q_blend_rules(spark, sf_dir):
    from tillcast.operators.lookups import seasonal_join
    d = pp(spark, sf_dir)
    d = seasonal_join(d, base.daily(spark, sf_dir)).drop("month", "weekday")
    d = d.transform(W.last3).transform(lambda x: W.lags(x, ns=(7, 14, 30)))
    return I.blend_rules(d).select(*K, "p50")


@register("min_history", sql(f"""{PP_SQL}
, g AS (SELECT store, day_of_week, month, min(revenue) AS mn, {XAVG('revenue')} AS av FROM daily GROUP BY store, day_of_week, month)
SELECT pp.store, pp.date, CASE WHEN pp.p50 < g.mn THEN g.av ELSE pp.p50 END AS p50
FROM pp LEFT JOIN g ON g.store = pp.store AND g.day_of_week = pp.day_of_week AND g.month = pp.month"""), dbl="p50")
def q_min_history(spark, sf_dir):
    return I.min_history(pp(spark, sf_dir), base.daily(spark, sf_dir)).select(*K, "p50")


@register("conformal_fit", sql(f"""{PP_SQL}
, sc AS (SELECT CASE WHEN revenue >= p10 AND revenue <= p90 THEN abs((revenue - p50) / NULLIF(p90 - p10, 0))
                     ELSE 1.0 + abs((revenue - p50) / NULLIF(p90 - p10, 0)) END AS score FROM pp)
SELECT count(score) AS n, CASE WHEN count(score) >= 100 THEN quantile_cont(score, 0.9) END AS q_adjust FROM sc"""),
          dbl="q_adjust")
def q_conformal_fit(spark, sf_dir):
    return I.conformal_fit(pp(spark, sf_dir))


@register("conformal_apply", sql(f"""{PP_SQL}
, sc AS (SELECT CASE WHEN revenue >= p10 AND revenue <= p90 THEN abs((revenue - p50) / NULLIF(p90 - p10, 0))
                     ELSE 1.0 + abs((revenue - p50) / NULLIF(p90 - p10, 0)) END AS score FROM pp)
, q AS (SELECT CASE WHEN count(score) >= 100 THEN quantile_cont(score, 0.9) END AS q_adjust FROM sc)
SELECT store, date, p10 - COALESCE(q_adjust, 0.0) * (p90 - p10) AS p10, p50,
       p90 + COALESCE(q_adjust, 0.0) * (p90 - p10) AS p90 FROM pp CROSS JOIN q"""), dbl=PDBL)
def q_conformal_apply(spark, sf_dir):
    d = pp(spark, sf_dir)
    return I.conformal_apply(d, I.conformal_fit(d)).select(*K, *P)


@register("normal_band", sql(f"""{PP_SQL}
SELECT store, date, p50 - {I.Z90} * s28 AS p10, p50, p50 + {I.Z90} * s28 AS p90 FROM pp"""), dbl=PDBL)
def q_normal_band(spark, sf_dir):
    d = pp(spark, sf_dir).withColumn("uncertainty", (F.col("p90") - F.col("p50")))
    return I.normal_band(d).select(*K, *P)


POS_SQL = f"""{PP_SQL}
, pos AS (SELECT store, date, store_cluster,
                 CASE WHEN revenue >= p10 AND revenue <= p90 THEN (revenue - p10) / (p90 - p10)
                      WHEN revenue < p10 THEN 0.0 ELSE 1.0 END AS position FROM pp)"""


@register("band_position", sql(f"{POS_SQL} SELECT store, date, position FROM pos"), dbl="position")
def q_band_position(spark, sf_dir):
    return I.band_position(pp(spark, sf_dir)).select(*K, "position")


@register("binned_position", sql(f"""{POS_SQL}
, agg AS (SELECT store_cluster, CAST(floor(position * 99) AS INTEGER) AS bin, avg(position) AS mp FROM pos
          WHERE position < 1.0 GROUP BY 1, 2)
, sc AS (SELECT DISTINCT store_cluster, b.bin FROM pos CROSS JOIN (SELECT range AS bin FROM range(0, 99)) b)
SELECT sc.store_cluster, sc.bin, (sc.bin + 0.5) / 99.0 AS bin_center, COALESCE(agg.mp, (sc.bin + 0.5) / 99.0) AS binned_position
FROM sc LEFT JOIN agg ON agg.store_cluster = sc.store_cluster AND agg.bin = sc.bin"""), dbl="bin_center binned_position")
def q_binned_position(spark, sf_dir):
    return I.binned_position(I.band_position(pp(spark, sf_dir)))


@register("forecast_metrics", sql(f"""{PP_SQL}
SELECT avg(CAST(revenue >= p10 AND revenue <= p90 AS DOUBLE)) * 100.0 AS coverage, avg(p90 - p10) AS sharpness,
       sqrt(avg((revenue - p50) * (revenue - p50))) AS rmse, avg(abs(revenue - p50)) AS mae FROM pp"""),
          dbl="coverage sharpness rmse mae")
def q_forecast_metrics(spark, sf_dir):
    return I.forecast_metrics(pp(spark, sf_dir))


@register("r2", sql(f"""{PP_SQL}
, m AS (SELECT avg(revenue) AS ym FROM pp)
SELECT 1.0 - sum(pow(revenue - p50, 2)) / sum(pow(revenue - ym, 2)) AS r2 FROM pp CROSS JOIN m"""), dbl="r2")
def q_r2(spark, sf_dir):
    return I.r2(pp(spark, sf_dir))


@register("coverage_miss", sql(f"""{PP_SQL}
SELECT count_if(revenue < p10 OR revenue > p90) AS n_miss, avg(CAST(revenue < p10 OR revenue > p90 AS DOUBLE)) AS miss_rate
FROM pp"""), dbl="miss_rate")
def q_coverage_miss(spark, sf_dir):
    return I.coverage_miss(pp(spark, sf_dir))
