"""§2.3 scoring-time lookups as registered queries.

Requests are every store-day of the sales table (with its discount as the
planned discount) scored against the whole history, so the work grows with
the tables.  The oracles use the literal per-request definitions (range
joins on store and date), which independently check the as-of logic.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.functions.columns import clip
from tillcast.operators import lookups as L
from tillcast.plans import base
from tillcast.plans.registry import register
from tillcast.plans.sqlbase import XAVG, sql
from tillcast.sources.festivals import festivals

R_SQL = ", r AS (SELECT store, date, LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0) AS discount_pct FROM daily)"
LAGS = L.LAG_DAYS


def _hist(spark, sf_dir):
    d = base.daily(spark, sf_dir)
    return d.withColumn("discount_pct", clip(F.col("disc_perc") / 100.0, 0.0, 1.0))


def _req(spark, sf_dir):
    return L.requests_from(base.daily(spark, sf_dir))


LAG_SQL_JOIN = " ".join(f"LEFT JOIN daily h{n} ON h{n}.store = r.store AND h{n}.date = r.date - {n}" for n in LAGS)
LAG_SQL_COLS = ", ".join(f"h{n}.revenue AS revenue_lag_{n}" for n in LAGS)
DIFF_SQL = ", ".join(f"h{a}.revenue - h{b}.revenue AS revenue_lag_diff_{a}_{b}" for a, b in [(1, 3), (3, 7), (7, 14), (14, 30)])
DIFF_COLS = "revenue_lag_diff_1_3 revenue_lag_diff_3_7 revenue_lag_diff_7_14 revenue_lag_diff_14_30"


@register("lag_exact_date", sql(f"""{R_SQL}
SELECT r.store, r.date, r.discount_pct, {LAG_SQL_COLS}, {DIFF_SQL} FROM r {LAG_SQL_JOIN}"""),
          dbl="discount_pct " + DIFF_COLS)
def q_lag_exact_date(spark, sf_dir):
    return L.lag_exact_date(_req(spark, sf_dir), _hist(spark, sf_dir))


PAIRS_SQL = """
, pairs AS (SELECT r.store, r.date, h.revenue, h.discount_pct AS h_discount_pct,
                   row_number() OVER (PARTITION BY r.store, r.date ORDER BY h.date DESC) AS k
            FROM r JOIN (SELECT *, LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0) AS discount_pct FROM daily) h
              ON h.store = r.store AND h.date < r.date)"""


def _tail_cols(w):
    e = f"CASE WHEN p.k <= {w} THEN p.revenue END"
    return f"{XAVG(e)} AS revenue_rolling_mean_{w}d, stddev_samp({e}) AS revenue_rolling_std_{w}d"


@register("hist_tail_stats", sql(f"""{R_SQL}{PAIRS_SQL}
SELECT r.store, r.date, r.discount_pct, {_tail_cols(7)}, {_tail_cols(14)}, {_tail_cols(30)}
FROM r LEFT JOIN pairs p ON p.store = r.store AND p.date = r.date
GROUP BY r.store, r.date, r.discount_pct"""),
          dbl="discount_pct " + " ".join(f"revenue_rolling_mean_{w}d revenue_rolling_std_{w}d" for w in (7, 14, 30)))
def q_hist_tail_stats(spark, sf_dir):
    return L.hist_tail_stats(_req(spark, sf_dir), _hist(spark, sf_dir))


@register("hist_tail_mean14", sql(f"""{R_SQL}{PAIRS_SQL}
SELECT r.store, r.date, r.discount_pct,
       avg(CASE WHEN p.k <= 14 THEN p.h_discount_pct END) AS discount_rolling_mean_14d,
       {XAVG('CASE WHEN p.k <= 14 THEN p.revenue END')} AS revenue_rolling_mean_14d
FROM r LEFT JOIN pairs p ON p.store = r.store AND p.date = r.date
GROUP BY r.store, r.date, r.discount_pct"""), dbl="discount_pct discount_rolling_mean_14d revenue_rolling_mean_14d")
def q_hist_tail_mean14(spark, sf_dir):
    return L.hist_tail_mean14(_req(spark, sf_dir), _hist(spark, sf_dir))


@register("same_day_last_year", sql(f"""{R_SQL}
, sm AS (SELECT store, {XAVG('revenue')} AS smean FROM daily GROUP BY store)
, g AS (SELECT avg(smean) AS gmean FROM sm)
SELECT r.store, r.date, r.discount_pct, COALESCE(h.revenue, sm.smean, g.gmean) AS same_day_revenue_last_year
FROM r LEFT JOIN daily h ON h.store = r.store AND h.date = CAST(r.date - INTERVAL 12 MONTH AS DATE)
LEFT JOIN sm ON sm.store = r.store CROSS JOIN g"""), dbl="discount_pct same_day_revenue_last_year")
def q_same_day_last_year(spark, sf_dir):
    return L.same_day_last_year(_req(spark, sf_dir), _hist(spark, sf_dir))


@register("same_doy_3y", sql(f"""{R_SQL}
, d3 AS (SELECT r.store, r.date, {XAVG('h.revenue')} AS same_dayofyear_avg_3y
         FROM r JOIN daily h ON h.store = r.store AND dayofyear(h.date) = dayofyear(r.date)
                            AND year(h.date) < year(r.date) AND year(h.date) >= year(r.date) - 3
         GROUP BY r.store, r.date)
, smh AS (SELECT store, month, {XAVG('revenue')} AS same_dayofyear_month_avg FROM daily GROUP BY store, month)
SELECT r.store, r.date, r.discount_pct, d3.same_dayofyear_avg_3y, smh.same_dayofyear_month_avg,
       d3.same_dayofyear_avg_3y - smh.same_dayofyear_month_avg AS same_dayofyear_delta_vs_month
FROM r LEFT JOIN d3 ON d3.store = r.store AND d3.date = r.date
LEFT JOIN smh ON smh.store = r.store AND smh.month = month(r.date)"""),
          dbl="discount_pct same_dayofyear_avg_3y same_dayofyear_month_avg same_dayofyear_delta_vs_month")
def q_same_doy_3y(spark, sf_dir):
    return L.same_doy_3y(_req(spark, sf_dir), _hist(spark, sf_dir))


@register("seasonal_join", sql(f"""{R_SQL}
, idx AS (SELECT store, month, day_of_week AS weekday, {XAVG('revenue')} AS store_month_weekday_avg
          FROM daily GROUP BY store, month, day_of_week)
SELECT r.store, r.date, r.discount_pct, month(r.date) AS month, isodow(r.date) - 1 AS weekday, idx.store_month_weekday_avg
FROM r LEFT JOIN idx ON idx.store = r.store AND idx.month = month(r.date) AND idx.weekday = isodow(r.date) - 1"""),
          dbl="discount_pct store_month_weekday_avg")
def q_seasonal_join(spark, sf_dir):
    return L.seasonal_join(_req(spark, sf_dir), _hist(spark, sf_dir))


@register("is_festival", sql("""
, fd AS (SELECT DISTINCT date FROM festivals)
SELECT d.store, d.date, CAST(fd.date IS NOT NULL AS INTEGER) AS is_festival,
       CAST(fd.date IS NOT NULL AND d.day_of_week < 5 AS INTEGER) AS is_weekday_festival
FROM daily d LEFT JOIN fd ON fd.date = d.date"""))
def q_is_festival(spark, sf_dir):
    return L.is_festival(base.daily(spark, sf_dir), festivals(spark)).select("store", "date", "is_festival",
                                                                            "is_weekday_festival")


@register("days_to_festival", sql("""
, nxt AS (SELECT dd.date, min(date_diff('day', dd.date, f.date)) AS dtf
          FROM (SELECT DISTINCT date FROM daily) dd JOIN festivals f ON f.date >= dd.date GROUP BY dd.date)
SELECT d.store, d.date, COALESCE(nxt.dtf, 365) AS days_to_festival FROM daily d LEFT JOIN nxt ON nxt.date = d.date"""))
def q_days_to_festival(spark, sf_dir):
    return L.days_to_festival(base.daily(spark, sf_dir), festivals(spark)).select("store", "date", "days_to_festival")


AVG_FB_SQL = f"""
, h AS (SELECT store, month, day_of_week, revenue FROM daily)
, sm AS (SELECT store, month, {XAVG('revenue')} AS v FROM h GROUP BY store, month)
, sd AS (SELECT store, day_of_week, {XAVG('revenue')} AS v FROM h GROUP BY store, day_of_week)
, s AS (SELECT store, {XAVG('revenue')} AS v FROM h GROUP BY store)
, m AS (SELECT month, {XAVG('revenue')} AS v FROM h GROUP BY month)
, dw AS (SELECT day_of_week, {XAVG('revenue')} AS v FROM h GROUP BY day_of_week)
, g AS (SELECT {XAVG('revenue')} AS v FROM h)
, fb AS (
  SELECT r.store, r.date, r.discount_pct,
         COALESCE(sm.v, s.v, m.v, g.v) AS store_month_avg,
         CASE WHEN sm.v IS NOT NULL THEN 1 WHEN s.v IS NOT NULL THEN 2 WHEN m.v IS NOT NULL THEN 3 ELSE 4 END AS store_month_avg_level,
         COALESCE(sd.v, s.v, dw.v, CASE WHEN COALESCE(sm.v, s.v, m.v, g.v) > 0 THEN COALESCE(sm.v, s.v, m.v, g.v) ELSE g.v END)
           AS store_dayofweek_avg,
         CASE WHEN sd.v IS NOT NULL THEN 1 WHEN s.v IS NOT NULL THEN 2 WHEN dw.v IS NOT NULL THEN 3 ELSE 4 END
           AS store_dayofweek_avg_level,
         g.v AS global_mean
  FROM r LEFT JOIN sm ON sm.store = r.store AND sm.month = month(r.date)
         LEFT JOIN sd ON sd.store = r.store AND sd.day_of_week = isodow(r.date) - 1
         LEFT JOIN s ON s.store = r.store LEFT JOIN m ON m.month = month(r.date)
         LEFT JOIN dw ON dw.day_of_week = isodow(r.date) - 1 CROSS JOIN g)"""


@register("avg_fallback", sql(f"""{R_SQL}{AVG_FB_SQL}
SELECT store, date, discount_pct, store_month_avg, store_month_avg_level, store_dayofweek_avg, store_dayofweek_avg_level
FROM fb"""), dbl="discount_pct store_month_avg store_dayofweek_avg")
def q_avg_fallback(spark, sf_dir):
    out = L.avg_fallback(_req(spark, sf_dir), _hist(spark, sf_dir))
    return out.select("store", "date", "discount_pct", "store_month_avg", "store_month_avg_level",
                      "store_dayofweek_avg", "store_dayofweek_avg_level")


def _lagfb(c):
    return (f"CASE WHEN {c} IS NULL OR {c} = 0 THEN (CASE WHEN fb.store_dayofweek_avg > 0 THEN fb.store_dayofweek_avg "
            f"WHEN fb.store_month_avg > 0 THEN fb.store_month_avg ELSE fb.global_mean END) ELSE {c} END")


@register("lag_fallback", sql(f"""{R_SQL}{AVG_FB_SQL}
, lg AS (SELECT r.store, r.date, {LAG_SQL_COLS} FROM r {LAG_SQL_JOIN})
SELECT lg.store, lg.date, {", ".join(f"{_lagfb(f'lg.revenue_lag_{n}')} AS revenue_lag_{n}" for n in LAGS)}
FROM lg JOIN fb ON fb.store = lg.store AND fb.date = lg.date"""),
          dbl=" ".join(f"revenue_lag_{n}" for n in LAGS))
def q_lag_fallback(spark, sf_dir):
    h = _hist(spark, sf_dir)
    r = L.lag_exact_date(_req(spark, sf_dir), h, days=LAGS)
    fb = L.avg_fallback(r, h)
    g = h.agg(F.sum(F.col("revenue").cast("decimal(38,6)")).cast("double").alias("_s"), F.count("revenue").alias("_n"))
    fb = fb.crossJoin(F.broadcast(g.select((F.col("_s") / F.col("_n")).alias("_global_mean"))))
    cols = [f"revenue_lag_{n}" for n in LAGS]
    return L.lag_fallback(fb, cols).select("store", "date", *cols)


@register("no_history", sql(f"""{R_SQL}
, lg AS (SELECT r.store, r.date, {LAG_SQL_COLS} FROM r {LAG_SQL_JOIN})
, f AS (SELECT store, min(date) AS first_date, quantile_cont(revenue, 0.5) AS smed FROM daily GROUP BY store)
SELECT lg.store, lg.date, CAST(NOT (f.first_date IS NULL OR f.first_date >= lg.date) AS INTEGER) AS has_history,
       {", ".join(f"CASE WHEN f.first_date IS NULL OR f.first_date >= lg.date THEN COALESCE(f.smed, 0.0) ELSE lg.revenue_lag_{n} END AS revenue_lag_{n}" for n in LAGS)}
FROM lg LEFT JOIN f ON f.store = lg.store"""), dbl=" ".join(f"revenue_lag_{n}" for n in LAGS))
def q_no_history(spark, sf_dir):
    h = _hist(spark, sf_dir)
    r = L.lag_exact_date(_req(spark, sf_dir), h, days=LAGS)
    cols = [f"revenue_lag_{n}" for n in LAGS]
    return L.no_history(r, h, cols).select("store", "date", "has_history", *cols)


YOY_CTES = f"""
, y AS (SELECT store, month, day_of_week AS dow, year, {XAVG('revenue')} AS ym FROM daily GROUP BY store, month, day_of_week, year)
, yg AS (SELECT *, ym / NULLIF(lag(ym) OVER (PARTITION BY store, month, dow ORDER BY year), 0) - 1.0 AS g FROM y)
, k AS (SELECT store, month, dow, arg_max(ym, year) AS latest, avg(g) AS growth, count(ym) AS ny FROM yg GROUP BY store, month, dow)
, gm AS (SELECT {XAVG('revenue')} AS gm FROM daily)"""


@register("yoy_fallback", sql(f"""{R_SQL}{YOY_CTES}
SELECT r.store, r.date, r.discount_pct,
       CASE WHEN k.latest IS NULL THEN gm.gm WHEN k.ny > 1 AND k.growth IS NOT NULL THEN k.latest * (1.0 + k.growth)
            ELSE k.latest END * ((100.0 + COALESCE(r.discount_pct, 0.0) * 100.0) / 100.0) AS yoy_fallback
FROM r LEFT JOIN k ON k.store = r.store AND k.month = month(r.date) AND k.dow = isodow(r.date) - 1 CROSS JOIN gm"""),
          dbl="discount_pct yoy_fallback")
def q_yoy_fallback(spark, sf_dir):
    return L.yoy_fallback(_req(spark, sf_dir), _hist(spark, sf_dir)).select("store", "date", "discount_pct", "yoy_fallback")
