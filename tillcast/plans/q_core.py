"""Flagship query and the rollup / source queries."""

from __future__ import annotations


from tillcast.operators import windows as W
from tillcast.operators.calendar import calendar_parts
from tillcast.operators.joins import join_store
from tillcast.operators.rollup import daily_rollup, disc_perc
from tillcast.plans import base
from tillcast.plans.registry import register
from tillcast.plans.sqlbase import XAVG, sql
from tillcast.sources import driver


def flagship(spark, sf_dir):
    """daily_rollup → join_store → calendar_parts → lags → rolling_lagged → store_baselines."""
    d = (
        driver.sales(spark, sf_dir)
        .transform(lambda x: join_store(x, driver.stores(spark, sf_dir)))
        .transform(calendar_parts)
        .transform(W.lags)
        .transform(W.rolling_lagged)
        .transform(W.store_baselines)
    )
    keep = ["store", "date", "qty_sold", "revenue", "disc_value", "channel", "city", "region", "store_area",
            "year", "month", "day", "day_of_week", "quarter", "is_weekend"]
    feats = [f"revenue_lag_{n}" for n in W.LAGS]
    for w in W.ROLLING:
        feats += [f"revenue_rolling_mean_{w}d", f"revenue_rolling_std_{w}d"]
    feats += ["store_month_avg", "store_day_avg", "store_dayofweek_avg"]
    return d.select(*keep, *feats)


FLAGSHIP_DBL = ("revenue_rolling_mean_7d revenue_rolling_std_7d revenue_rolling_mean_14d revenue_rolling_std_14d "
                "revenue_rolling_mean_30d revenue_rolling_std_30d store_month_avg store_day_avg store_dayofweek_avg")

FLAGSHIP_SQL = sql(f"""
SELECT store, date, qty_sold, revenue, disc_value, channel, city, region, store_area,
       year, month, day, day_of_week, quarter, is_weekend,
       lag(revenue, 1) OVER w AS revenue_lag_1,
       lag(revenue, 3) OVER w AS revenue_lag_3,
       lag(revenue, 7) OVER w AS revenue_lag_7,
       lag(revenue, 14) OVER w AS revenue_lag_14,
       lag(revenue, 30) OVER w AS revenue_lag_30,
       {XAVG('revenue', '(w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS revenue_rolling_mean_7d,
       stddev_samp(revenue) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS revenue_rolling_std_7d,
       {XAVG('revenue', '(w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)')} AS revenue_rolling_mean_14d,
       stddev_samp(revenue) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS revenue_rolling_std_14d,
       {XAVG('revenue', '(w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)')} AS revenue_rolling_mean_30d,
       stddev_samp(revenue) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS revenue_rolling_std_30d,
       {XAVG('revenue', '(PARTITION BY store, month)')} AS store_month_avg,
       {XAVG('revenue', '(PARTITION BY store, day)')} AS store_day_avg,
       {XAVG('revenue', '(PARTITION BY store, day_of_week)')} AS store_dayofweek_avg
FROM daily
WINDOW w AS (PARTITION BY store ORDER BY date)
""")

register("flagship_features", FLAGSHIP_SQL, FLAGSHIP_DBL)(flagship)


@register("daily_rollup", sql("SELECT store, date, qty_sold, revenue, disc_value FROM sales"))
def q_daily_rollup(spark, sf_dir):
    """Σ quantity / revenue / discount per (store, date) from line items."""
    return driver.sales(spark, sf_dir)


@register("src_stores", sql("SELECT id, channel, city, region, is_online, store_area, store_cluster FROM stores"),
          dbl="store_area")
def q_src_stores(spark, sf_dir):
    return driver.stores(spark, sf_dir)


@register("join_store", sql("""
SELECT s.store, s.date, s.revenue, st.channel, st.city, st.region, st.is_online, st.store_area
FROM sales s LEFT JOIN stores st ON s.store = st.id
"""), dbl="store_area")
def q_join_store(spark, sf_dir):
    d = join_store(driver.sales(spark, sf_dir), driver.stores(spark, sf_dir))
    return d.select("store", "date", "revenue", "channel", "city", "region", "is_online", "store_area")


@register("disc_perc", sql("""
SELECT store, date, disc_perc,
       LEAST(GREATEST(COALESCE(CASE WHEN revenue + disc_value <> 0 THEN disc_value * 100.0 / (revenue + disc_value)
                                    WHEN disc_value > 0 THEN 100.0 ELSE 0.0 END, 0.0), 0.0), 100.0) AS disc_perc_unguarded,
       LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0) AS discount_pct,
       CAST(LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0) > 0 AS INTEGER) AS is_discounted,
       pow(LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0), 2) AS discount_pct_squared
FROM daily
"""), dbl="disc_perc disc_perc_unguarded discount_pct discount_pct_squared")
def q_disc_perc(spark, sf_dir):
    from tillcast.operators.rollup import discount_pct
    d = base.daily(spark, sf_dir)
    d = disc_perc(d, guarded=False, out="disc_perc_unguarded").transform(discount_pct)
    return d.select("store", "date", "disc_perc", "disc_perc_unguarded", "discount_pct", "is_discounted",
                    "discount_pct_squared")


@register("calendar_parts", sql("""
SELECT store, date, year, month, day, day_of_week, quarter, is_weekend, day_of_year, week_of_year FROM daily
"""))
def q_calendar_parts(spark, sf_dir):
    return base.daily(spark, sf_dir).select("store", "date", "year", "month", "day", "day_of_week", "quarter",
                                            "is_weekend", "day_of_year", "week_of_year")
