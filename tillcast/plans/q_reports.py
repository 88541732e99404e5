"""§2.4 reports and §2.3 geo lookups as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.operators import reports as R
from tillcast.operators import windows as W
from tillcast.operators.geo import city_state_sql, geo_classify, state_region_sql
from tillcast.operators.rollup import discount_pct
from tillcast.plans import base
from tillcast.plans.registry import register
from tillcast.plans.sqlbase import XAVG, XSUM, sql

# Parameters chosen for the driver tables (their discounts are at most 10 %).
HIGH_DISCOUNT_THRESHOLD = 7.5
REPORT_MONTH = 3
REPORT_DAY = 15
DESCRIBE_COLS = ["revenue", "qty_sold", "disc_value", "disc_perc"]
TEN_WIDE = (0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100)
CUSTOM_EDGES = (0, 10, 20, 30, 40, 50, 100)


def _d(spark, sf_dir):
    return base.daily(spark, sf_dir)


def _long_sql(cols, name="feature", value="value", src="daily"):
    return " UNION ALL ".join(f"SELECT '{c}' AS {name}, CAST({c} AS DOUBLE) AS {value} FROM {src}" for c in cols)


@register("describe", sql(f"""
, long AS ({_long_sql(DESCRIBE_COLS)})
SELECT feature, count(value) AS count, {XAVG('value')} AS mean, stddev_samp(value) AS std,
       min(value) AS min, max(value) AS max,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75
FROM long GROUP BY feature"""), dbl="mean std min max p25 p50 p75")
def q_describe(spark, sf_dir):
    return R.describe(_d(spark, sf_dir), DESCRIBE_COLS).withColumnRenamed("column", "feature")


@register("discount_stats", sql(f"""
SELECT count(*) AS n_rows, count_if(disc_perc > 0) AS n_discounted, min(disc_perc) AS min_disc_perc,
       avg(disc_perc) AS mean_disc_perc, max(disc_perc) AS max_disc_perc,
       {XAVG('revenue')} AS mean_revenue, {XAVG('disc_value')} AS mean_disc_value,
       quantile_cont(disc_perc, 0.5) AS median_disc_perc, quantile_cont(disc_value, 0.5) AS median_disc_value
FROM daily"""), dbl="min_disc_perc mean_disc_perc max_disc_perc mean_revenue mean_disc_value median_disc_perc median_disc_value")
def q_discount_stats(spark, sf_dir):
    return R.discount_stats(_d(spark, sf_dir))


def _ranges_sql(edges):
    rows = ", ".join(f"({i}, {float(lo)}, {float(hi)}, '{lo}-{hi}%')" for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])))
    return sql(f"""
, rng AS (SELECT * FROM (VALUES {rows}) AS r(range_idx, lo, hi, range))
, tot AS (SELECT count(*) AS n FROM daily)
SELECT r.range, r.lo, r.hi, count(d.disc_perc) AS count,
       CAST(count(d.disc_perc) AS DOUBLE) / (SELECT n FROM tot) * 100.0 AS percentage
FROM rng r LEFT JOIN daily d ON d.disc_perc > r.lo AND d.disc_perc <= r.hi
GROUP BY r.range, r.lo, r.hi""")


@register("discount_ranges", _ranges_sql(TEN_WIDE), dbl="percentage")
def q_discount_ranges(spark, sf_dir):
    return R.discount_ranges(_d(spark, sf_dir), TEN_WIDE)


@register("discount_ranges_custom", _ranges_sql(CUSTOM_EDGES), dbl="percentage")
def q_discount_ranges_custom(spark, sf_dir):
    return R.discount_ranges(_d(spark, sf_dir), CUSTOM_EDGES)


H = f", h AS (SELECT * FROM daily WHERE disc_perc > {HIGH_DISCOUNT_THRESHOLD})"


@register("high_discount_metrics", sql(f"""{H}
SELECT count(*) AS n_high, {XAVG('revenue')} AS mean_revenue, {XAVG('disc_value')} AS mean_disc_value,
       avg(disc_perc) AS mean_disc_perc,
       quantile_cont(revenue, 0.5) AS median_revenue, quantile_cont(disc_value, 0.5) AS median_disc_value,
       quantile_cont(disc_perc, 0.5) AS median_disc_perc
FROM h"""), dbl="mean_revenue mean_disc_value mean_disc_perc median_revenue median_disc_value median_disc_perc")
def q_high_discount_metrics(spark, sf_dir):
    return R.high_discount_metrics(_d(spark, sf_dir), HIGH_DISCOUNT_THRESHOLD).drop("n_discount_gt_revenue", "n_zero_revenue")


@register("high_discount_anomalies", sql(f"""{H}
SELECT count_if(disc_value > revenue) AS n_discount_gt_revenue, count_if(revenue = 0) AS n_zero_revenue FROM h"""))
def q_high_discount_anomalies(spark, sf_dir):
    return R.high_discount_metrics(_d(spark, sf_dir), HIGH_DISCOUNT_THRESHOLD).select(
        "n_discount_gt_revenue", "n_zero_revenue")


@register("high_discount_month", sql(f"""{H}
SELECT month, count(*) AS count, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM h) * 100.0 AS percentage
FROM h GROUP BY month"""), dbl="percentage")
def q_high_discount_month(spark, sf_dir):
    return R.high_discount_month(_d(spark, sf_dir), HIGH_DISCOUNT_THRESHOLD)


@register("high_discount_weekend", sql(f"""{H}
SELECT CASE WHEN day_of_week >= 5 THEN 'Weekend' ELSE 'Weekday' END AS type, count(*) AS count,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM h) * 100.0 AS percentage
FROM h GROUP BY 1"""), dbl="percentage")
def q_high_discount_weekend(spark, sf_dir):
    return R.high_discount_weekend(_d(spark, sf_dir), HIGH_DISCOUNT_THRESHOLD)


@register("data_quality", sql("""
SELECT count(*) AS n_rows, count_if(revenue = 0) AS n_zero_revenue, count_if(revenue < 0) AS n_negative_revenue,
       count_if(disc_value < 0) AS n_negative_discount, count_if(revenue IS NULL OR isnan(revenue)) AS n_missing_revenue
FROM daily"""))
def q_data_quality(spark, sf_dir):
    return R.data_quality(_d(spark, sf_dir))


@register("dataset_summary", sql("""
SELECT count(DISTINCT store) AS n_stores, min(date) AS min_date, max(date) AS max_date, count(*) AS n_store_days
FROM daily"""))
def q_dataset_summary(spark, sf_dir):
    return R.dataset_summary(_d(spark, sf_dir))


PROFILE_NUM = ["revenue", "qty_sold", "disc_value", "disc_perc", "store_area"]
PROFILE_CAT = ["city", "region", "channel", "store_cluster"]


@register("column_profile_numeric", sql(f"""
, long AS ({_long_sql(PROFILE_NUM, value='v')})
SELECT feature, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max,
       count_if(v = 0) AS n_zero, count_if(v <> 0) AS n_nonzero
FROM long GROUP BY feature"""), dbl="mean std min max")
def q_column_profile_numeric(spark, sf_dir):
    return R.column_profile(_d(spark, sf_dir), PROFILE_NUM, PROFILE_CAT)[0]


@register("column_profile_categorical", sql(f"""
, long AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v FROM daily" for c in PROFILE_CAT)})
, freq AS (SELECT feature, v, count(*) AS cnt FROM long GROUP BY feature, v)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, v) AS rn FROM freq WHERE v IS NOT NULL)
SELECT feature, count(v) AS n_unique, max(CASE WHEN rn = 1 THEN v END) AS mode FROM ranked GROUP BY feature"""))
def q_column_profile_categorical(spark, sf_dir):
    return R.column_profile(_d(spark, sf_dir), PROFILE_NUM, PROFILE_CAT)[1]


@register("category_lists", sql("""
, long AS (SELECT DISTINCT 'channel' AS column_name, channel AS value FROM daily
           UNION SELECT DISTINCT 'region', region FROM daily UNION SELECT DISTINCT 'city', city FROM daily)
SELECT column_name, value, dense_rank() OVER (PARTITION BY column_name ORDER BY value) - 1 AS position
FROM long WHERE value IS NOT NULL"""))
def q_category_lists(spark, sf_dir):
    return R.category_lists(_d(spark, sf_dir)).withColumnRenamed("column", "column_name")


def _enc_sql(k):
    return f"SELECT {k}, {XAVG('revenue')} AS {k}_encoded FROM daily GROUP BY {k}"


@register("target_encode", sql(f"""
, ce AS ({_enc_sql('city')}), re AS ({_enc_sql('region')}), ch AS ({_enc_sql('channel')})
SELECT d.store, d.date, COALESCE(ce.city_encoded, 0.0) AS city_encoded, COALESCE(re.region_encoded, 0.0) AS region_encoded,
       COALESCE(ch.channel_encoded, 0.0) AS channel_encoded
FROM daily d LEFT JOIN ce ON d.city = ce.city LEFT JOIN re ON d.region = re.region LEFT JOIN ch ON d.channel = ch.channel
"""), dbl="city_encoded region_encoded channel_encoded")
def q_target_encode(spark, sf_dir):
    return R.target_encode(_d(spark, sf_dir)).select("store", "date", "city_encoded", "region_encoded", "channel_encoded")


@register("discount_target_encode", sql(f"""
, p AS (SELECT store, date, revenue, LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0) AS discount_pct
        FROM daily WHERE store_cluster = 'PREMIUM_OFFLINE')
SELECT store, date, discount_pct, {XAVG('revenue', '(PARTITION BY discount_pct)')} AS discount_target_encoded FROM p
"""), dbl="discount_pct discount_target_encoded")
def q_discount_target_encode(spark, sf_dir):
    from tillcast.operators.encoding import discount_target_encode
    d = _d(spark, sf_dir).transform(discount_pct)
    return discount_target_encode(d).where(F.col("store_cluster") == "PREMIUM_OFFLINE").select(
        "store", "date", "discount_pct", "discount_target_encoded")


def tier_sql(k, src="daily"):
    return f"""
  SELECT '{k}' AS level, value, mean, std, count, score,
         COALESCE(len(list_filter(inner_e, lambda v: v < score)), 0) AS tier_code
  FROM (SELECT *, (list_sort(list_distinct(e)))[2:len(list_distinct(e)) - 1] AS inner_e
        FROM (SELECT {k} AS value, {XAVG('revenue')} AS mean, stddev_samp(revenue) AS std, count(revenue) AS count,
                     {XAVG('revenue')} * 0.6 + stddev_samp(revenue) * 0.2 + count(revenue) * 0.2 AS score
              FROM {src} GROUP BY {k}) g
        CROSS JOIN (SELECT quantile_cont(score, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e
                    FROM (SELECT {XAVG('revenue')} * 0.6 + stddev_samp(revenue) * 0.2 + count(revenue) * 0.2 AS score
                          FROM {src} GROUP BY {k}) s) q) t"""


TIER_CTES = f"""
, t AS ({tier_sql('city')} UNION ALL {tier_sql('region')})
, tier_rows AS (
  SELECT level, value, mean, std, count, score, CASE WHEN score IS NULL THEN 0 ELSE tier_code END AS tier_code,
         (['D', 'C', 'B', 'A'])[CASE WHEN score IS NULL THEN 0 ELSE tier_code END + 1] AS tier
  FROM t)"""


@register("tiers", sql(f"{TIER_CTES} SELECT * FROM tier_rows"), dbl="mean std score")
def q_tiers(spark, sf_dir):
    from tillcast.operators.encoding import tiers_filled
    d = _d(spark, sf_dir)
    return tiers_filled(d, "city").withColumn("level", F.lit("city")).unionByName(
        tiers_filled(d, "region").withColumn("level", F.lit("region")))


@register("store_baselines", sql(f"""
SELECT store, date, {XAVG('revenue', '(PARTITION BY store, month)')} AS store_month_avg,
       {XAVG('revenue', '(PARTITION BY store, day)')} AS store_day_avg,
       {XAVG('revenue', '(PARTITION BY store, day_of_week)')} AS store_dayofweek_avg
FROM daily"""), dbl="store_month_avg store_day_avg store_dayofweek_avg")
def q_store_baselines(spark, sf_dir):
    return base.daily_by_store(spark, sf_dir).transform(W.store_baselines).select(
        "store", "date", "store_month_avg", "store_day_avg", "store_dayofweek_avg")


@register("weekday_stats", sql(f"""
SELECT day_of_week, {XAVG('revenue')} AS weekday_avg, stddev_samp(revenue) AS weekday_std FROM daily GROUP BY day_of_week"""),
          dbl="weekday_avg weekday_std")
def q_weekday_stats(spark, sf_dir):
    return R.weekday_stats(_d(spark, sf_dir))


SMS_SQL = f"""
, sms AS (
  SELECT store, month,
         COALESCE({XAVG('revenue')}, 0.0) AS store_month_revenue_mean,
         COALESCE(stddev_samp(revenue), 0.0) AS store_month_revenue_std,
         COALESCE(min(revenue), 0.0) AS store_month_revenue_min,
         COALESCE(max(revenue), 0.0) AS store_month_revenue_max,
         COALESCE({XAVG('qty_sold')}, 0.0) AS store_month_quantity_mean,
         COALESCE(stddev_samp(qty_sold), 0.0) AS store_month_quantity_std,
         COALESCE({XAVG('disc_value')}, 0.0) AS store_month_discount_mean,
         COALESCE(stddev_samp(disc_value), 0.0) AS store_month_discount_std
  FROM daily GROUP BY store, month)"""
SMS_COLS = ("store_month_revenue_mean store_month_revenue_std store_month_revenue_min store_month_revenue_max "
            "store_month_quantity_mean store_month_quantity_std store_month_discount_mean store_month_discount_std")


@register("store_month_stats", sql(f"{SMS_SQL} SELECT * FROM sms"), dbl=SMS_COLS)
def q_store_month_stats(spark, sf_dir):
    return R.store_month_stats(_d(spark, sf_dir))


SSP_COLS = ("store_month_revenue_mean_avg store_month_revenue_mean_std store_month_revenue_mean_max "
            "store_month_revenue_std_avg store_month_revenue_std_std store_month_quantity_mean_avg "
            "store_month_quantity_mean_std store_month_discount_mean_avg store_month_discount_mean_std")


@register("store_season_profile", sql(f"""{SMS_SQL}
SELECT store,
       COALESCE(avg(store_month_revenue_mean), 0.0) AS store_month_revenue_mean_avg,
       COALESCE(stddev_samp(store_month_revenue_mean), 0.0) AS store_month_revenue_mean_std,
       COALESCE(max(store_month_revenue_mean), 0.0) AS store_month_revenue_mean_max,
       COALESCE(avg(store_month_revenue_std), 0.0) AS store_month_revenue_std_avg,
       COALESCE(stddev_samp(store_month_revenue_std), 0.0) AS store_month_revenue_std_std,
       COALESCE(avg(store_month_quantity_mean), 0.0) AS store_month_quantity_mean_avg,
       COALESCE(stddev_samp(store_month_quantity_mean), 0.0) AS store_month_quantity_mean_std,
       COALESCE(avg(store_month_discount_mean), 0.0) AS store_month_discount_mean_avg,
       COALESCE(stddev_samp(store_month_discount_mean), 0.0) AS store_month_discount_mean_std
FROM sms GROUP BY store"""), dbl=SSP_COLS)
def q_store_season_profile(spark, sf_dir):
    return R.store_season_profile(R.store_month_stats(_d(spark, sf_dir)))


HOL = "CASE WHEN month IN (12, 1, 2) THEN revenue END"
SUM_ = "CASE WHEN month IN (4, 5, 6) THEN revenue END"
REG = "CASE WHEN month NOT IN (12, 1, 2, 4, 5, 6) THEN revenue END"


@register("season_ratios", sql(f"""
SELECT store, COALESCE({XAVG(HOL)} / NULLIF({XAVG(REG)}, 0), 1.0) AS holiday_revenue_ratio,
       COALESCE({XAVG(SUM_)} / NULLIF({XAVG(REG)}, 0), 1.0) AS summer_revenue_ratio
FROM daily GROUP BY store"""), dbl="holiday_revenue_ratio summer_revenue_ratio")
def q_season_ratios(spark, sf_dir):
    return R.season_ratios(_d(spark, sf_dir))


def _geo_sql(k):
    cols = ["revenue_avg", "revenue_std", "quantity_avg", "discount_avg"]
    z = ", ".join(f"(g.{c} - m.m_{c}) / NULLIF(m.s_{c}, 0) AS {k}_{c}" for c in cols)
    mom = ", ".join([f"avg({c}) AS m_{c}" for c in cols] + [f"stddev_samp({c}) AS s_{c}" for c in cols])
    return sql(f"""
, g AS (SELECT {k}, COALESCE({XAVG('revenue')}, 0.0) AS revenue_avg, COALESCE(stddev_samp(revenue), 0.0) AS revenue_std,
               COALESCE({XAVG('qty_sold')}, 0.0) AS quantity_avg, COALESCE({XAVG('disc_value')}, 0.0) AS discount_avg
        FROM daily GROUP BY {k})
, m AS (SELECT {mom} FROM g)
SELECT g.{k}, {z} FROM g CROSS JOIN m""")


GEO_DBL = lambda k: " ".join(f"{k}_{c}" for c in ["revenue_avg", "revenue_std", "quantity_avg", "discount_avg"])


@register("geo_profile_city", _geo_sql("city"), dbl=GEO_DBL("city"))
def q_geo_profile_city(spark, sf_dir):
    return R.geo_profile(_d(spark, sf_dir), "city")


@register("geo_profile_region", _geo_sql("region"), dbl=GEO_DBL("region"))
def q_geo_profile_region(spark, sf_dir):
    return R.geo_profile(_d(spark, sf_dir), "region")


GEO_SQL = f"""
, c2s AS ({city_state_sql()}), s2r AS ({state_region_sql()})
, sg AS (SELECT st.*, c2s.state, s2r.region_classified FROM stores st
         LEFT JOIN c2s ON st.city = c2s._city LEFT JOIN s2r ON c2s.state = s2r.state)"""


@register("geo_classify", sql(f"""{GEO_SQL}
SELECT id, city, state, region_classified FROM sg"""))
def q_geo_classify(spark, sf_dir):
    return geo_classify(base.stores(spark, sf_dir)).select("id", "city", "state", "region_classified")


@register("store_density", sql(f"""{GEO_SQL}
SELECT id, city, state,
       CASE WHEN city IS NOT NULL THEN count(*) OVER (PARTITION BY city) END AS city_store_density,
       CASE WHEN state IS NOT NULL THEN count(*) OVER (PARTITION BY state) END AS state_store_density
FROM sg"""))
def q_store_density(spark, sf_dir):
    return R.store_density(geo_classify(base.stores(spark, sf_dir)))


def _by_year_sql(where):
    return sql(f"""
SELECT store, year(date) AS year,
       round({XSUM('revenue')} * 100.0) / 100.0 AS revenue_sum, round({XAVG('revenue')} * 100.0) / 100.0 AS revenue_mean,
       round({XSUM('qty_sold')} * 100.0) / 100.0 AS qty_sum, round({XAVG('qty_sold')} * 100.0) / 100.0 AS qty_mean,
       round(avg(disc_perc) * 100.0) / 100.0 AS disc_perc_mean, count(disc_perc) AS disc_perc_count
FROM daily {where} GROUP BY store, year(date)""")


@register("monthly_by_year", _by_year_sql(f"WHERE month = {REPORT_MONTH}"))
def q_monthly_by_year(spark, sf_dir):
    return R.monthly_by_year(_d(spark, sf_dir), REPORT_MONTH)


@register("yearly", _by_year_sql(""))
def q_yearly(spark, sf_dir):
    return R.by_year(_d(spark, sf_dir))


@register("same_day_by_year", sql(f"""
SELECT store, year(date) AS year,
       round(arg_min(revenue, date) * 100.0) / 100.0 AS revenue, round(arg_min(qty_sold, date) * 100.0) / 100.0 AS qty_sold,
       round(arg_min(disc_perc, date) * 100.0) / 100.0 AS disc_perc, count(disc_perc) AS disc_perc_count
FROM daily WHERE month = {REPORT_MONTH} AND day = {REPORT_DAY} GROUP BY store, year(date)"""))
def q_same_day_by_year(spark, sf_dir):
    return R.same_day_by_year(_d(spark, sf_dir), REPORT_MONTH, REPORT_DAY)


@register("season_index", sql(f"""
SELECT store, month, day_of_week AS weekday, {XAVG('revenue')} AS store_month_weekday_avg
FROM daily GROUP BY store, month, day_of_week"""), dbl="store_month_weekday_avg")
def q_season_index(spark, sf_dir):
    return R.season_index_table(_d(spark, sf_dir))


@register("store_median_impute", sql("""
SELECT store, date, COALESCE(CASE WHEN isnan(revenue) THEN NULL ELSE revenue END,
                             quantile_cont(revenue, 0.5) OVER (PARTITION BY store)) AS revenue
FROM daily"""), dbl="revenue")
def q_store_median_impute(spark, sf_dir):
    return R.store_median_impute(_d(spark, sf_dir)).select("store", "date", "revenue")


@register("feature_bounds", sql(f"""
, long AS ({_long_sql(DESCRIBE_COLS, value='v')})
SELECT feature, quantile_cont(v, 0.01) AS p_low, quantile_cont(v, 0.99) AS p_high FROM long GROUP BY feature"""),
          dbl="p_low p_high")
def q_feature_bounds(spark, sf_dir):
    return R.feature_bounds(_d(spark, sf_dir), DESCRIBE_COLS)


CORR_COLS = ["revenue", "qty_sold", "disc_value", "disc_perc", "store_area", "revenue_lag_1", "revenue_rolling_mean_7d", "month", "quarter", "day_of_year"]


@register("corr_pairs", sql(f"""
, f AS (SELECT *, lag(revenue, 1) OVER w AS revenue_lag_1,
               {XAVG('revenue', '(w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS revenue_rolling_mean_7d
        FROM daily WINDOW w AS (PARTITION BY store ORDER BY date))
, c AS (SELECT {", ".join(f"corr({a}, {b}) AS \"{a}__{b}\"" for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:])} FROM f)
, u AS (UNPIVOT c ON COLUMNS(*) INTO NAME k VALUE r)
SELECT split_part(k, '__', 1) AS feature_1, split_part(k, '__', 2) AS feature_2, r FROM u WHERE abs(r) > 0.8"""),
          dbl="r")
def q_corr_pairs(spark, sf_dir):
    d = base.daily_by_store(spark, sf_dir).transform(lambda x: W.lags(x, ns=(1,))).transform(lambda x: W.rolling_lagged(x, windows=(7,)))
    return R.corr_pairs(d, CORR_COLS)


@register("dynamic_test_size", sql("""
SELECT store, count(*) AS n_rows,
       CASE WHEN count(*) < 30 THEN 0.1 WHEN count(*) < 90 THEN 0.15 WHEN count(*) < 180 THEN 0.2 ELSE 0.3 END AS test_size
FROM daily GROUP BY store"""))
def q_dynamic_test_size(spark, sf_dir):
    return R.dynamic_test_size(_d(spark, sf_dir))
