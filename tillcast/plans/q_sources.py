"""§2.1 sources / sinks / state, Box-Cox, and the remaining §2.10 interval rules as registered queries."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.columns import clip
from tillcast.operators import intervals as I
from tillcast.operators import lookups as L
from tillcast.operators import transforms as T
from tillcast.operators import windows as W
from tillcast.operators.reports import target_encoding_table, tiers
from tillcast.plans import base
from tillcast.plans.q_intervals import PP_SQL, pp
from tillcast.plans.q_lookups import YOY_CTES
from tillcast.plans.registry import register
from tillcast.plans.q_reports import TIER_CTES
from tillcast.plans.sqlbase import XAVG, recursive, sql
from tillcast.session import ensure_checkpoint_dir, shared_folder
from tillcast.sources import dates as DT
from tillcast.sources import driver
from tillcast.sources import files as FS
from tillcast.sources import state as ST

K = ["store", "date"]
FALLBACK_LOW = 45000.0  # driver revenue scale (reference: 1000)

LINE_SQL = """
SELECT CAST(l_suppkey AS VARCHAR) AS store, CAST(CAST(l_shipdate AS DATE) + INTERVAL 240 MONTH AS DATE) AS date,
       l_quantity AS qty_sold,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(6,4))) AS DOUBLE) AS revenue,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(6,4)) AS DOUBLE) AS disc_value,
       l_orderkey, l_linenumber
FROM lineitem"""


@register("src_sales", sql(LINE_SQL))
def q_src_sales(spark, sf_dir):
    """Transaction-level sales typed to the sales schema (one row per line item)."""
    raw = driver.table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = F.col("l_discount").cast("decimal(6,4)")
    return raw.select(F.col("l_suppkey").cast("string").alias("store"),
                      F.add_months(F.to_date("l_shipdate"), driver.YEARS_SHIFT_MONTHS).alias("date"),
                      F.col("l_quantity").alias("qty_sold"),
                      (price * (F.lit(1) - disc)).cast("double").alias("revenue"),
                      (price * disc).cast("double").alias("disc_value"), "l_orderkey", "l_linenumber")


MAPPING = {"l_suppkey": "store", "l_shipdate": "ship_ts", "l_quantity": "qty_sold", "l_extendedprice": "gross"}


@register("apply_mapping", sql("""
SELECT l_orderkey, l_linenumber, l_suppkey AS store, l_shipdate AS ship_ts, l_quantity AS qty_sold, l_extendedprice AS gross
FROM lineitem"""), dbl="gross")
def q_apply_mapping(spark, sf_dir):
    li = driver.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *MAPPING)
    return FS.apply_mapping(li, MAPPING)


@register("parse_dates", sql("""
SELECT l_orderkey, l_linenumber, CAST(substr(CAST(l_shipdate AS VARCHAR), 1, 10) AS DATE) AS date FROM lineitem"""))
def q_parse_dates(spark, sf_dir):
    li = driver.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber",
                                                         F.col("l_shipdate").cast("string").alias("date"))
    return FS.parse_dates(li, "date")


@register("validate_input", sql("SELECT store, date, qty_sold, revenue, disc_value FROM sales"))
def q_validate_input(spark, sf_dir):
    return FS.validate_input(base.sales(spark, sf_dir), required=("store", "date", "revenue"))


MIXED_TEXT = {0: ("MM/dd/yyyy", "%m/%d/%Y"), 1: ("dd.MM.yyyy", "%d.%m.%Y"), 2: ("yyyyMMdd", "%Y%m%d")}
MIXED_SQL = "CASE " + " ".join(f"WHEN l_orderkey % 3 = {k} THEN strftime(CAST(l_shipdate AS DATE), '{f}')" for k, (_, f) in MIXED_TEXT.items()) + " END"


@register("date_rejects", sql("""
SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 3 AS BIGINT) AS file, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date,
       CASE WHEN l_linenumber = 7 THEN 'unreadable' END AS reason FROM lineitem"""))
def q_date_rejects(spark, sf_dir):
    """Ship dates as text in one format per file, some of them unreadable: accepted dates and rejected rows."""
    li = driver.table(spark, sf_dir, "lineitem")
    file, day = (F.col("l_orderkey") % 3).cast("bigint"), F.to_date("l_shipdate")
    text = F.coalesce(*[F.when(file == k, F.date_format(day, f)) for k, (f, _) in MIXED_TEXT.items()])
    rows = li.select("l_orderkey", "l_linenumber", file.alias("file"), F.when(F.col("l_linenumber") == 7, "n/a").otherwise(text).alias("date"))
    good, bad = DT.parse_with_rejects(rows, "date", by="file")
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.withColumn("date", F.lit(None).cast("date")))


REPORT_COLS = ["store", "date", "revenue", "disc_value", "disc_perc"]


@register("sink_report", sql("SELECT store, date, revenue, disc_value, disc_perc FROM daily"))
def q_sink_report(spark, sf_dir):
    """Write the report columns as CSV into the shared folder and read them back with the schema."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"report-{uuid.uuid4().hex}")
    FS.write_report(base.daily(spark, sf_dir), path, REPORT_COLS)
    schema = "store string, date date, revenue double, disc_value double, disc_perc double"
    return spark.read.option("header", True).schema(schema).csv(path)


STATE_KEYS = ("city", "region", "channel")
STATE_SQL = "\nUNION ALL ".join([
    *[f"SELECT 'enc_{k}' AS kind, {k} AS value, NULL::VARCHAR AS label, {XAVG('revenue')} AS number FROM daily GROUP BY {k}" for k in STATE_KEYS],
    "SELECT 'tiers_' || level, value, tier, score FROM tier_rows",
    *[f"SELECT 'categories', value, '{k}', row_number() OVER (ORDER BY value) - 1.0 FROM (SELECT DISTINCT {k} AS value FROM daily WHERE {k} IS NOT NULL)" for k in STATE_KEYS],
    f"SELECT 'store_month_stats', store, CAST(month AS VARCHAR), COALESCE({XAVG('revenue')}, 0.0) FROM daily GROUP BY store, month",
    "SELECT 'train_range', NULL, CAST(min(date) AS VARCHAR) || ' ' || CAST(max(date) AS VARCHAR), count(*) FROM daily"])


def saved_state(spark, sf_dir) -> ST.State:
    """Everything that scoring reads, written as one version of the state and opened again from its manifest:
    encodings, tiers of cities and regions, category lists, store-month statistics and the training range."""
    from tillcast.operators.encoding import tiers_filled
    from tillcast.operators.reports import category_lists, store_month_stats
    d = base.daily(spark, sf_dir)
    tables = {f"enc_{k}": target_encoding_table(d, k).withColumnsRenamed({k: "value", f"{k}_encoded": "encoded"}) for k in STATE_KEYS}
    tables |= {f"tiers_{k}": tiers_filled(d, k) for k in ("city", "region")}
    tables |= {"categories": category_lists(d), "store_month_stats": store_month_stats(d)}
    span = d.agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b"), F.count(F.lit(1)).alias("n")).first()
    root = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    version = ST.write_state(spark, root, tables, settings={"train_from": span["a"], "train_to": span["b"], "rows": span["n"]})
    return ST.read_state(spark, root, version)


STATE_KEYS = ("city", "region", "channel")
ENCODED_SQL = " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS value, {XAVG('revenue')} AS encoded FROM daily GROUP BY {k}" for k in STATE_KEYS)


@register("snapshot_state", sql(ENCODED_SQL), dbl="encoded")
def q_snapshot_state(spark, sf_dir):
    """Encodings as scoring reads them: from the saved state."""
    state = saved_state(spark, sf_dir)
    parts = [state.table(f"enc_{k}").select(F.lit(k).alias("kind"), "value", "encoded") for k in STATE_KEYS]
    return reduce(DataFrame.unionByName, parts)


STATE_SQL = "\nUNION ALL ".join([
    "SELECT 'tiers_' || level AS kind, value, tier AS label, score AS number FROM tier_rows",
    *[f"SELECT 'categories', value, '{k}', row_number() OVER (ORDER BY value) - 1.0 FROM (SELECT DISTINCT {k} AS value FROM daily WHERE {k} IS NOT NULL) c_{k}" for k in STATE_KEYS],
    f"SELECT 'store_month_stats', store, CAST(month AS VARCHAR), COALESCE({XAVG('revenue')}, 0.0) FROM daily GROUP BY store, month",
    "SELECT 'train_range', NULL, CAST(min(date) AS VARCHAR) || ' ' || CAST(max(date) AS VARCHAR), count(*) FROM daily"])


@register("state_tables", sql(f"{TIER_CTES}\nSELECT kind, value, label, CAST(number AS DOUBLE) AS number FROM ({STATE_SQL}) state"), dbl="number")
def q_state_tables(spark, sf_dir):
    """The other parts of the saved state, read back: tiers, category lists, store-month means, training range."""
    state = saved_state(spark, sf_dir)
    parts = [state.table(f"tiers_{k}").select(F.lit(f"tiers_{k}").alias("kind"), "value", F.col("tier").alias("label"), F.col("score").alias("number")) for k in ("city", "region")]
    parts.append(state.table("categories").select(F.lit("categories").alias("kind"), "value", F.col("column").alias("label"), F.col("position").cast("double").alias("number")))
    parts.append(state.table("store_month_stats").select(F.lit("store_month_stats").alias("kind"), F.col("store").alias("value"), F.col("month").cast("string").alias("label"),
                                                         F.col("store_month_revenue_mean").alias("number")))
    s = state.settings
    parts.append(spark.createDataFrame([("train_range", None, f"{s['train_from']} {s['train_to']}", float(s["rows"]))], "kind string, value string, label string, number double"))
    return reduce(DataFrame.unionByName, parts)


# Box-Cox --------------------------------------------------------------------------

BC_CLUSTERS = ", ".join(f"'{c}'" for c in T.BOXCOX_CLUSTERS)
BC_Y = "CASE WHEN abs(lam) < 1e-6 THEN l + lam * l * l / 2 ELSE (exp(lam * l) - 1.0) / lam END"
BC_DY = f"CASE WHEN abs(lam) < 1e-6 THEN l * l / 2 + lam * l * l * l / 3 ELSE (l * exp(lam * l) - ({BC_Y})) / lam END"
# Bisection on the derivative of the likelihood, fifty halvings per cluster.
BOXCOX_CTES = f"""
, bx AS (SELECT store_cluster, ln(revenue + 1.0) AS l FROM daily WHERE store_cluster IN ({BC_CLUSTERS}) AND revenue + 1.0 > 0)
, it AS (
  SELECT DISTINCT store_cluster, 0 AS k, -2.0::DOUBLE AS lo, 2.0::DOUBLE AS hi FROM bx
  UNION ALL
  SELECT store_cluster, k + 1, CASE WHEN g > 0 THEN lam ELSE lo END, CASE WHEN g > 0 THEN hi ELSE lam END
  FROM (SELECT store_cluster, any_value(k) AS k, any_value(lo) AS lo, any_value(hi) AS hi, any_value(lam) AS lam,
               sum(l) - count(*) * covar_pop({BC_Y}, {BC_DY}) / var_pop({BC_Y}) AS g
        FROM (SELECT it.*, (lo + hi) / 2 AS lam, bx.l FROM it JOIN bx ON bx.store_cluster = it.store_cluster WHERE k < 50) GROUP BY store_cluster))
, lam_ AS (SELECT store_cluster, (lo + hi) / 2 AS lam FROM it WHERE k = 50)
, lambdas AS (SELECT bx.store_cluster, any_value(lam) AS boxcox_lambda, (any_value(lam) - 1.0) * sum(l) - count(*) / 2.0 * ln(var_pop({BC_Y})) AS llf
              FROM bx JOIN lam_ ON lam_.store_cluster = bx.store_cluster GROUP BY bx.store_cluster)"""


@register("boxcox_lambda", recursive(f"{BOXCOX_CTES} SELECT store_cluster, boxcox_lambda, llf FROM lambdas"), dbl="boxcox_lambda llf")
def q_boxcox_lambda(spark, sf_dir):
    return T.boxcox_lambda(base.daily(spark, sf_dir))


@register("boxcox", recursive(f"""{BOXCOX_CTES}
SELECT d.store, d.date, d.store_cluster,
       CASE WHEN l.boxcox_lambda IS NULL THEN NULL WHEN l.boxcox_lambda = 0 THEN ln(d.revenue + 1.0)
            ELSE (pow(d.revenue + 1.0, l.boxcox_lambda) - 1.0) / l.boxcox_lambda END AS revenue_boxcox
FROM daily d LEFT JOIN lambdas l ON l.store_cluster = d.store_cluster"""), dbl="revenue_boxcox")
def q_boxcox(spark, sf_dir):
    d = base.daily(spark, sf_dir)
    return T.boxcox(d, T.boxcox_lambda(d)).select(*K, "store_cluster", "revenue_boxcox")


# Remaining interval rules ------------------------------------------------------------

def _pp_with_yoy(spark, sf_dir):
    d = base.daily_by_store(spark, sf_dir).transform(W.store_baselines)  # baselines over the whole history
    p = I.past_predictions(d)
    p = p.withColumn("discount_pct", clip(F.col("disc_perc") / 100.0, 0.0, 1.0))
    return L.yoy_fallback(p.drop("month", "day_of_week").withColumn("_m", F.month("date")), base.daily(spark, sf_dir)
                          ).drop("_m")


PPY_SQL = f"""{PP_SQL}{YOY_CTES}
, ppy AS (SELECT pp.*, LEAST(GREATEST(pp.disc_perc / 100.0, 0.0), 1.0) AS discount_pct,
                 CASE WHEN k.latest IS NULL THEN gm.gm WHEN k.ny > 1 AND k.growth IS NOT NULL THEN k.latest * (1.0 + k.growth)
                      ELSE k.latest END * ((100.0 + COALESCE(LEAST(GREATEST(pp.disc_perc / 100.0, 0.0), 1.0), 0.0) * 100.0) / 100.0)
                   AS yoy_fallback
          FROM pp LEFT JOIN k ON k.store = pp.store AND k.month = pp.month AND k.dow = pp.day_of_week CROSS JOIN gm)
, base_avg AS (SELECT store, date, {XAVG('revenue', '(PARTITION BY store, month)')} AS store_month_avg,
                      {XAVG('revenue', '(PARTITION BY store, day_of_week)')} AS store_dayofweek_avg FROM daily)"""


@register("final_floor", sql(f"""{PPY_SQL}
SELECT store, date, GREATEST(p10, yoy_fallback) AS p10, GREATEST(p50, yoy_fallback) AS p50,
       GREATEST(p90, yoy_fallback) AS p90 FROM ppy"""), dbl="p10 p50 p90")
def q_final_floor(spark, sf_dir):
    return I.final_floor(_pp_with_yoy(spark, sf_dir)).select(*K, "p10", "p50", "p90")


@register("fallback_invalid", sql(f"""{PPY_SQL}
, x1 AS (SELECT ppy.store, ppy.date, CASE WHEN ppy.day_of_week = 0 THEN 0.0 ELSE ppy.p50 END AS pred, ppy.yoy_fallback,
               b.store_month_avg, b.store_dayofweek_avg
        FROM ppy JOIN base_avg b ON b.store = ppy.store AND b.date = ppy.date)
, y1 AS (SELECT *, CASE WHEN pred IS NULL OR isnan(pred) OR isinf(pred) OR pred = 0 THEN yoy_fallback ELSE pred END AS p1,
               (pred IS NULL OR isnan(pred) OR isinf(pred) OR pred = 0) AS invalid FROM x1)
SELECT store, date, CAST(invalid OR p1 < {FALLBACK_LOW} AS INTEGER) AS fallback_triggered,
       CASE WHEN p1 < {FALLBACK_LOW} THEN GREATEST(store_dayofweek_avg, store_month_avg) ELSE p1 END AS p50 FROM y1"""),
          dbl="p50")
def q_fallback_invalid(spark, sf_dir):
    d = _pp_with_yoy(spark, sf_dir)
    d = d.withColumn("pred", F.when(F.weekday("date") == 0, F.lit(0.0)).otherwise(F.col("p50")))
    return I.fallback_invalid(d, "pred", low=FALLBACK_LOW).select(*K, "fallback_triggered", "p50")


@register("weak_signal")
def q_weak_signal(spark, sf_dir):
    """|attribution| sum below 0.05 → 7-row mean, then ½ last-3 + ½ city mean (needs the SHAP table)."""
    from tillcast.operators.reports import target_encode
    from tillcast.plans.q_models import attribution_table
    att = attribution_table(spark, sf_dir).select(*K, F.aggregate(F.transform("shap", lambda v: F.abs(v)), F.lit(0.0),
                                                                 lambda a, b: a + b).alias("shap_sum"))
    d = pp(spark, sf_dir).transform(W.last3).transform(lambda x: W.rolling_lagged(x, windows=(7,)))
    d = target_encode(d, keys=("city",), fit=base.daily(spark, sf_dir)).join(att, K, "inner")
    return I.weak_signal(d).select(*K, "shap_sum", "p50")


@register("band_rules", sql(f"""{PP_SQL}
, ce AS (SELECT city, {XAVG('revenue')} AS city_encoded FROM daily GROUP BY city)
, e5 AS (SELECT quantile_cont(store_area, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM daily)
, f AS (
  SELECT pp.*, COALESCE(ce.city_encoded, 0.0) AS city_encoded,
         len(list_filter((list_sort(list_distinct(e5.e)))[2:len(list_distinct(e5.e)) - 1], lambda v: v < pp.store_area)) AS store_area_bucket,
         stddev_samp(revenue) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
           / NULLIF({XAVG('revenue', '(PARTITION BY store ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')}, 0)
           AS revenue_volatility_3d,
         quantile_cont(revenue, 0.5) OVER (PARTITION BY store, month ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           / NULLIF(quantile_cont(revenue, 0.5) OVER (PARTITION BY store, month), 0) AS seasonal_index,
         quantile_cont(revenue, 0.5) OVER (PARTITION BY store, month ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS store_month_revenue_median,
         stddev_samp(revenue) OVER (PARTITION BY store, month ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS store_month_revenue_std
  FROM pp LEFT JOIN ce ON ce.city = pp.city CROSS JOIN e5)
, g AS (SELECT *, seasonal_index * store_area_bucket AS store_seasonal_index,
               store_area * city_encoded * LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0) AS premium_location_discount,
               COALESCE(revenue_volatility_3d, 0.0) AS vol FROM f)
, h AS (SELECT store, date, store_seasonal_index, store_month_revenue_median, store_month_revenue_std, premium_location_discount,
               list_sort([CASE WHEN vol > 0.4 THEN p50 - (p50 - p10) * 1.2 ELSE p10 END, p50,
                          CASE WHEN vol > 0.4 THEN p50 + (p90 - p50) * 1.2 ELSE p90 END]) AS a FROM g)
, i AS (SELECT *, a[1] AS p10, a[2] AS p50, LEAST(a[3], store_seasonal_index * 2.0 * a[2]) AS p90a FROM h)
SELECT store, date, p10, p50,
       LEAST(p90a, store_month_revenue_median + store_month_revenue_std * 2.0) + premium_location_discount * 0.1 AS p90
FROM i"""), dbl="p10 p50 p90")
def q_band_rules(spark, sf_dir):
    from tillcast.operators.reports import target_encode
    daily = base.daily(spark, sf_dir)
    d = pp(spark, sf_dir).withColumn("discount_pct", clip(F.col("disc_perc") / 100.0, 0.0, 1.0))
    d = target_encode(d, keys=("city",), fit=daily)
    d = T.qcut(d, "store_area", 5, "store_area_bucket", fit=daily)
    d = d.transform(W.volatility3).transform(W.seasonal_index).transform(W.expanding_store_month)
    d = d.withColumn("store_seasonal_index", F.col("seasonal_index") * F.col("store_area_bucket"))
    d = d.withColumn("premium_location_discount", F.col("store_area") * F.col("city_encoded") * F.col("discount_pct"))
    return I.band_rules(d).select(*K, "p10", "p50", "p90")
