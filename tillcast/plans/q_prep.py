"""§2.6 ordered limits, §2.7 encodings and §2.8 weights / splits as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.operators import encoding as E
from tillcast.operators import splits as S
from tillcast.operators import topk as TK
from tillcast.operators import weights as WT
from tillcast.operators.geo import city_state_sql, geo_classify, state_region_sql
from tillcast.plans import base
from tillcast.plans.registry import register
from tillcast.plans.sqlbase import sql

K = ["store", "date"]
HIGH = 7.5
LAST_K_BEFORE = "2021-06-01"
# --- Fixed values: decay rates per cluster for ``weights_cluster`` ---
CLUSTER_DECAY = [("ONLINE", 0.05), ("PREMIUM_OFFLINE", 0.1), ("SEASONAL_SPECIALIST", 0.2),
                 ("HOLIDAY_SPECIALIST", 0.3), ("MEDIUM_OFFLINE", 0.15)]
# ---------------------------------------------------------------------
DECAY_GRID = [round(0.01 * i, 2) for i in range(1, 51)]  # 0.01 … 0.50


def _d(spark, sf_dir):
    return base.daily(spark, sf_dir)


# §2.6 ------------------------------------------------------------------------

@register("top_discounts", sql("""
SELECT store, date, revenue, disc_value, disc_perc FROM daily ORDER BY disc_perc DESC, store, date LIMIT 5"""),
          dbl="disc_perc")
def q_top_discounts(spark, sf_dir):
    return TK.top_discounts(_d(spark, sf_dir)).select(*K, "revenue", "disc_value", "disc_perc")


@register("sample_high", sql(f"""
SELECT store, date, revenue, disc_value, disc_perc FROM daily WHERE disc_perc > {HIGH} ORDER BY store, date LIMIT 5"""),
          dbl="disc_perc")
def q_sample_high(spark, sf_dir):
    return TK.sample_high(_d(spark, sf_dir), HIGH).select(*K, "revenue", "disc_value", "disc_perc")


@register("last_k_per_store", sql(f"""
SELECT store, date, revenue FROM (
  SELECT store, date, revenue, row_number() OVER (PARTITION BY store ORDER BY date DESC) AS rn
  FROM daily WHERE date < DATE '{LAST_K_BEFORE}') WHERE rn <= 60"""))
def q_last_k_per_store(spark, sf_dir):
    return TK.last_k_per_store(_d(spark, sf_dir), LAST_K_BEFORE).select(*K, "revenue")


# §2.7 ------------------------------------------------------------------------

@register("area_impute", sql("""
SELECT store, date, COALESCE(store_area, (SELECT quantile_cont(store_area, 0.5) FROM daily)) AS store_area FROM daily"""),
          dbl="store_area")
def q_area_impute(spark, sf_dir):
    return E.area_impute(_d(spark, sf_dir)).select(*K, "store_area")


def _bucket_sql(x, edges, closed):
    inner = f"(list_sort(list_distinct({edges})))[2:len(list_distinct({edges})) - 1]"
    op = "<=" if closed == "left" else "<"
    return f"len(list_filter({inner}, lambda v: v {op} {x}))"


@register("kbins", sql(f"""
, e AS (SELECT quantile_cont(store_area, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS edges FROM stores)
SELECT id, store_area, {_bucket_sql('store_area', 'edges', 'left')} AS store_area_bucket,
       {_bucket_sql('store_area', 'edges', 'right')} AS store_area_bucket_scoring
FROM stores CROSS JOIN e"""), dbl="store_area")
def q_kbins(spark, sf_dir):
    st = base.stores(spark, sf_dir)
    edges = E.kbins_fit(st)
    a = E.kbins_apply(st, edges, closed="left")
    a = E.kbins_apply(a, edges, out="store_area_bucket_scoring", closed="right")
    return a.select("id", "store_area", "store_area_bucket", "store_area_bucket_scoring")


@register("equal_width3", sql("""
, mm AS (SELECT min(store_area) AS mn, max(store_area) AS mx FROM stores)
, c AS (SELECT id, store_area, CASE WHEN store_area IS NULL THEN NULL
                                    WHEN store_area <= mn + (mx - mn) / 3.0 THEN 0
                                    WHEN store_area <= mn + (mx - mn) / 3.0 * 2.0 THEN 1 ELSE 2 END AS area_class_code
        FROM stores CROSS JOIN mm)
SELECT id, store_area, area_class_code, (['SMALL_OFFLINE', 'MEDIUM_OFFLINE', 'LARGE_OFFLINE'])[area_class_code + 1] AS area_class
FROM c"""), dbl="store_area")
def q_equal_width3(spark, sf_dir):
    return E.equal_width3(base.stores(spark, sf_dir)).select("id", "store_area", "area_class_code", "area_class")


def _cat_sql(expr, name):
    return sql(f"""
, c AS (SELECT store, date, {expr} AS {name} FROM daily)
, i AS (SELECT {name}, dense_rank() OVER (ORDER BY {name}) - 1 AS {name}_index FROM (SELECT DISTINCT {name} FROM c WHERE {name} IS NOT NULL))
SELECT c.store, c.date, c.{name}, i.{name}_index FROM c LEFT JOIN i ON i.{name} = c.{name}""")


@register("onehot_weekday_store", _cat_sql("'wdst_' || CAST(day_of_week AS VARCHAR) || '_' || store", "wdst"))
def q_onehot_weekday_store(spark, sf_dir):
    return E.onehot_weekday_store(_d(spark, sf_dir)).select(*K, "wdst", "wdst_index")


@register("onehot_rcm", _cat_sql("'rcm_' || concat_ws('_', region, channel, CAST(month AS VARCHAR))", "rcm"))
def q_onehot_rcm(spark, sf_dir):
    return E.onehot_rcm(_d(spark, sf_dir)).select(*K, "rcm", "rcm_index")


ONEHOT_STORE = ["city", "state", "region_classified", "store_cluster"]


@register("onehot_store", sql(f"""
, c2s AS ({city_state_sql()}), s2r AS ({state_region_sql()})
, sg AS (SELECT st.*, c2s.state, s2r.region_classified FROM stores st
         LEFT JOIN c2s ON st.city = c2s._city LEFT JOIN s2r ON c2s.state = s2r.state)
, long AS ({" UNION ALL ".join(f"SELECT id, '{f}' AS feature, '{f}_' || {f} AS category FROM sg WHERE {f} IS NOT NULL" for f in ONEHOT_STORE)})
SELECT id, feature, category, dense_rank() OVER (PARTITION BY feature ORDER BY category) - 1 AS category_index FROM long"""))
def q_onehot_store(spark, sf_dir):
    st = geo_classify(base.stores(spark, sf_dir))
    long = st.select("id", *ONEHOT_STORE).unpivot("id", ONEHOT_STORE, "feature", "v").where(F.col("v").isNotNull())
    long = long.withColumn("category", F.concat(F.col("feature"), F.lit("_"), F.col("v")))
    from tillcast.functions.quantiles import rank_within
    cats = rank_within(long.select("feature", "category").distinct(), "feature", ["category"], out="_pr",
                       index_out="category_index").drop("_pr")
    return long.join(cats, ["feature", "category"], "left").select("id", "feature", "category", "category_index")


@register("cluster_month", sql("""
SELECT store, date, 'cluster_' || store_cluster || '_month_' || CAST(month AS VARCHAR) || '_interaction'
         AS cluster_month_interaction FROM daily"""))
def q_cluster_month(spark, sf_dir):
    return E.cluster_month(_d(spark, sf_dir)).select(*K, "cluster_month_interaction")


# §2.8 ------------------------------------------------------------------------

AGE_SQL = ", a AS (SELECT *, date_diff('day', date, (SELECT max(date) FROM daily)) AS age FROM daily)"


@register("weights_blend", sql(f"""{AGE_SQL}
, p AS (SELECT quantile_cont(revenue, 0.95) AS p95 FROM daily)
, b AS (SELECT a.*, 1.0 / (1.0 + ln(1 + age)) AS td, ln(1 + LEAST(revenue, p95)) AS lw FROM a CROSS JOIN p)
, m AS (SELECT avg(td) AS mtd, avg(lw) AS mlw FROM b)
, c AS (SELECT b.*, td / mtd * 0.6 + lw / mlw * 0.4 AS cw FROM b CROSS JOIN m)
SELECT store, date, cw / (SELECT avg(cw) FROM c) AS weight FROM c"""), dbl="weight")
def q_weights_blend(spark, sf_dir):
    return WT.weights_blend(_d(spark, sf_dir)).select(*K, "weight")


DECAY_SQL = f"""{AGE_SQL}
, r AS (SELECT *, exp(-0.1 * ln(1 + age)) * CASE WHEN day_of_week >= 5 THEN 1.5 ELSE 1.0 END AS raw FROM a)
, wd AS (SELECT *, raw / sum(raw) OVER () AS weight, raw / sum(raw) OVER () * count(*) OVER () AS weight_x_n FROM r)"""


@register("weights_decay", sql(f"{DECAY_SQL} SELECT store, date, weight, weight_x_n FROM wd"), dbl="weight weight_x_n")
def q_weights_decay(spark, sf_dir):
    return WT.weights_decay(_d(spark, sf_dir)).select(*K, "weight", "weight_x_n")


@register("weights_recent", sql(f"""{DECAY_SQL}
, r2 AS (SELECT *, CASE WHEN date > (SELECT max(date) FROM daily) - 90 THEN weight * 1.5 ELSE weight END AS raw2 FROM wd)
SELECT store, date, raw2 / sum(raw2) OVER () AS weight, raw2 / sum(raw2) OVER () * count(*) OVER () AS weight_x_n FROM r2"""),
          dbl="weight weight_x_n")
def q_weights_recent(spark, sf_dir):
    return WT.weights_recent(WT.weights_decay(_d(spark, sf_dir))).select(*K, "weight", "weight_x_n")


RATES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {r})" for c, r in CLUSTER_DECAY) + ") AS t(store_cluster, decay)"


@register("weights_cluster", sql(f"""{AGE_SQL}
, rt AS ({RATES_SQL})
, r AS (SELECT a.store, a.date, exp(-rt.decay * ln(1 + a.age)) AS raw FROM a LEFT JOIN rt ON rt.store_cluster = a.store_cluster)
SELECT store, date, raw / sum(raw) OVER () AS weight, raw / sum(raw) OVER () * count(*) OVER () AS weight_x_n FROM r"""),
          dbl="weight weight_x_n")
def q_weights_cluster(spark, sf_dir):
    rates = spark.createDataFrame(CLUSTER_DECAY, "store_cluster string, decay double")
    return WT.weights_cluster(_d(spark, sf_dir), rates).select(*K, "weight", "weight_x_n")


@register("weight_profile", sql(f"""{DECAY_SQL}
SELECT 'day_of_week' AS level, day_of_week AS key, avg(weight_x_n) AS mean, stddev_samp(weight_x_n) AS std, count(weight_x_n) AS count
FROM wd GROUP BY day_of_week
UNION ALL
SELECT 'month', month, avg(weight_x_n), stddev_samp(weight_x_n), count(weight_x_n) FROM wd GROUP BY month"""),
          dbl="mean std")
def q_weight_profile(spark, sf_dir):
    w = WT.weights_decay(_d(spark, sf_dir))
    a = WT.weight_profile(w, "day_of_week").select(F.lit("day_of_week").alias("level"), F.col("day_of_week").alias("key"), "mean", "std", "count")
    b = WT.weight_profile(w, "month").select(F.lit("month").alias("level"), F.col("month").alias("key"), "mean", "std", "count")
    return a.unionByName(b)


@register("percentile_report", sql(f"""{DECAY_SQL}
SELECT unnest([0, 10, 25, 50, 75, 90, 100]) AS percentile,
       unnest(quantile_cont(weight_x_n, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])) AS value FROM wd"""), dbl="value")
def q_percentile_report(spark, sf_dir):
    return WT.percentile_report(WT.weights_decay(_d(spark, sf_dir)), "weight_x_n")


def _split_sql(n_splits, test_size, wrap):
    if wrap:
        test = ("CASE WHEN (s + nt) % G > s THEN r >= s AND r < (s + nt) % G "
                "ELSE r >= s OR r < (s + nt) % G END")
    else:
        test = "r >= fold * nt AND r < LEAST((fold + 1) * nt, G)"
    return f"""
, g AS (SELECT store, dense_rank() OVER (ORDER BY store) - 1 AS r, count(*) OVER () AS G FROM (SELECT DISTINCT store FROM daily))
, f AS (SELECT g.*, fold, GREATEST(1, CAST(floor(G * {test_size}) AS INTEGER)) AS nt,
               (fold * GREATEST(1, CAST(floor(G * {test_size}) AS INTEGER))) % G AS s
        FROM g CROSS JOIN (SELECT range AS fold FROM range(0, {n_splits})) t)
, plan AS (SELECT store, fold, CAST({test} AS INTEGER) AS is_test FROM f)"""


@register("group_split", sql(f"{_split_sql(5, 0.2, False)} SELECT * FROM plan"))
def q_group_split(spark, sf_dir):
    return S.group_split(_d(spark, sf_dir))


@register("group_split_wrap", sql(f"{_split_sql(5, 0.3, True)} SELECT * FROM plan"))
def q_group_split_wrap(spark, sf_dir):
    return S.group_split(_d(spark, sf_dir), test_size=0.3, wrap=True)


@register("fold_sizes", sql(f"""{_split_sql(5, 0.2, False)}
, c AS (SELECT store, count(*) AS n FROM daily GROUP BY store)
SELECT fold, CAST(sum(CASE WHEN is_test = 1 THEN n ELSE 0 END) AS BIGINT) AS n_test,
       CAST(sum(CASE WHEN is_test = 0 THEN n ELSE 0 END) AS BIGINT) AS n_train
FROM plan LEFT JOIN c ON c.store = plan.store GROUP BY fold"""))
def q_fold_sizes(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.fold_sizes(d, S.group_split(d))


@register("stratified_split", sql(f"""{_split_sql(5, 0.2, False)}
, e AS (SELECT quantile_cont(revenue, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS edges FROM daily)
, b AS (SELECT store, {_bucket_sql('revenue', 'edges', 'right')} AS bin FROM daily CROSS JOIN e)
, cnt AS (SELECT store, bin, count(*) AS n FROM b GROUP BY store, bin)
, per AS (SELECT fold, is_test, bin, CAST(sum(n) AS BIGINT) AS count FROM plan JOIN cnt ON cnt.store = plan.store
          GROUP BY fold, is_test, bin)
SELECT fold, is_test, bin, count, CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY fold, is_test) AS proportion FROM per"""),
          dbl="proportion")
def q_stratified_split(spark, sf_dir):
    return S.stratified_split(_d(spark, sf_dir))


@register("train_test_8020")
def q_train_test_8020(spark, sf_dir):
    """Deterministic hashed 80/20 split (rows-only check; the invariant test checks the share)."""
    return S.train_test_split(_d(spark, sf_dir)).select(*K, "is_test")


DGRID_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({d})" for d in DECAY_GRID) + ") AS t(decay)"


@register("decay_search", sql(f"""{_split_sql(5, 0.2, False)}
, rows_ AS (SELECT store, store_cluster, day_of_week AS dow, revenue AS y,
                   ln(1 + date_diff('day', date, (SELECT max(date) FROM daily))) AS la FROM daily)
, ex AS (SELECT rows_.*, g.decay, exp(-g.decay * la) AS w FROM rows_ CROSS JOIN ({DGRID_SQL}) g)
, mom AS (SELECT store, store_cluster, dow, decay, sum(w) AS s0, sum(w * y) AS s1, sum(w * y * y) AS s2
          FROM ex GROUP BY store, store_cluster, dow, decay)
, side AS (SELECT fold, store_cluster, dow, decay,
                  sum(CASE WHEN is_test = 0 THEN s0 END) AS tr_s0, sum(CASE WHEN is_test = 0 THEN s1 END) AS tr_s1,
                  sum(CASE WHEN is_test = 1 THEN s0 END) AS te_s0, sum(CASE WHEN is_test = 1 THEN s1 END) AS te_s1,
                  sum(CASE WHEN is_test = 1 THEN s2 END) AS te_s2
           FROM mom JOIN plan ON plan.store = mom.store GROUP BY fold, store_cluster, dow, decay)
, sse AS (SELECT *, te_s2 - 2.0 * (tr_s1 / tr_s0) * te_s1 + (tr_s1 / tr_s0) * (tr_s1 / tr_s0) * te_s0 AS sse
          FROM side WHERE te_s0 IS NOT NULL AND tr_s0 IS NOT NULL)
, fold_ AS (SELECT fold, store_cluster, decay, sqrt(GREATEST(sum(sse) / sum(te_s0), 0.0)) AS rmse FROM sse
            GROUP BY fold, store_cluster, decay)
, per AS (SELECT store_cluster, decay, avg(rmse) AS mean_rmse FROM fold_ GROUP BY store_cluster, decay)
SELECT store_cluster, arg_min(decay, (mean_rmse, decay)) AS best_decay, min(mean_rmse) AS mean_rmse
FROM per GROUP BY store_cluster"""), dbl="best_decay mean_rmse")
def q_decay_search(spark, sf_dir):
    return S.decay_search(_d(spark, sf_dir), DECAY_GRID)
