"""Remaining inventory keys: small projections / joins with oracles, model persistence, iterative pruning,
and inventory keys that name an operator already registered under a more specific key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.functions.columns import clip, safe_div
from tillcast.operators import reports as R
from tillcast.operators import windows as W
from tillcast.operators.joins import maybe_broadcast
from tillcast.plans import base
from tillcast.plans.registry import REGISTRY, Query, register
from tillcast.plans.sqlbase import XAVG, sql
from tillcast.sources import driver
from tillcast.sources.festivals import festivals

K = ["store", "date"]


@register("src_festivals", sql("""
SELECT f.date, f.festival FROM festivals f
WHERE f.date BETWEEN (SELECT min(date) FROM sales) AND (SELECT max(date) FROM sales)"""))
def q_src_festivals(spark, sf_dir):
    """The festival calendar restricted to the span of the sales history."""
    span = driver.sales(spark, sf_dir).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    f = festivals(spark).crossJoin(F.broadcast(span))
    return f.where((F.col("date") >= F.col("_lo")) & (F.col("date") <= F.col("_hi"))).select("date", "festival")


@register("discount_per_sqft", sql("""
SELECT store, date, LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0) * revenue / NULLIF(store_area, 0) AS discount_per_sqft
FROM daily"""), dbl="discount_per_sqft")
def q_discount_per_sqft(spark, sf_dir):
    d = base.daily(spark, sf_dir).withColumn("discount_pct", clip(F.col("disc_perc") / 100.0, 0.0, 1.0))
    return d.select(*K, safe_div(F.col("discount_pct") * F.col("revenue"), F.col("store_area")).alias("discount_per_sqft"))


@register("weekend_discount", sql("""
SELECT store, date, is_weekend * LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0) AS weekend_discount_interaction FROM daily"""),
          dbl="weekend_discount_interaction")
def q_weekend_discount(spark, sf_dir):
    from tillcast.operators.calendar import weekend_discount
    d = base.daily(spark, sf_dir).withColumn("discount_pct", clip(F.col("disc_perc") / 100.0, 0.0, 1.0))
    return weekend_discount(d).select(*K, "weekend_discount_interaction")


EXP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@register("join_stats", sql(f"""
SELECT store, date,
       quantile_cont(revenue, 0.5) OVER (PARTITION BY store ORDER BY date {EXP}) AS revenue_median,
       stddev_samp(revenue) OVER (PARTITION BY store ORDER BY date {EXP}) AS revenue_std,
       quantile_cont(revenue, 0.5) OVER (PARTITION BY store, month ORDER BY date {EXP}) AS store_month_revenue_median,
       stddev_samp(revenue) OVER (PARTITION BY store, month ORDER BY date {EXP}) AS store_month_revenue_std,
       quantile_cont(revenue, 0.5) OVER (PARTITION BY store, month ORDER BY date {EXP})
         / NULLIF(quantile_cont(revenue, 0.5) OVER (PARTITION BY store, month), 0) AS seasonal_index
FROM daily"""), dbl="revenue_median revenue_std store_month_revenue_median store_month_revenue_std seasonal_index")
def q_join_stats(spark, sf_dir):
    """Store, store-month and seasonal statistics attached to every store-day.  The reference joins three
    stat tables back on (store, date) / (store, month, date); here they are computed in place by windows
    that share the store partitioning, so the joins fold away."""
    d = base.daily(spark, sf_dir).transform(W.expanding_store).transform(W.expanding_store_month).transform(W.seasonal_index)
    return d.select(*K, "revenue_median", "revenue_std", "store_month_revenue_median", "store_month_revenue_std",
                    "seasonal_index")


GEO_COLS = ["revenue_avg", "revenue_std", "quantity_avg", "discount_avg"]


def _geo_sql(k):
    z = ", ".join(f"(g.{c} - m.m_{c}) / NULLIF(m.s_{c}, 0) AS {k}_{c}" for c in GEO_COLS)
    mom = ", ".join([f"avg({c}) AS m_{c}" for c in GEO_COLS] + [f"stddev_samp({c}) AS s_{c}" for c in GEO_COLS])
    return f"""
  SELECT g.{k}, {z} FROM (
    SELECT {k}, COALESCE({XAVG('revenue')}, 0.0) AS revenue_avg, COALESCE(stddev_samp(revenue), 0.0) AS revenue_std,
           COALESCE({XAVG('qty_sold')}, 0.0) AS quantity_avg, COALESCE({XAVG('disc_value')}, 0.0) AS discount_avg
    FROM daily GROUP BY {k}) g
  CROSS JOIN (SELECT {mom} FROM (
    SELECT {k}, COALESCE({XAVG('revenue')}, 0.0) AS revenue_avg, COALESCE(stddev_samp(revenue), 0.0) AS revenue_std,
           COALESCE({XAVG('qty_sold')}, 0.0) AS quantity_avg, COALESCE({XAVG('disc_value')}, 0.0) AS discount_avg
    FROM daily GROUP BY {k})) m"""


@register("geo_features", sql(f"""
, gc AS ({_geo_sql('city')}), gr AS ({_geo_sql('region')})
SELECT st.id, {", ".join(f"gc.city_{c}" for c in GEO_COLS)}, {", ".join(f"gr.region_{c}" for c in GEO_COLS)}
FROM stores st LEFT JOIN gc ON gc.city = st.city LEFT JOIN gr ON gr.region = st.region"""),
          dbl=" ".join([f"city_{c}" for c in GEO_COLS] + [f"region_{c}" for c in GEO_COLS]))
def q_geo_features(spark, sf_dir):
    d = base.daily(spark, sf_dir)
    st = base.stores(spark, sf_dir)
    out = st.join(maybe_broadcast(R.geo_profile(d, "city"), materialize=True), "city", "left").join(
        maybe_broadcast(R.geo_profile(d, "region"), materialize=True), "region", "left")
    return out.select("id", *[f"city_{c}" for c in GEO_COLS], *[f"region_{c}" for c in GEO_COLS])


def _z_sql(k):
    return (f"(LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0) - avg(LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0)) OVER (PARTITION BY {k}))"
            f" / COALESCE(NULLIF(stddev_samp(LEAST(GREATEST(disc_perc / 100.0, 0.0), 1.0)) OVER (PARTITION BY {k}), 0), 1.0)")


@register("discount_z", sql(f"""
SELECT store, date, {_z_sql('channel')} AS discount_pct_z_channel, {_z_sql('region')} AS discount_pct_z_region FROM daily"""),
          dbl="discount_pct_z_channel discount_pct_z_region")
def q_discount_z(spark, sf_dir):
    """z-score of the discount within channel and within region (std 0 → 1).  Group moments are a grouped
    aggregate joined back — a window over a handful of channels would put all rows in a few tasks."""
    d = base.daily(spark, sf_dir).withColumn("discount_pct", clip(F.col("disc_perc") / 100.0, 0.0, 1.0))
    for k in ("channel", "region"):
        g = d.groupBy(k).agg(F.avg("discount_pct").alias(f"_m_{k}"), F.stddev_samp("discount_pct").alias(f"_s_{k}"))
        d = d.join(maybe_broadcast(g, materialize=True), k, "left")
        sd = F.when(F.col(f"_s_{k}").isNull() | (F.col(f"_s_{k}") == 0), F.lit(1.0)).otherwise(F.col(f"_s_{k}"))
        d = d.withColumn(f"discount_pct_z_{k}", (F.col("discount_pct") - F.col(f"_m_{k}")) / sd)
    return d.select(*K, "discount_pct_z_channel", "discount_pct_z_region")


@register("model_io")
def q_model_io(spark, sf_dir):
    """The three models, feature list, scaling and training range as one state version, opened again for scoring:
    predictions of the saved and of the loaded models must agree."""
    import uuid

    from tillcast.operators.reports import feature_bounds
    from tillcast.plans.features import FEATURES
    from tillcast.plans.q_models import feature_table, median_model, spread_model
    from tillcast.session import shared_folder
    from tillcast.sources.state import read_state, write_state
    ft = feature_table(spark, sf_dir)
    median, spread = median_model(spark, sf_dir), spread_model(spark, sf_dir)
    train = ft.where("is_test = 0")
    span = train.agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b"), F.avg("target_log_ratio").alias("m"),
                     F.stddev_samp("target_log_ratio").alias("s")).first()
    root = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    write_state(spark, root, {"bounds": feature_bounds(train, FEATURES[:4])}, {"median": median, "lower": spread, "upper": spread},
                {"features": FEATURES, "train_from": span["a"], "train_to": span["b"], "target_mean": span["m"], "target_std": span["s"]})
    state = read_state(spark, root)
    state.verify()

    def scored(models, columns, suffix):
        out = ft.select(*K, *columns)
        for name, m in models.items():
            out = m.transform(out).withColumnRenamed("prediction", f"{name}_{suffix}").drop("features")
        return out.select(*K, F.col(f"median_{suffix}").alias(f"prediction_{suffix}"), f"lower_{suffix}", f"upper_{suffix}")

    saved = scored({"median": median, "lower": spread, "upper": spread}, FEATURES, "saved")
    loaded = scored({name: state.model(name) for name in state.models}, state.settings["features"], "loaded")
    return saved.join(loaded, K)


@register("iterative_prune")
def q_iterative_prune(spark, sf_dir):
    """≤ 10 rounds: correlation groups (PCA keep) → forest → squared correlation of fit → drop the weakest 10 %."""
    from tillcast.models import forest as FO
    from tillcast.operators import selection as SEL
    from tillcast.plans.features import FEATURES
    from tillcast.plans.q_models import LABEL, feature_table
    ft = feature_table(spark, sf_dir).where(F.col(LABEL).isNotNull())
    current = list(FEATURES)
    rows = []
    best = (-1.0, None)
    for i in range(10):
        grp = SEL.corr_groups_pca(ft, current).where("keep = 1").select("feature").collect()
        current = [f for f in current if f in {r["feature"] for r in grp}]
        model = FO.forest(current, LABEL, None, depth=6, n_trees=20).fit(ft)
        score = model.transform(ft).agg(F.pow(F.corr(LABEL, "prediction"), 2.0)).first()[0] or 0.0
        rows.append((i, len(current), float(score), list(current)))
        if score > best[0]:
            best = (score, list(current))
        if len(current) <= 10:
            break
        imp = sorted(zip(current, model.stages[-1].featureImportances.toArray()), key=lambda t: (t[1], t[0]))
        drop = {f for f, _ in imp[:max(1, len(current) // 10)]}
        current = [f for f in current if f not in drop]
    out = spark.createDataFrame(rows, "iteration int, n_features int, r2 double, features array<string>")
    return out.withColumn("is_best", (F.col("r2") == F.lit(best[0])).cast("int"))


# Inventory keys whose operator is registered under a more specific key -----------------------
ALIASES = {
    "discount_pct": "disc_perc",
    "column_profile": "column_profile_numeric",
    "geo_profile": "geo_profile_city",
    "qcut": "qcut_area",
}
for alias, target in ALIASES.items():
    q = REGISTRY[target]
    REGISTRY[alias] = Query(alias, q.build, q.sql, q.dbl)
