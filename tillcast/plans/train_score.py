"""Training and scoring as compositions of the operators: ``train`` writes one version of the state, ``score`` reads it.

``score`` takes a table of requests (store, date, discount_pct) against the sales history.  Its features are those of
the training table as of the request: exact-date lags and statistics of the rows before it, saved encodings and
bucket edges, averages with their fallback levels.  The chain after the model follows one order: invert, fall back,
bands from the spread, rules, conformal widening, ordering, floor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.columns import bucket_right_closed, clip, safe_div, xavg
from tillcast.models import forest as FO
from tillcast.models import trees as TR
from tillcast.operators import intervals as I
from tillcast.operators import lookups as L
from tillcast.operators import reports as R
from tillcast.operators import selection as SEL
from tillcast.operators import splits as S
from tillcast.operators import transforms as T
from tillcast.operators import weights as WT
from tillcast.operators import windows as W
from tillcast.operators.calendar import calendar_parts, cyclic_1, cyclic_23
from tillcast.operators.encoding import kbins_fit
from tillcast.operators.joins import join_store, maybe_broadcast
from tillcast.plans.features import FEATURES, KEPT, build_feature_table
from tillcast.session import written
from tillcast.sources.state import State, read_state, write_state

K = ["store", "date"]
LABEL = "target_log_ratio"
LAGS = [f"revenue_lag_{n}" for n in L.LAG_DAYS]
ENCODED = ("city", "region", "channel")
IMPORTANCE = 0.005


# ---- training --------------------------------------------------------------------------------------------
def prune(train: DataFrame, features, label: str, weight: str, trees: int, keep=T.ANCHORS) -> list[str]:
    """Features left after variance, VIF and the importance of a first forest; the anchors always stay."""
    features = list(features)
    varied = {r["feature"] for r in SEL.near_zero_variance(train, features).where("keep = 1").collect()}
    left = [f for f in features if f in varied or f in keep]
    dropped = {r["feature"] for r in SEL.remove_high_vif(train, left).where("removed_at_step IS NOT NULL").collect()}
    left = [f for f in left if f not in dropped or f in keep]
    first = FO.fit_median(train, left, label, weight, FO.DEPTH_FIRST, trees)
    important = {r["feature"] for r in FO.importances(first, left).where(F.col("importance") >= IMPORTANCE).collect()}
    return [f for f in left if f in important or f in keep]


def model_bands(df: DataFrame, median, spread) -> DataFrame:
    """``df`` with the inverted prediction ``model`` and the band of median ∓ spread around it (p10, p50, p90)."""
    out = median.transform(df).withColumnRenamed("prediction", "_m").drop("features")
    out = spread.transform(out).withColumnRenamed("prediction", "_s").drop("features")
    out = out.withColumn("_lo", F.col("_m") - F.col("_s")).withColumn("_hi", F.col("_m") + F.col("_s"))
    for src, dst in (("_lo", "p10"), ("_m", "p50"), ("_hi", "p90")):
        out = T.inverse_target(out, src, out=dst)
    return out.withColumn("model", F.col("p50")).drop("_m", "_s", "_lo", "_hi")


def train(history: DataFrame, stores: DataFrame, festivals: DataFrame, root: str, trees: int = FO.N_TREES,
          min_activity: float = 100.0) -> tuple[int, DataFrame]:
    """Clean → features → prune → median forest → spread forest → conformal fit → metrics → one state version.

    ``history``: store-days (store, date, qty_sold, revenue, disc_value).  Returns the version's number and
    (side, metric, value) on the training and the test side."""
    spark = history.sparkSession
    ft = build_feature_table(history, stores, festivals, history.count()).transform(lambda d: T.low_activity(d, min_activity)).transform(T.drop_leverage)
    ft = S.train_test_split(WT.weights_decay(ft)).select(*dict.fromkeys([*KEPT, *FEATURES]), "weight_x_n", "is_test")
    ft = written(ft, "training")
    side = ft.where("is_test = 0").where(F.col(LABEL).isNotNull())
    features = prune(side, FEATURES, LABEL, "weight_x_n", trees)
    median = FO.fit_median(side, features, LABEL, "weight_x_n", FO.DEPTH_FINAL, trees)
    spread = FO.fit_spread(median.transform(side), features)
    bands = written(I.band_sort(model_bands(ft, median, spread)).select(*K, "is_test", "revenue", "p10", "p50", "p90"), "bands")
    conformal = I.conformal_fit(bands.where("is_test = 0"))
    metrics = None
    for name, flag in (("train", 0), ("test", 1)):
        part = bands.where(F.col("is_test") == flag)
        m = I.forecast_metrics(part).crossJoin(F.broadcast(I.r2(part).select("r2")))
        m = m.unpivot([], m.columns, "metric", "value").select(F.lit(name).alias("side"), "metric", F.col("value").cast("double").alias("value"))
        metrics = m if metrics is None else metrics.unionByName(m)
    metrics = written(metrics, "metrics")
    encodings = R.target_encoding_tables(join_store(history, stores), ENCODED).select("_kind", "_cat", "_enc")
    span = history.agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b")).first()
    tables = {"encodings": encodings, "area_edges": kbins_fit(join_store(history, stores)), "bounds": R.feature_bounds(side, features),
              "conformal": conformal, "metrics": metrics, "importances": FO.importances(median, features)}
    version = write_state(spark, root, tables, {"median": median, "spread": spread}, {"features": features, "train_from": span["a"], "train_to": span["b"]})
    return version, metrics


# ---- scoring ---------------------------------------------------------------------------------------------
def request_features(requests: DataFrame, history: DataFrame, stores: DataFrame, festivals: DataFrame, state: State) -> DataFrame:
    """``requests`` (store, date, discount_pct) with every training feature as of the request's date.

    History rows on or after a request's date are never looked at by its lags and tail statistics."""
    r = join_store(requests, stores).transform(calendar_parts).transform(cyclic_1).transform(cyclic_23)
    r = r.withColumn("discount_pct", clip(F.coalesce(F.nanvl("discount_pct", F.lit(0.0)), F.lit(0.0)), 0.0, 1.0))
    r = r.withColumns({"is_discounted": (F.col("discount_pct") > 0).cast("int"), "discount_pct_squared": F.col("discount_pct") * F.col("discount_pct")})
    enc = state.table("encodings")
    for k in ENCODED:
        e = enc.where(F.col("_kind") == k).select(F.col("_cat").alias(k), F.col("_enc").alias(f"{k}_encoded"))
        r = r.join(maybe_broadcast(e), k, "left").withColumn(f"{k}_encoded", F.coalesce(f"{k}_encoded", F.lit(0.0)))
    r = r.crossJoin(F.broadcast(state.table("area_edges"))).withColumn("store_area_bucket", bucket_right_closed(F.col("store_area"), F.col("edges"))).drop("edges")

    h = W.promo_recency(history).select(*K, "revenue", F.col("days_since_last_promo").cast("double").alias("since"))
    stats = {f"revenue_rolling_{kind}_{w}d": ("revenue", f(w)) for w in (3, 7, 14, 30) for kind, f in (("mean", L._tail_mean), ("std", L._tail_std))}
    stats["revenue_std"] = ("revenue", lambda c, wh: F.stddev_samp(c).over(wh.rowsBetween(W.Window.unboundedPreceding, 0)))
    stats["_since"] = ("since", lambda c, wh: c)
    r = L.asof_tail(r, h, stats)
    r = r.withColumns({"revenue_last_3_days": F.col("revenue_rolling_mean_3d"), "revenue_volatility_3d": safe_div(F.col("revenue_rolling_std_3d"), F.col("revenue_rolling_mean_3d")),
                       "days_since_last_promo": F.when(F.col("discount_pct") > 0, 0.0).otherwise(F.coalesce(F.col("_since") + 1.0, F.lit(0.0)))}).drop("_since")
    r = L.avg_fallback(L.lag_exact_date(r, history), history).drop("store_month_avg_level", "store_dayofweek_avg_level")
    r = r.withColumn("store_weekday_avg", F.col("store_dayofweek_avg"))
    r = r.crossJoin(F.broadcast(history.agg(xavg("revenue").alias("_global_mean"))))
    r = L.lag_fallback(r, LAGS)
    r = L.no_history(r, history, [*LAGS, *[f"revenue_rolling_mean_{w}d" for w in (3, 7, 14, 30)], "revenue_last_3_days"])
    r = W.lead_time_scoring(r, history)
    r = L.days_to_festival(L.is_festival(r, festivals), festivals)
    return T.interactions(r)


def score(requests: DataFrame, history: DataFrame, stores: DataFrame, festivals: DataFrame, root: str, version: int | None = None,
          low: float = 1000.0, top_k: int = 5) -> DataFrame:
    """(store, date, discount_pct, p10, p50, p90, model, fallback_triggered, top_features) of every request.

    p10 <= p50 <= p90 are never null.  Unseen stores and requests without any history score by the fallbacks;
    repeated requests are scored each; other columns of the requests are ignored."""
    spark = requests.sparkSession
    state = read_state(spark, root, version)
    features = state.settings["features"]
    median, spread = state.model("median"), state.model("spread")
    r = requests.select(F.col("store").cast("string").alias("store"), F.col("date").cast("date").alias("date"), F.col("discount_pct").cast("double").alias("discount_pct"))
    r = written(r.withColumn("request", F.monotonically_increasing_id()), "requests")
    x = L.yoy_fallback(request_features(r, history, stores, festivals, state), history)
    x = x.withColumn("_sparse", I.sparse_input(features))
    x = written(T.clip_train_range(T.clean_matrix(x, features), state.table("bounds"), features), "request-features")

    # model, fallbacks, bands around what is left of the prediction
    b = model_bands(x, median, spread)
    b = b.withColumns({"_down": F.greatest(F.col("p50") - F.col("p10"), F.lit(0.0)), "_up": F.greatest(F.col("p90") - F.col("p50"), F.lit(0.0)),
                       "_fallback": F.greatest("store_dayofweek_avg", "store_month_avg")})
    b = I.model_vs_fallback(b, "model", "_fallback")
    b = b.withColumn("p50", F.when(F.col("_sparse"), F.col("yoy_fallback")).otherwise(F.col("p50")))
    b = I.fallback_invalid(b, low=low).withColumn("fallback_triggered", F.greatest("fallback_triggered", F.col("_sparse").cast("int")))
    b = b.withColumn("p50", F.coalesce("p50", "_fallback", "yoy_fallback", F.lit(0.0)))
    b = b.withColumns({"p10": F.col("p50") - F.col("_down"), "p90": F.col("p50") + F.col("_up")})

    # rules, in their order
    b = I.p10_floor_weekday(b, history)
    month = history.groupBy("store", F.month("date").alias("month")).agg(
        F.percentile("revenue", 0.5).alias("store_month_revenue_median"), F.stddev_samp("revenue").alias("store_month_revenue_std"))  # <= 31 rows a year and store
    b = b.join(month, ["store", "month"], "left").withColumns({"store_seasonal_index": F.lit(None).cast("double"), "premium_location_discount": F.lit(0.0)})
    b = I.min_history(I.band_rules(b), history)
    b = I.conformal_apply(b, state.table("conformal"))
    b = I.final_floor(I.band_sort(b))
    shap = TR.attribution(x, median.stages[-1], features, keys=("request",), top_k=top_k).select("request", "top_features")
    return b.join(shap, "request").select(*K, "discount_pct", "p10", "p50", "p90", "model", "fallback_triggered", "top_features")
