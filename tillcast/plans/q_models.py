"""Model-backed operators (§2.9 selection, §2.10 models, clustering, attribution).

These fit Spark ML estimators, so their results are checked by invariant
tests rather than a SQL oracle (rows-only in the driver).  Fitted models are
kept per (sf_dir, spec) in this process so that queries sharing a model do
not refit it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.models import calibration as CAL
from tillcast.models import clustering as CL
from tillcast.models import forest as FO
from tillcast.models import selection_fits as SF
from tillcast.models import stacking as ST
from tillcast.models import trees as TR
from tillcast.models.permutation import permutation_importance
from tillcast.operators import intervals as I
from tillcast.operators import selection as SEL
from tillcast.operators import splits as S
from tillcast.operators import transforms as T
from tillcast.operators import weights as WT
from tillcast.operators.joins import maybe_broadcast
from tillcast.plans import base
from tillcast.plans import train_score as TS
from tillcast.plans.features import CATALOGUE, FEATURES, KEPT, build_feature_table
from tillcast.plans.q_intervals import PP_SQL, pp
from tillcast.plans.registry import register
from tillcast.plans.sqlbase import sql
from tillcast.session import written
from tillcast.sources.festivals import festivals

K = ["store", "date"]
LABEL = "target_log_ratio"
_CACHE: dict = {}


def feature_table(spark, sf_dir):
    """The feature table, materialised once per input into the shared checkpoint folder.

    ~40 window / join features make a long lineage; models, selection jobs
    and mixtures iterate over it many times, so it is written once as Parquet
    (which also survives losing the executors that computed it) and every
    consumer reads the columns it needs."""
    def build():
        sales = written(base.sales(spark, sf_dir), "sales")  # the plan reads it several times: rolled up once
        ft = build_feature_table(sales, base.stores(spark, sf_dir), festivals(spark), sales.count())
        ft = S.train_test_split(WT.weights_decay(ft))
        return written(ft.select(*dict.fromkeys([*KEPT, *FEATURES]), "weight_x_n", "is_test"), "features")
    return _cached((sf_dir, "features"), build)


def _cached(key, fn):
    """Per-application cache of fitted models and written tables (a new session never sees a dead one's).

    ``key`` starts with the input folder; a changed input is read, fitted and written anew."""
    from tillcast.session import active_spark

    spark = active_spark()
    key = (spark.sparkContext.applicationId, base.version(spark, key[0]), *key)
    if key not in _CACHE:
        _CACHE[key] = fn()
    return _CACHE[key]


def median_model(spark, sf_dir, depth=FO.DEPTH_FINAL):
    def fit():
        ft = feature_table(spark, sf_dir)
        return FO.fit_median(ft.where("is_test = 0"), FEATURES, LABEL, "weight_x_n", depth)
    return _cached((sf_dir, "median", depth), fit)


@register("forest_median")
def q_forest_median(spark, sf_dir):
    """Weighted forest on the log revenue ratio; prediction and inverse-transformed revenue for every row."""
    m = median_model(spark, sf_dir)
    p = m.transform(feature_table(spark, sf_dir))
    p = T.inverse_target(p, "prediction")
    return p.select(*K, "is_test", "revenue", LABEL, "prediction", "revenue_pred")


@register("model_r2")
def q_model_r2(spark, sf_dir):
    """R² of the median model on the train and the test side (log-ratio space)."""
    m = median_model(spark, sf_dir)
    p = m.transform(feature_table(spark, sf_dir)).where(F.col(LABEL).isNotNull())
    mean = p.groupBy("is_test").agg(F.avg(LABEL).alias("_m"))
    j = p.join(F.broadcast(mean), "is_test")
    return j.groupBy("is_test").agg((F.lit(1.0) - F.sum(F.pow(F.col(LABEL) - F.col("prediction"), 2.0))
                                     / F.sum(F.pow(F.col(LABEL) - F.col("_m"), 2.0))).alias("r2"),
                                    F.count(F.lit(1)).alias("n"))


def spread_model(spark, sf_dir):
    def fit():
        m = median_model(spark, sf_dir)
        pred = m.transform(feature_table(spark, sf_dir).where("is_test = 0"))
        return FO.fit_spread(pred, FEATURES)
    return _cached((sf_dir, "spread"), fit)


@register("forest_spread")
def q_forest_spread(spark, sf_dir):
    """p10 / p50 / p90 = inverse(median ∓ spread) with one spread forest for both bands (D6)."""
    m = median_model(spark, sf_dir)
    s = spread_model(spark, sf_dir)
    p = m.transform(feature_table(spark, sf_dir)).withColumnRenamed("prediction", "median").drop("features")
    p = s.transform(p).withColumnRenamed("prediction", "spread")
    p = p.withColumn("lo", F.col("median") - F.col("spread")).withColumn("hi", F.col("median") + F.col("spread"))
    for src, dst in (("lo", "p10"), ("median", "p50"), ("hi", "p90")):
        p = T.inverse_target(p, src, out=dst)
    return I.band_sort(p).select(*K, "revenue", "p10", "p50", "p90")


@register("quantile_stack")
def q_quantile_stack(spark, sf_dir):
    """Cross-fitted quantile forests and boosted medians per store fold, a linear quantile model on top for each band."""
    ft = feature_table(spark, sf_dir)
    stack = _cached((sf_dir, "stack"), lambda: ST.fit_stack(ft.where("is_test = 0"), FEATURES, LABEL, "weight_x_n"))
    out = stack.predict(ft, F.col("is_test") == 0)
    return I.band_sort(out.select(*K, "is_test", LABEL, F.col("m10").alias("p10"), F.col("m50").alias("p50"), F.col("m90").alias("p90")))


def attribution_table(spark, sf_dir):
    """SHAP table, written once (the selection operators all aggregate it)."""
    def run():
        m = median_model(spark, sf_dir, depth=FO.DEPTH_FIRST)
        ft = feature_table(spark, sf_dir)
        return written(TR.attribution(ft, m.stages[-1], FEATURES), "attribution")
    return _cached((sf_dir, "attribution"), run)


@register("attribution")
def q_attribution(spark, sf_dir):
    """Exact Tree SHAP of the depth-8 median forest per store-day, base value, prediction, top-5 features."""
    return attribution_table(spark, sf_dir)


@register("top_features")
def q_top_features(spark, sf_dir):
    """Top-5 features by forest importance and by mean |SHAP|."""
    from tillcast.operators.topk import top_features
    m = median_model(spark, sf_dir)
    imp = top_features(FO.importances(m, FEATURES)).withColumn("source", F.lit("importance"))
    sh = SEL.mean_abs_attribution(attribution_table(spark, sf_dir), FEATURES).select(
        "feature", F.col("mean_abs_shap").alias("importance"))
    sh = top_features(sh).withColumn("source", F.lit("mean_abs_shap"))
    return imp.unionByName(sh)


@register("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    m = median_model(spark, sf_dir, depth=FO.DEPTH_FIRST)
    ft = feature_table(spark, sf_dir).where(F.col(LABEL).isNotNull())
    return permutation_importance(m, ft, FEATURES, LABEL)


SEL_FEATURES = FEATURES


@register("near_zero_variance")
def q_near_zero_variance(spark, sf_dir):
    return SEL.near_zero_variance(feature_table(spark, sf_dir), SEL_FEATURES)


@register("vif")
def q_vif(spark, sf_dir):
    return SEL.vif(feature_table(spark, sf_dir), SEL_FEATURES)


@register("remove_high_vif")
def q_remove_high_vif(spark, sf_dir):
    return SEL.remove_high_vif(feature_table(spark, sf_dir), SEL_FEATURES)


@register("vif_grouped")
def q_vif_grouped(spark, sf_dir):
    """VIF of the features and the one-hot columns of region and channel; each one-hot group keeps a member."""
    st = base.stores(spark, sf_dir).select(F.col("id").alias("store"), "region", "channel")
    hot = {f"{c}_{v}": F.col(c) == v for c in ("region", "channel") for v in sorted(r[0] for r in st.select(c).where(F.col(c).isNotNull()).distinct().collect())}
    onehot = st.select("store", *[F.coalesce(e, F.lit(False)).cast("double").alias(n) for n, e in hot.items()])
    ft = feature_table(spark, sf_dir).select("store", *SEL_FEATURES).join(maybe_broadcast(onehot), "store")
    return SEL.vif_grouped(ft, [*SEL_FEATURES, *hot])


@register("drop_correlated")
def q_drop_correlated(spark, sf_dir):
    return SEL.drop_correlated(feature_table(spark, sf_dir), SEL_FEATURES)


@register("corr_groups_pca")
def q_corr_groups_pca(spark, sf_dir):
    return SEL.corr_groups_pca(feature_table(spark, sf_dir), SEL_FEATURES)


@register("low_importance")
def q_low_importance(spark, sf_dir):
    m = median_model(spark, sf_dir)
    return SEL.low_importance(FO.importances(m, FEATURES), 0.005, always_keep=list(T.ANCHORS))


@register("importance_95")
def q_importance_95(spark, sf_dir):
    m = median_model(spark, sf_dir)
    return SEL.importance_95(FO.importances(m, FEATURES))


@register("prune")
def q_prune(spark, sf_dir):
    """Variance → VIF → importance, with the step at which each feature left.  A step only sees what the one before left."""
    ft = feature_table(spark, sf_dir)
    nzv = {r["feature"]: r["keep"] for r in SEL.near_zero_variance(ft, SEL_FEATURES).collect()}
    after_var = [f for f in SEL_FEATURES if nzv[f]]
    vifr = {r["feature"]: r["removed_at_step"] for r in SEL.remove_high_vif(ft, after_var).collect()}
    after_vif = [f for f in after_var if vifr[f] is None]
    m = _cached((sf_dir, "pruned", *after_vif), lambda: FO.fit_median(ft.where("is_test = 0"), after_vif, LABEL, "weight_x_n"))
    imp = {r["feature"]: r["importance"] for r in FO.importances(m, after_vif).collect()}
    rows = []
    for f in SEL_FEATURES:
        step = "variance" if not nzv[f] else "vif" if f not in after_vif else ("importance" if imp[f] < 0.005 else None)
        rows.append((f, step))
    return spark.createDataFrame(rows, "feature string, removed_by string")


@register("shap_drop")
def q_shap_drop(spark, sf_dir):
    return SEL.shap_drop(attribution_table(spark, sf_dir), FEATURES)


@register("shap_stability")
def q_shap_stability(spark, sf_dir):
    """A forest per store fold, explained on its training stores; stability of mean |SHAP| across the folds."""
    ft = feature_table(spark, sf_dir)
    per = _cached((sf_dir, "fold-shap"), lambda: SF.attribution_by_fold(ft, FEATURES, LABEL))
    return SEL.shap_stability(per)


def cluster_attribution(spark, sf_dir):
    def fit():
        cl = base.stores(spark, sf_dir).select(F.col("id").alias("store"), "store_cluster")
        ft = feature_table(spark, sf_dir).drop("store_cluster").join(maybe_broadcast(cl), "store")
        return SF.attribution_by_cluster(written(ft.select(*K, "store_cluster", LABEL, *FEATURES), "clustered"), FEATURES, LABEL)
    return _cached((sf_dir, "cluster-shap"), fit)


@register("shap_by_cluster")
def q_shap_by_cluster(spark, sf_dir):
    """A forest per cluster, explained on the cluster's rows; the cluster's 20 largest features are selected."""
    return cluster_attribution(spark, sf_dir)


@register("common_features")
def q_common_features(spark, sf_dir):
    """Features that at least two clusters select."""
    sh = cluster_attribution(spark, sf_dir).where("selected = 1")
    return SEL.common_features(sh.select(F.col("store_cluster").alias("cluster"), "feature"))


@register("leakage_audit")
def q_leakage_audit(spark, sf_dir):
    sh = SEL.mean_abs_attribution(attribution_table(spark, sf_dir), FEATURES)
    return SEL.leakage_audit(sh.select("feature", F.col("mean_abs_shap").alias("score")), catalogue=CATALOGUE)


@register("feature_catalogue")
def q_feature_catalogue(spark, sf_dir):
    """Which features use the current or future rows (D12); read by the leakage audit."""
    ft = feature_table(spark, sf_dir)
    present = set(ft.columns)
    rows = [(f, int(c), int(fu), int(f in present)) for f, (c, fu) in CATALOGUE.items()]
    return spark.createDataFrame(rows, "feature string, uses_current int, uses_future int, in_table int")


@register("orthogonalize")
def q_orthogonalize(spark, sf_dir):
    ft = feature_table(spark, sf_dir)
    regs = ["store_area_bucket", "discount_pct", "month", "is_online", "day_of_week"]
    out = ft
    for f in ("store_area", "revenue_rolling_mean_7d", "revenue_rolling_std_7d"):
        out = SEL.orthogonalize(out, f, regs)
    return out.select(*K, "store_area_orthogonal", "revenue_rolling_mean_7d_orthogonal", "revenue_rolling_std_7d_orthogonal")


# clustering -------------------------------------------------------------------

def store_profile(spark, sf_dir):
    return _cached((sf_dir, "profile"), lambda: written(CL.store_profile(base.daily(spark, sf_dir)), "profile"))


def cluster_fit(spark, sf_dir):
    return _cached((sf_dir, "clusters"), lambda: CL.fit_clusters(store_profile(spark, sf_dir)))


@register("cluster_scale_pca")
def q_cluster_scale_pca(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    pcs, _, _, _, _ = cluster_fit(spark, sf_dir)
    return pcs.select("store", vector_to_array("pcs").alias("components"))


@register("cluster_choose_k")
def q_cluster_choose_k(spark, sf_dir):
    _, _, _, k, bics = cluster_fit(spark, sf_dir)
    return spark.createDataFrame([(kk, float(b), int(kk == k)) for kk, b in bics], "k int, bic double, chosen int")


@register("cluster_gmm")
def q_cluster_gmm(spark, sf_dir):
    pcs, _, gm, k, _ = cluster_fit(spark, sf_dir)
    return CL.label(gm.transform(pcs), k).select("store", "cluster_index", "store_cluster", "probabilities")


@register("cluster_score")
def q_cluster_score(spark, sf_dir):
    """model_io round trip: save the PCA and mixture into the checkpoint folder, load, score the stores."""
    import os
    import uuid

    from pyspark.ml.clustering import GaussianMixtureModel
    from pyspark.ml.feature import PCAModel, VectorAssembler

    from tillcast.session import ensure_checkpoint_dir
    pcs, pca, gm, k, _ = cluster_fit(spark, sf_dir)
    root = os.path.join(ensure_checkpoint_dir(spark), f"clusters-{uuid.uuid4().hex}")
    pca.write().overwrite().save(f"{root}/pca")
    gm.write().overwrite().save(f"{root}/gmm")
    pca2, gm2 = PCAModel.load(f"{root}/pca"), GaussianMixtureModel.load(f"{root}/gmm")
    prof = store_profile(spark, sf_dir)
    cols = CL.profile_columns(prof)
    z = VectorAssembler(inputCols=cols, outputCol="z").transform(CL.standardise(prof, cols))
    return CL.label(gm2.transform(pca2.transform(z)), k).select("store", "cluster_index", "store_cluster", "probabilities")


@register("cluster_noise")
def q_cluster_noise(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    _, pca, gm, k, _ = cluster_fit(spark, sf_dir)
    prof = store_profile(spark, sf_dir)
    cols = CL.profile_columns(prof)
    z = CL.standardise(prof, cols)
    noisy = CL.add_noise(z, cols)
    v = VectorAssembler(inputCols=cols, outputCol="z").transform(noisy)
    out = CL.label(gm.transform(pca.transform(v)), k)
    return out.select("store", F.col("probabilities").alias("probabilities_noisy"), "store_cluster")


# Equal-weight isotonic regression by its min-max formula: the largest over starts of the smallest mean over ends.
CALIBRATE_SQL = sql(f"""{PP_SQL}
, raw AS (SELECT store, date, store_cluster, revenue, p50, p90 - p50 AS unc, p50 - {I.Z90} * (p90 - p50) AS lo, p50 + {I.Z90} * (p90 - p50) AS hi FROM pp)
, pos AS (SELECT store_cluster, CASE WHEN revenue >= lo AND revenue <= hi THEN (revenue - lo) / (hi - lo) WHEN revenue < lo THEN 0.0 ELSE 1.0 END AS position FROM raw)
, agg AS (SELECT store_cluster, CAST(floor(position * 99) AS INTEGER) AS bin, avg(position) AS mp FROM pos WHERE position < 1.0 GROUP BY 1, 2)
, bins AS (SELECT c.store_cluster, b.bin, (b.bin + 0.5) / 99.0 AS x, COALESCE(agg.mp, (b.bin + 0.5) / 99.0) AS y
           FROM (SELECT DISTINCT store_cluster FROM pos WHERE store_cluster IS NOT NULL) c CROSS JOIN (SELECT range AS bin FROM range(0, 99)) b
           LEFT JOIN agg ON agg.store_cluster = c.store_cluster AND agg.bin = b.bin)
, upto AS (SELECT *, sum(y) OVER (PARTITION BY store_cluster ORDER BY bin) AS s FROM bins)
, means AS (SELECT a.store_cluster, a.bin AS a, b.bin AS b, (b.s - a.s + a.y) / (b.bin - a.bin + 1) AS m
            FROM upto a JOIN upto b ON a.store_cluster = b.store_cluster AND a.bin <= b.bin)
, least_ AS (SELECT m.store_cluster, m.a, i.bin AS i, min(m.m) AS m FROM means m JOIN bins i ON i.store_cluster = m.store_cluster AND m.a <= i.bin AND m.b >= i.bin
             GROUP BY m.store_cluster, m.a, i.bin)
, iso AS (SELECT store_cluster, i AS bin, (i + 0.5) / 99.0 AS x, max(m) AS y FROM least_ GROUP BY store_cluster, i)
, ranked AS (SELECT *, percent_rank() OVER (PARTITION BY store_cluster ORDER BY p50, store, date) AS r FROM raw)
, cut AS (SELECT ranked.*, LEAST(GREATEST(CAST(floor(r * 99.0 - 0.5) AS INTEGER), 0), 97) AS b FROM ranked)
, cal AS (SELECT cut.*, CASE WHEN r <= i.x THEN i.y WHEN r >= j.x THEN j.y ELSE i.y + (j.y - i.y) * (r - i.x) / (j.x - i.x) END AS cp
          FROM cut LEFT JOIN iso i ON i.store_cluster = cut.store_cluster AND i.bin = cut.b LEFT JOIN iso j ON j.store_cluster = cut.store_cluster AND j.bin = cut.b + 1)
, st AS (SELECT store_cluster, avg(unc) AS mean_uncertainty, avg(CASE WHEN revenue >= lo AND revenue <= hi THEN 1.0 ELSE 0.0 END) AS coverage_rate FROM raw GROUP BY store_cluster)
SELECT cal.store, cal.date, cal.store_cluster, CASE WHEN cp IS NULL THEN lo ELSE p50 - cp * (hi - lo) END AS p10, p50,
       CASE WHEN cp IS NULL THEN hi ELSE p50 + (1.0 - cp) * (hi - lo) END AS p90, cp AS calibrated_position, coverage_rate, mean_uncertainty
FROM cal LEFT JOIN st ON st.store_cluster = cal.store_cluster""")


@register("cluster_calibrate", CALIBRATE_SQL, dbl="p10 p50 p90 calibrated_position coverage_rate mean_uncertainty")
def q_cluster_calibrate(spark, sf_dir):
    """Isotonic position maps per cluster fitted on the history's bands, applied to the normal band."""
    d = written(pp(spark, sf_dir).withColumn("uncertainty", F.col("p90") - F.col("p50")), "bands")
    raw = I.normal_band(d)
    cal = CAL.apply(d, CAL.fit(I.binned_position(I.band_position(raw))))
    stats = CAL.cluster_stats(raw)
    return cal.join(maybe_broadcast(stats, materialize=True), "store_cluster", "left").select(
        *K, "store_cluster", "p10", "p50", "p90", "calibrated_position", "coverage_rate", "mean_uncertainty")


# training and scoring as a whole -------------------------------------------------

CUT = "2021-06-01"
MIN_ACTIVITY = 45000.0  # driver revenue scale


def trained(spark, sf_dir):
    """Root and metrics of a state trained on the history before ``CUT``."""
    import uuid

    from tillcast.session import shared_folder

    def run():
        root = f"{shared_folder(spark)}/trained-{uuid.uuid4().hex}"
        history = base.sales(spark, sf_dir).where(F.col("date") < CUT)
        version, metrics = TS.train(written(history, "history"), base.stores(spark, sf_dir), festivals(spark), root, min_activity=MIN_ACTIVITY)
        return root, version, metrics
    return _cached((sf_dir, "trained"), run)


@register("train")
def q_train(spark, sf_dir):
    """Metrics of the whole training on the history before the cut: clean, features, prune, fit, calibrate, persist."""
    return trained(spark, sf_dir)[2]


@register("score")
def q_score(spark, sf_dir):
    """Every store-day after the cut, with its planned discount, scored against the history before it."""
    from tillcast.operators.lookups import requests_from
    root, version, _ = trained(spark, sf_dir)
    history = written(base.sales(spark, sf_dir).where(F.col("date") < CUT), "history")
    requests = requests_from(base.daily(spark, sf_dir).where(F.col("date") >= CUT))
    return TS.score(requests, history, base.stores(spark, sf_dir), festivals(spark), root, version, low=MIN_ACTIVITY)
