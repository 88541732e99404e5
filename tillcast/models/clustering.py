"""Store clustering: standardise (population std), PCA to 95 % variance, Gaussian mixtures with a BIC elbow.

Inputs are per-store profiles (one row per store) derived from the daily
table by grouped aggregations; the fits are Spark ML estimators.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.operators import reports as R

# --- Fixed values: names of mixture components by index ---
CLUSTER_NAMES = ["SMALL_OFFLINE", "MEDIUM_OFFLINE", "LARGE_OFFLINE", "ONLINE", "PREMIUM_OFFLINE",
                 "SEASONAL_SPECIALIST", "HOLIDAY_SPECIALIST", "REGIONAL_LEADER"]
# -----------------------------------------------------------
SEED = 42
MAX_K = 10
VARIANCE_KEPT = 0.95
NOISE_LEVEL = 0.05


def store_profile(daily: DataFrame) -> DataFrame:
    """One row per store: area, online flag, season profile, season ratios, z-scored city / region profiles."""
    attrs = daily.groupBy("store").agg(F.first("store_area", ignorenulls=True).alias("store_area"),
                                       F.first("is_online", ignorenulls=True).alias("is_online"),
                                       F.first("city", ignorenulls=True).alias("city"),
                                       F.first("region", ignorenulls=True).alias("region"))
    prof = R.store_season_profile(R.store_month_stats(daily))
    ratios = R.season_ratios(daily)
    city = R.geo_profile(daily, "city")
    region = R.geo_profile(daily, "region")
    out = attrs.join(prof, "store", "left").join(ratios, "store", "left").join(city, "city", "left").join(region, "region", "left")
    return out.drop("city", "region").na.fill(0.0)


def profile_columns(profile: DataFrame):
    return [c for c in profile.columns if c != "store"]


def standardise(profile: DataFrame, cols) -> DataFrame:
    """(x − mean) / population std (std 0 → 1), statistics as a 1-row aggregate."""
    st = profile.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = profile.crossJoin(F.broadcast(st))
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in cols}
    return j.withColumns(z).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def scale_pca(profile: DataFrame, cols, kept: float = VARIANCE_KEPT):
    """Standardised profile → PCA keeping the smallest k that explains ``kept`` of the variance."""
    z = standardise(profile, cols)
    va = VectorAssembler(inputCols=list(cols), outputCol="z")
    zv = va.transform(z)
    full = PCA(k=len(cols), inputCol="z", outputCol="pcs").fit(zv)
    ev = full.explainedVariance.toArray()
    cum, k = 0.0, len(ev)
    for i, v in enumerate(ev):
        cum += v
        if cum >= kept - 1e-12:
            k = i + 1
            break
    pca = PCA(k=k, inputCol="z", outputCol="pcs").fit(zv)
    return pca.transform(zv), pca, k


def bic_table(data: DataFrame, d: int, k_values) -> list[tuple[int, float, GaussianMixtureModel]]:
    """(k, BIC, fitted mixture) for every k."""
    n = data.count()
    out = []
    for k in k_values:
        gm = GaussianMixture(featuresCol="pcs", k=k, seed=SEED, probabilityCol="prob").fit(data)
        ll = gm.summary.logLikelihood
        p = k * d + k * d * (d + 1) / 2 + (k - 1)
        out.append((k, -2.0 * ll + p * math.log(n), gm))
    return out


def choose_k(bics: list[tuple[int, float]], max_k: int = MAX_K) -> int:
    """Elbow: argmax of the second difference of BIC over k = 2.. (+2), clipped to [2, max_k]."""
    vals = [b for _, b in bics]
    if len(vals) <= 2:
        return 2
    second = [vals[i + 2] - 2 * vals[i + 1] + vals[i] for i in range(len(vals) - 2)]
    k = max(range(len(second)), key=lambda i: second[i]) + 2
    return max(2, min(k, max_k))


def fit_clusters(profile: DataFrame):
    from tillcast.session import cut_lineage

    cols = profile_columns(profile)
    pcs, pca, d = scale_pca(profile, cols)
    pcs = cut_lineage(pcs)  # the mixtures iterate over it; one row per store
    n = pcs.count()
    ks = list(range(2, min(MAX_K + 1, n)))
    fits = bic_table(pcs, d, ks)
    bics = [(k, b) for k, b, _ in fits]
    k = choose_k(bics)
    fitted = {j: g for j, _, g in fits}
    gm = fitted[k] if k in fitted else GaussianMixture(featuresCol="pcs", k=k, seed=SEED, probabilityCol="prob").fit(pcs)
    return pcs, pca, gm, k, bics


def label(scored: DataFrame, k: int) -> DataFrame:
    names = F.array(*[F.lit(n) for n in CLUSTER_NAMES[:k]])
    probs = vector_to_array("prob")
    idx = F.array_position(probs, F.array_max(probs)).cast("int")
    return scored.withColumn("probabilities", probs).withColumn("cluster_index", idx - 1).withColumn(
        "store_cluster", F.element_at(names, idx))


def add_noise(profile: DataFrame, cols, level: float = NOISE_LEVEL, seed: int = SEED) -> DataFrame:
    """x + N(0, level · population std of x), one seeded draw per value."""
    st = profile.agg(*[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = profile.crossJoin(F.broadcast(st))
    noisy = {c: F.col(c) + F.randn(seed + i) * F.lit(level) * F.col(f"_s_{c}") for i, c in enumerate(cols)}
    return j.withColumns(noisy).drop(*[f"_s_{c}" for c in cols])
