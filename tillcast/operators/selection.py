"""§2.9 feature selection as Spark jobs over the feature table.

Every matrix statistic (variances, correlations, covariances, normal
equations) is one pass producing k·(k+1)/2 sums; only the resulting
k×k matrix (model-sized: k = number of features) is handled on the driver,
where VIF, greedy removal and small eigen/least-squares solves run without
rescanning the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIF_LIMIT = 5.0
NZV_LIMIT = 0.01
CORR_DROP = 0.95
CORR_GROUP = 0.7


def _spark() -> SparkSession:
    from tillcast.session import active_spark

    return active_spark()


def near_zero_variance(df: DataFrame, cols, limit: float = NZV_LIMIT) -> DataFrame:
    """(feature, variance, keep): population variance per feature; kept when > limit."""
    row = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in cols])
    long = row.unpivot([], list(cols), "feature", "variance")
    return long.withColumn("keep", (F.col("variance") > limit).cast("int"))


def mean_filled(df: DataFrame, cols) -> DataFrame:
    """NULL, NaN and infinite values of ``cols`` → the column's mean over the others (0 without any)."""
    cols = list(cols)
    k = len(cols)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols])

    def sums(batches):
        n, total = np.zeros(k), np.zeros(k)
        for batch in batches:
            for i in range(k):
                v = batch.column(i).to_numpy(zero_copy_only=False)
                v = v[np.isfinite(v)]
                n[i] += len(v)
                total[i] += v.sum()
        yield pa.RecordBatch.from_arrays([pa.array([n.tolist()], pa.list_(pa.float64())), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "total"])

    n, total = np.zeros(k), np.zeros(k)
    for r in rows.mapInArrow(sums, "n array<double>, total array<double>").collect():  # one row a task
        n, total = n + r["n"], total + r["total"]
    means = np.divide(total, n, out=np.zeros(k), where=n > 0)

    def fill(batches):
        for batch in batches:
            values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(np.isfinite(v), v, m)) for v, m in zip(values, means)], cols)

    return rows.mapInArrow(fill, rows.schema)


def moments(df: DataFrame, cols) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and the population covariance matrix of ``cols`` (NULL and NaN count as 0).

    One pass: every task centres its batches and merges their k×k sums of products; the driver merges one such
    matrix per task (k·(k + 1) numbers, whatever the rows)."""
    cols = list(cols)
    k = len(cols)

    def merged(a, b):
        (n, mean, prod), (m, mean_b, prod_b) = a, b
        if not n or not m:
            return a if n else b
        d = mean_b - mean
        return n + m, mean + d * (m / (n + m)), prod + prod_b + np.outer(d, d) * (n * m / (n + m))

    def run(batches):
        total, origin = (0, np.zeros(k), np.zeros((k, k))), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
            x[np.isnan(x)] = 0.0
            origin = x[0].copy() if origin is None else origin  # a constant column becomes an exact 0
            with np.errstate(invalid="ignore"):
                x -= origin
                mean = x.mean(axis=0)
                x -= mean
                total = merged(total, (len(x), mean, x.T @ x))
        if total[0]:
            n, mean, prod = total
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean + origin], "prod": [prod.ravel()]}, schema=out)

    out = pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("prod", pa.list_(pa.float64()))])
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    total = (0, np.zeros(k), np.zeros((k, k)))
    for r in rows.mapInArrow(run, "n bigint, mean array<double>, prod array<double>").collect():
        total = merged(total, (r["n"], np.array(r["mean"]), np.array(r["prod"]).reshape(k, k)))
    n, mean, prod = total
    return mean, prod / max(n, 1), n


def correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    sd[sd < 1e-12] = 0.0  # a constant column, but for rounding
    with np.errstate(divide="ignore", invalid="ignore"):
        r = cov / np.outer(sd, sd)
    r[~np.isfinite(r)] = 0.0
    np.fill_diagonal(r, 1.0)
    return r


def vif_from_corr(r: np.ndarray) -> np.ndarray:
    """VIF_i = 1/(1 − R²_i) = diag(R⁻¹)_i; a singular block (R² = 1) gives inf."""
    k = r.shape[0]
    out = np.empty(k)
    for i in range(k):
        others = [j for j in range(k) if j != i]
        if not others:
            out[i] = 1.0
            continue
        a = r[np.ix_(others, others)]
        b = r[others, i]
        sol, *_ = np.linalg.lstsq(a, b, rcond=None)
        r2 = float(b @ sol)
        out[i] = np.inf if r2 >= 1 - 1e-12 else 1.0 / (1.0 - r2)
    return out


def vif(df: DataFrame, cols) -> DataFrame:
    _, cov, _ = moments(df, cols)
    v = vif_from_corr(correlation(cov))
    return _spark().createDataFrame([(c, float(x)) for c, x in zip(cols, v)], "feature string, vif double")


def remove_high_vif(df: DataFrame, cols, limit: float = VIF_LIMIT) -> DataFrame:
    """Drop the feature with the largest VIF until all are ≤ limit; (feature, step_removed or NULL).

    Missing and infinite values count as the column's mean."""
    _, cov, _ = moments(mean_filled(df, cols), cols)
    r = correlation(cov)
    keep = list(range(len(cols)))
    removed = {}
    step = 0
    while len(keep) > 1:
        v = vif_from_corr(r[np.ix_(keep, keep)])
        i = int(np.argmax(v))
        if v[i] <= limit:
            break
        removed[cols[keep[i]]] = step
        step += 1
        keep.pop(i)
    return _spark().createDataFrame([(c, removed.get(c)) for c in cols], "feature string, removed_at_step int")


def vif_grouped(df: DataFrame, cols, prefixes=("city_", "region_", "channel_"), limit: float = VIF_LIMIT) -> DataFrame:
    """One-pass removal of VIF > limit; each one-hot group keeps at least its most frequent member."""
    _, cov, n = moments(df, cols)
    mean = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    v = vif_from_corr(correlation(cov))
    drop = {c for c, x in zip(cols, v) if x > limit}
    for p in prefixes:
        members = [c for c in cols if c.startswith(p) and not c.endswith("_encoded")]  # the one-hot columns
        if members and all(m in drop for m in members):
            drop.discard(max(members, key=lambda m: (mean[m] or 0.0, m)))
    return _spark().createDataFrame([(c, float(x), int(c not in drop)) for c, x in zip(cols, v)],
                                    "feature string, vif double, keep int")


def drop_correlated(df: DataFrame, cols, limit: float = CORR_DROP) -> DataFrame:
    """Drop the later column of every pair with |r| > limit (one correlation-matrix aggregation)."""
    _, cov, _ = moments(df, cols)
    r = correlation(cov)
    k = len(cols)
    drop = {cols[j] for i in range(k) for j in range(i + 1, k) if abs(r[i, j]) > limit}
    return _spark().createDataFrame([(c, int(c in drop)) for c in cols], "feature string, dropped int")


def corr_groups_pca(df: DataFrame, cols, limit: float = CORR_GROUP, kept: float = 0.95) -> DataFrame:
    """Greedy groups of |r| > limit; groups larger than two keep the two members with the largest
    variance-weighted loading on the components explaining ``kept`` of the group's variance."""
    _, cov, _ = moments(df, cols)
    r = correlation(cov)
    left = list(range(len(cols)))
    keep = set()
    gid = {}
    g = 0
    while left:
        i = left.pop(0)
        grp = [i] + [j for j in left if abs(r[i, j]) > limit]
        left = [j for j in left if j not in grp]
        for j in grp:
            gid[cols[j]] = g
        if len(grp) <= 2:
            keep.update(grp)
        else:
            sub = cov[np.ix_(grp, grp)]
            w, vec = np.linalg.eigh(sub)
            order = np.argsort(w)[::-1]
            w, vec = w[order], vec[:, order]
            m = int(np.searchsorted(np.cumsum(w) / w.sum(), kept) + 1)
            score = np.abs(vec[:, :m]) @ w[:m]
            best = np.argsort(-score, kind="stable")[:2]
            keep.update(grp[b] for b in best)
        g += 1
    return _spark().createDataFrame([(c, gid[c], int(i in keep)) for i, c in enumerate(cols)],
                                    "feature string, group_id int, keep int")


def orthogonalize(df: DataFrame, target: str, regressors, out: str | None = None) -> DataFrame:
    """Residual of the centred ``target`` on [1, regressors] by least squares; singular → centred only.

    The normal equations are one aggregation (X'X and X'y sums); the (k+1)×(k+1) solve is on the driver;
    the projection is a column expression."""
    out = out or f"{target}_orthogonal"
    cols = [target] + list(regressors)
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    mean_t = filled.agg(F.avg(target)).first()[0]
    xs = [F.lit(1.0)] + [F.col(c) for c in regressors]
    yc = F.col(target) - F.lit(mean_t)
    k = len(xs)
    aggs = [F.sum(xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(xs[i] * yc).alias(f"b{i}") for i in range(k)]
    r = filled.agg(*aggs).first()
    A = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            A[i, j] = A[j, i] = r[f"a{i}_{j}"]
    b = np.array([r[f"b{i}"] for i in range(k)])
    try:
        if np.linalg.matrix_rank(A) < k:
            raise np.linalg.LinAlgError("singular")
        beta = np.linalg.solve(A, b)
    except np.linalg.LinAlgError:
        return filled.withColumn(out, yc)
    fit = sum((xs[i] * F.lit(float(beta[i])) for i in range(k)), F.lit(0.0))
    return filled.withColumn(out, yc - fit)


def importance_95(imp: DataFrame, share: float = 0.95, top_n: int | None = None, drop_prefix: str | None = None) -> DataFrame:
    """Smallest prefix (by importance, desc) reaching ``share`` of the total, or the top n; optionally
    drop features with a prefix (``trend_positive`` for the lower model, ``trend_negative`` for the upper)."""
    from pyspark.sql import Window

    d = imp.where(~F.col("feature").startswith(drop_prefix)) if drop_prefix else imp
    w = Window.orderBy(F.col("importance").desc(), "feature").rowsBetween(Window.unboundedPreceding, -1)
    tot = d.agg(F.sum("importance").alias("_t"))
    d = d.crossJoin(F.broadcast(tot)).withColumn("_before", F.coalesce(F.sum("importance").over(w), F.lit(0.0)))
    d = d.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))
    sel = (F.col("rank") <= top_n) if top_n else (F.col("_before") < F.col("_t") * share)
    return d.withColumn("selected", sel.cast("int")).drop("_t", "_before")


def low_importance(imp: DataFrame, threshold: float, always_keep=()) -> DataFrame:
    keep = (F.col("importance") >= threshold) | F.col("feature").isin(*always_keep) if always_keep else (F.col("importance") >= threshold)
    return imp.withColumn("keep", keep.cast("int"))


def mean_abs_attribution(att: DataFrame, features, by=()) -> DataFrame:
    """Mean |φ| per feature (and per ``by`` group) from the attribution table's SHAP arrays."""
    names = F.array(*[F.lit(f) for f in features])
    ex = att.select(*by, F.posexplode("shap").alias("i", "phi"))
    ex = ex.withColumn("feature", F.element_at(names, F.col("i") + 1))
    return ex.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"),
                                          F.stddev_samp(F.abs("phi")).alias("std_abs_shap"))


def shap_drop(att: DataFrame, features, share: float = 0.01) -> DataFrame:
    m = mean_abs_attribution(att, features)
    mx = m.agg(F.max("mean_abs_shap").alias("_mx"))
    return m.crossJoin(F.broadcast(mx)).withColumn("keep", (F.col("mean_abs_shap") >= F.col("_mx") * share).cast("int")).drop("_mx")


# Features that the stability selection always includes, and the one it never does.
STABLE_ALWAYS = ("store_month_avg", "revenue_rolling_rank_30d", "revenue_median_last_90d")
STABLE_NEVER = ("revenue_percentile",)
STABLE_FEATURES = 25


def shap_stability(per_fold: DataFrame, top_n: int = STABLE_FEATURES, always=STABLE_ALWAYS, never=STABLE_NEVER) -> DataFrame:
    """per_fold: (fold, feature, mean_abs_shap).  Stability = mean / (population std + 1e-10) over the folds.

    Selected: features with std <= 0.5 * mean among the ``top_n`` of all features by stability, and ``always``;
    none of ``never``."""
    from pyspark.sql import Window

    s = per_fold.groupBy("feature").agg(F.count("mean_abs_shap").alias("n_folds"), F.avg("mean_abs_shap").alias("mean"), F.stddev_pop("mean_abs_shap").alias("std"))
    s = s.withColumn("stability", F.col("mean") / (F.col("std") + 1e-10))
    s = s.withColumn("stable", (F.col("std") <= F.col("mean") * 0.5).cast("int"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("stability").desc(), "feature")))  # one row per feature
    chosen = ((F.col("stable") == 1) & (F.col("rank") <= top_n)) | F.col("feature").isin(*always)
    return s.withColumn("selected", (chosen & ~F.col("feature").isin(*never)).cast("int"))


def common_features(selected: DataFrame, min_clusters: int = 2) -> DataFrame:
    """selected: (cluster, feature) → features chosen in at least ``min_clusters`` clusters."""
    return selected.groupBy("feature").agg(F.count_distinct("cluster").alias("n_clusters")).where(
        F.col("n_clusters") >= min_clusters)


# Name patterns of history features, and stable features that a ranking should have at its top.
LEAK_PATTERNS = ("revenue_lag_", "revenue_rolling_", "rolling_", "lag_")
MUST_HAVE = ("store", "store_dayofweek_avg", "discount_pct")


def leakage_audit(ranked: DataFrame, top: int = 10, catalogue: dict | None = None) -> DataFrame:
    """Warnings from the top of a (feature, score) ranking: lag/rolling features in the top ``top``, features that
    the ``catalogue`` (name: (uses current rows, uses future rows)) flags, and must-have stable features missing."""
    from pyspark.sql import Window

    r = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "feature")))
    t = r.where(F.col("rank") <= top)
    leak = t.where(F.expr(" OR ".join(f"instr(feature, '{p}') > 0" for p in LEAK_PATTERNS))).select(
        F.lit("leakage").alias("kind"), "feature", "rank")
    present = t.agg(*[F.max(F.instr("feature", m) > 0).alias(m) for m in MUST_HAVE])
    miss = present.unpivot([], list(MUST_HAVE), "feature", "present").where(~F.col("present")).select(
        F.lit("missing_stable").alias("kind"), "feature", F.lit(None).cast("int").alias("rank"))
    out = leak.unionByName(miss)
    for k, kind in enumerate(("uses_current", "uses_future")):
        flagged = [f for f, flags in (catalogue or {}).items() if flags[k]]
        if flagged:
            out = out.unionByName(t.where(F.col("feature").isin(flagged)).select(F.lit(kind).alias("kind"), "feature", "rank"))
    return out
