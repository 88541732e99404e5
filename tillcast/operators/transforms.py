"""§2.2 projections: interactions, cluster-specific transforms, cleaning,
outlier caps and target transforms.  All are column expressions; the few
statistics they need are 1-row aggregates (cross-joined, size 1) or
bounded per-store windows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.columns import bucket_of_inner, clip, cyc_sin, finite, inner_edges, safe_div, zero_if_bad
from tillcast.functions.quantiles import exact_percentiles
from tillcast.session import cut_lineage


def qcut(df: DataFrame, value: str, q: int, out: str, fit: DataFrame | None = None) -> DataFrame:
    """``pd.qcut(x, q, labels=False, duplicates='drop')`` on exact linear quantile edges (right-closed),
    edges learnt on ``fit`` (default: ``df``)."""
    probs = [i / q for i in range(q + 1)]
    e = exact_percentiles(df if fit is None else fit, value, probs)
    inner = e.select(inner_edges(F.array(*[F.col(f"q{i}") for i in range(q + 1)])).alias("_inner"))
    return df.crossJoin(F.broadcast(inner)).withColumn(out, bucket_of_inner(value, "_inner")).drop("_inner")


def interactions(df: DataFrame) -> DataFrame:
    c = F.col
    out = df.withColumns({
        "store_area_city_interaction": c("store_area") * c("city_encoded"),
        "store_area_region_interaction": c("store_area") * c("region_encoded"),
        "online_city_interaction": c("is_online") * c("city_encoded"),
        "discount_store_tier_interaction": c("discount_pct") * c("store_area_bucket"),
        "discount_region_interaction": c("discount_pct") * c("region_encoded"),
        "discount_city_interaction": c("discount_pct") * c("city_encoded"),
        "month_region_interaction": c("month") * c("region_encoded"),
        "month_store_tier_interaction": c("month") * c("store_area_bucket"),
        "revenue_lag_7_discount_interaction": c("revenue_lag_7") * c("discount_pct"),
        "revenue_std_discount_interaction": c("revenue_std") * c("discount_pct"),
    })
    return out.withColumns({
        "premium_location_discount": c("store_area_city_interaction") * c("discount_pct"),
        "seasonal_premium_location": c("month") * c("store_area_city_interaction"),
    })


INTERACTIONS = [
    "store_area_city_interaction", "store_area_region_interaction", "online_city_interaction",
    "discount_store_tier_interaction", "discount_region_interaction", "discount_city_interaction",
    "month_region_interaction", "month_store_tier_interaction", "revenue_lag_7_discount_interaction",
    "revenue_std_discount_interaction", "premium_location_discount", "seasonal_premium_location",
]


def seasonal_cross(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "store_seasonal_index": F.col("seasonal_index") * F.col("store_area_bucket"),
        "region_seasonal_index": F.col("seasonal_index") * F.col("region_encoded"),
    })


def poly_terms(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "discount_pct_squared": F.pow(F.col("discount_pct"), F.lit(2.0)),
        "store_area_squared": F.pow(F.col("store_area"), F.lit(2.0)),
    })


def channel_season(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "channel_month_sin": F.col("channel_encoded") * F.col("month_sin"),
        "channel_month_cos": F.col("channel_encoded") * F.col("month_cos"),
    })


def event_discount(df: DataFrame, holiday: str = "is_festival") -> DataFrame:
    hol = F.coalesce(F.col(holiday), F.lit(0)) if holiday in df.columns else F.lit(0)
    ev = (hol.cast("int").bitwiseOR(F.coalesce(F.col("is_weekend"), F.lit(0)).cast("int")))
    return df.withColumn("is_event", ev).withColumn("event_discount_interaction", F.col("is_event") * F.col("disc_perc"))


def weekday_store_ord(df: DataFrame) -> DataFrame:
    """day_of_week·10000 + ordinal of the store among the sorted distinct stores.

    The ordinal is computed on the distinct-store dimension (one row per
    store) and joined back, not with a window over the fact table.
    """
    from tillcast.functions.quantiles import rank_within

    stores = df.select("store").where(F.col("store").isNotNull()).distinct()
    ordn = rank_within(stores, None, ["store"], out="_pr", index_out="store_id_ord").drop("_pr")
    out = df.join(ordn, "store", "left")
    return out.withColumn("weekday_store_ord", F.col("day_of_week") * 10000 + F.col("store_id_ord"))


HOLIDAY_MONTHS = (10, 11, 12, 1, 2)


def cluster_log(df: DataFrame, cluster: str = "store_cluster") -> DataFrame:
    """Per-cluster target transforms in one ``when`` pass (no split / union / re-sort)."""
    c = F.col(cluster)
    rev, qty = F.col("revenue"), F.col("qty_sold")
    rev_t = (F.when(c == "ONLINE", F.log1p(rev + 100.0))
             .when(c.isin("PREMIUM_OFFLINE", "SEASONAL_SPECIALIST"), rev)  # Box-Cox: see ``boxcox``
             .otherwise(F.log1p(rev)))
    qty_t = (F.when(c == "ONLINE", F.log1p(qty + 10.0))
             .when(c.isin("PREMIUM_OFFLINE", "SEASONAL_SPECIALIST", "HOLIDAY_SPECIALIST"), qty)
             .otherwise(F.log1p(qty)))
    return df.withColumn("revenue_t", rev_t).withColumn("qty_sold_t", qty_t)


def cluster_log_union(df: DataFrame, clusters, cluster: str = "store_cluster") -> DataFrame:
    """The reference's split-transform-concatenate form; equal to ``cluster_log`` (used as its test)."""
    parts = [cluster_log(df.where(F.col(cluster) == k), cluster) for k in clusters]
    rest = cluster_log(df.where(~F.col(cluster).isin(*clusters) | F.col(cluster).isNull()), cluster)
    out = rest
    for p in parts:
        out = out.unionByName(p)
    return out


def cluster_discount(df: DataFrame, cluster: str = "store_cluster") -> DataFrame:
    c = F.col(cluster)
    d = F.col("discount_pct")
    hol = F.col("month").isin(*HOLIDAY_MONTHS).cast("int")
    return df.withColumns({
        "discount_squared": F.when(c == "ONLINE", F.pow(d, 2.0)),
        "discount_cubed": F.when(c == "ONLINE", F.pow(d, 3.0)),
        "seasonal_discount": F.when(c == "SEASONAL_SPECIALIST", d * cyc_sin("month", 12)),
        "is_holiday_month": F.when(c == "HOLIDAY_SPECIALIST", hol),
        "holiday_discount": F.when(c == "HOLIDAY_SPECIALIST", d * hol),
    })


#: Columns from which on a projection, fused into one generated method, is longer than the JVM compiles.
WIDE = 16


def clean_matrix(df: DataFrame, cols) -> DataFrame:
    """NaN / ±inf / NULL → 0 for every feature column.

    Fused with the joins below it, a wide projection becomes one method that the JVM only interprets (five times the
    CPU).  A higher-order function isn't fused, and a projection with one is generated in small methods."""
    clean = {c: zero_if_bad(F.col(c).cast("double")) for c in cols}
    if len(clean) >= WIDE:
        first = next(iter(clean))
        clean[first] = F.get(F.transform(F.array(F.col(first).cast("double")), zero_if_bad), F.lit(0))
    return df.withColumns(clean)


HIST_PAT = re.compile(r"mean|std")
LAG_PATS = ("revenue_lag_", "revenue_lag_diff_", "revenue_rolling_mean_", "revenue_rolling_std_")


def fill_hist(df: DataFrame, cols) -> DataFrame:
    """Lag / rolling / diff NULLs → store_month_avg (else 0); other mean/std features NULL → 0."""
    out = {}
    for c in cols:
        if any(p in c for p in LAG_PATS):
            fb = F.col("store_month_avg") if "store_month_avg" in df.columns else F.lit(0.0)
            out[c] = F.coalesce(F.col(c), fb, F.lit(0.0))
        elif HIST_PAT.search(c):
            out[c] = F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumns(out)


CRITICAL_PATTERNS = ("lag", "rolling", "cyc", "interaction", "revenue_lag_", "revenue_rolling_", "discount_pct")
FFILL_PATTERNS = ("revenue_lag_", "revenue_rolling_", "discount_pct")


def align_features(df: DataFrame, expected, keys=("store", "date"), check: bool = True) -> DataFrame:
    """Missing features → 0, extra dropped, ordered, cast to double; critical all-NULL features raise;
    critical NULL / inf → previous value of the store (forward fill), else 0."""
    cols = []
    for c in expected:
        cols.append((F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c))
    out = df.select(*keys, *cols)
    crit = [c for c in expected if any(p in c for p in CRITICAL_PATTERNS) and c in df.columns]
    if check and crit:
        row = out.agg(*[F.count(F.col(c)).alias(c) for c in crit]).first()
        empty = [c for c in crit if row[c] == 0]
        if empty:
            raise ValueError(f"critical features missing or all-NULL: {empty}")
    ff = [c for c in expected if any(p in c for p in FFILL_PATTERNS)]
    w = Window.partitionBy("store").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({c: F.coalesce(F.last(finite(F.col(c)), ignorenulls=True).over(w), F.lit(0.0)) for c in ff})


ANCHORS = ("revenue_lag_7", "store_dayofweek_avg", "discount_pct", "store_month_avg", "revenue_rolling_mean_7d")


def anchor_features(df: DataFrame, anchors=ANCHORS) -> DataFrame:
    return df.withColumns({a: F.lit(0.0) for a in anchors if a not in df.columns})


def drop_qty(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "qty_sold" in c])


def low_activity(df: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Keep rows whose store × weekday mean revenue is ≥ threshold."""
    from tillcast.functions.columns import xavg

    m = xavg("revenue", Window.partitionBy("store", "day_of_week"))
    return df.withColumn("_swm", m).where(F.col("_swm") >= threshold).drop("_swm")


def drop_leverage(df: DataFrame, value: str = "revenue", q: float = 0.995) -> DataFrame:
    t = exact_percentiles(df, value, [q]).select(F.col("q0").alias("_thr"))
    return df.crossJoin(F.broadcast(t)).where(F.col(value) <= F.col("_thr")).drop("_thr")


def iqr_cap(df: DataFrame, value: str = "revenue") -> tuple[DataFrame, DataFrame]:
    """Clip to [Q1 − 1.5·IQR, Q3 + 1.5·IQR]; returns (capped rows, 1-row outlier report)."""
    q = exact_percentiles(df, value, [0.25, 0.75])
    b = q.select((F.col("q0") - (F.col("q1") - F.col("q0")) * 1.5).alias("_lo"),
                 (F.col("q1") + (F.col("q1") - F.col("q0")) * 1.5).alias("_hi"))
    j = df.crossJoin(F.broadcast(b))
    x = F.col(value)
    rep = j.agg(F.count_if((x < F.col("_lo")) | (x > F.col("_hi"))).alias("n_outliers"),
                F.first("_lo").alias("lower_bound"), F.first("_hi").alias("upper_bound"))
    capped = j.withColumn(value, F.when(x < F.col("_lo"), F.col("_lo")).when(x > F.col("_hi"), F.col("_hi")).otherwise(x))
    return capped.drop("_lo", "_hi"), rep


def cap_store_month(df: DataFrame, value: str = "revenue", q: float = 0.95) -> DataFrame:
    """revenue = min(revenue, its store-month 95th percentile) (bounded group: ≤ 31 rows per store-month-year… per store-month)."""
    p = F.percentile(F.col(value), q).over(Window.partitionBy("store", "month"))
    return df.withColumn(value, F.least(F.col(value), p))


def clip_train_range(df: DataFrame, bounds: DataFrame, cols) -> DataFrame:
    """Clip each feature to its training [p1, p99]; exact zeros (fallback values) are left alone."""
    wide = bounds.groupBy().pivot("feature", list(cols)).agg(F.first(F.array("p_low", "p_high")))
    wide = wide.select(*[F.col(c).alias(f"_b_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(wide))
    out = j.withColumns({
        c: F.when(F.col(c) == 0, F.col(c)).otherwise(
            F.least(F.greatest(F.col(c), F.col(f"_b_{c}")[0]), F.col(f"_b_{c}")[1])) for c in cols
    })
    return out.drop(*[f"_b_{c}" for c in cols])


def ratio_target(df: DataFrame, value: str = "revenue", denom: str = "store_dayofweek_avg") -> DataFrame:
    return df.withColumn("target_ratio", safe_div(F.col(value), F.col(denom))).withColumn(
        "target_log_ratio", F.log1p(F.col("target_ratio")))


def inverse_target(df: DataFrame, pred: str, denom: str = "store_dayofweek_avg", out: str = "revenue_pred") -> DataFrame:
    """clip(pred, ±10) → expm1 → × denominator; non-finite → the denominator."""
    r = F.expm1(clip(F.col(pred), -10.0, 10.0)) * F.col(denom)
    return df.withColumn(out, F.coalesce(finite(r), F.col(denom)))


def inverse_scaled(df: DataFrame, pred: str, target_mean: str, train_pred_mean: str, out: str = "revenue_pred") -> DataFrame:
    """expm1(pred) · target_mean / expm1(train_pred_mean)."""
    return df.withColumn(out, F.expm1(F.col(pred)) * F.col(target_mean) / F.expm1(F.col(train_pred_mean)))



# --- Box-Cox by maximum likelihood: a safeguarded search on the derivative ---
BOXCOX_CLUSTERS = ("PREMIUM_OFFLINE", "SEASONAL_SPECIALIST")
BOXCOX_RANGE = (-2.0, 2.0)
BOXCOX_WIDTH = 1e-10
BOXCOX_ROUNDS = 60
#: Below this |λ| the transform and its derivative are taken from their series.
BOXCOX_SERIES = 1e-6


def _boxcox_terms(log_x, lam):
    """y = (x^λ − 1) / λ and dy/dλ, by their series around λ = 0."""
    e = F.expm1(lam * log_x)
    y = F.when(F.abs(lam) < BOXCOX_SERIES, log_x + lam * log_x * log_x / 2.0).otherwise(e / lam)
    dy = F.when(F.abs(lam) < BOXCOX_SERIES, log_x * log_x / 2.0 + lam * log_x * log_x * log_x / 3.0).otherwise((log_x * (e + 1.0) - y) / lam)
    return y, dy


def _boxcox_round(x: DataFrame, group: str, lams: dict[str, list[float]]) -> dict[str, list[tuple[float, float]]]:
    """(derivative, log-likelihood) at each λ of each group, in one aggregation of mergeable central moments.

    llf(λ) = (λ − 1)·Σ log x − n/2·log var(y); its derivative is Σ log x − n·cov(y, dy/dλ)/var(y)."""
    m = max(len(v) for v in lams.values())
    aggs = [F.count("_l").alias("n"), F.sum("_l").alias("sl")]
    for i in range(m):
        lam = F.coalesce(*[F.when(F.col(group) == g, F.lit(v[i])) for g, v in lams.items() if i < len(v)])
        y, dy = _boxcox_terms(F.col("_l"), lam)
        aggs += [F.var_pop(y).alias(f"v{i}"), F.covar_pop(y, dy).alias(f"c{i}")]
    out = {}
    for r in x.where(F.col(group).isin(*lams)).groupBy(group).agg(*aggs).collect():  # one row per searched group
        out[r[group]] = [(r["sl"] - r["n"] * r[f"c{i}"] / r[f"v{i}"], (lam - 1.0) * r["sl"] - r["n"] / 2.0 * math.log(r[f"v{i}"])) if r[f"v{i}"] else (0.0, None)
                         for i, lam in enumerate(lams[r[group]])]
    return out


def boxcox_lambda(df: DataFrame, value: str = "revenue", group: str = "store_cluster", shift: float = 1.0,
                  clusters=BOXCOX_CLUSTERS) -> DataFrame:
    """(group, boxcox_lambda, llf): the λ of [−2, 2] with the largest likelihood, per group of ``clusters``.

    The root of the derivative is bracketed by the range's ends and closed in by false position, where an end that
    stays twice counts half (the Illinois rule); an end is the answer where the derivative doesn't change sign.  A round reads the
    logarithms once and brings two numbers per group to the driver; all groups share the rounds.  A group
    without spread keeps λ = 1."""
    v = F.col(value).cast("double") + F.lit(shift)
    x = cut_lineage(df.where(F.col(group).isin(*clusters) & (v > 0)).select(group, F.log(v).alias("_l")))
    lo, hi = BOXCOX_RANGE
    state, done = {}, {}
    for g, ((g0, l0), (g1, l1)) in _boxcox_round(x, group, {c: [lo, hi] for c in clusters}).items():
        if l0 is None:
            done[g] = (1.0, None)
        elif g0 <= 0 or g1 >= 0:
            done[g] = (lo, l0) if g0 <= 0 and (g1 < 0 or l0 >= l1) else (hi, l1)
        else:
            state[g] = (lo, hi, g0, g1, 0, math.inf)
    for _ in range(BOXCOX_ROUNDS):
        if not state:
            break
        tries = {g: [(a * gb - b * ga) / (gb - ga)] for g, (a, b, ga, gb, _, _) in state.items()}
        for g, ((d, llf),) in _boxcox_round(x, group, tries).items():
            a, b, ga, gb, side, last = state[g]
            t = tries[g][0]
            if d > 0:  # the likelihood still rises: the root is above
                state[g] = (t, b, d, gb / 2.0 if side > 0 else gb, 1, t)
            else:
                state[g] = (a, t, ga / 2.0 if side < 0 else ga, d, -1, t)
            if d == 0.0 or abs(t - last) < BOXCOX_WIDTH or not a < t < b:
                done[g] = (t, llf)
                del state[g]
    if state:
        raise RuntimeError(f"the Box-Cox search did not settle for {sorted(state)}")
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame([(g, float(lam), llf) for g, (lam, llf) in done.items()], f"{group} {kind}, boxcox_lambda double, llf double")


def boxcox(df: DataFrame, lambdas: DataFrame, value: str = "revenue", group: str = "store_cluster",
           shift: float = 1.0, out: str | None = None) -> DataFrame:
    out = out or f"{value}_boxcox"
    lam = F.col("boxcox_lambda")
    j = df.join(F.broadcast(lambdas.select(group, "boxcox_lambda")), group, "left")
    x = F.col(value) + F.lit(shift)
    y = F.when(lam == 0, F.log(x)).otherwise((F.pow(x, lam) - 1.0) / lam)
    return j.withColumn(out, F.when(lam.isNotNull(), y)).drop("boxcox_lambda")
