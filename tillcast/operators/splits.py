"""§2.8 group splits as a (group, fold, is_test) table.

The fold plan lives on the *group* dimension (one row per store and fold),
ranked once (distributed exact rank); rows get their side with an equi-join on
the group, so no row is ever copied per fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def _ranked_groups(df: DataFrame, group: str) -> DataFrame:
    from tillcast.functions.quantiles import rank_within

    g = df.select(group).where(F.col(group).isNotNull()).distinct()
    g = rank_within(g, None, [group], out="_pr", index_out="_r").drop("_pr")
    return g.crossJoin(F.broadcast(g.agg(F.count(F.lit(1)).alias("_G"))))


def group_split(df: DataFrame, group: str = "store", n_splits: int = 5, test_size: float = 0.2,
                wrap: bool = False) -> DataFrame:
    """Fold i tests the sorted groups [i·n, (i+1)·n), n = max(1, int(G·test_size)), clipped at G;
    with ``wrap`` the window wraps modulo G instead."""
    g = _ranked_groups(df, group)
    g = g.withColumn("_nt", F.greatest(F.lit(1), F.floor(F.col("_G") * F.lit(test_size)).cast("int")))
    g = g.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("fold") * F.col("_nt")
    if wrap:
        s = F.pmod(start, F.col("_G"))
        e = F.pmod(s + F.col("_nt"), F.col("_G"))
        test = F.when(e > s, (F.col("_r") >= s) & (F.col("_r") < e)).otherwise((F.col("_r") >= s) | (F.col("_r") < e))
    else:
        end = F.least(start + F.col("_nt"), F.col("_G"))
        test = (F.col("_r") >= start) & (F.col("_r") < end)
    return g.select(group, "fold", test.cast("int").alias("is_test"))


def fold_sizes(df: DataFrame, plan: DataFrame, group: str = "store") -> DataFrame:
    """Rows on each side of every fold (group row counts joined to the fold plan)."""
    c = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    j = plan.join(c, group, "left")
    return j.groupBy("fold").agg(F.sum(F.when(F.col("is_test") == 1, F.col("_n")).otherwise(0)).alias("n_test"),
                                 F.sum(F.when(F.col("is_test") == 0, F.col("_n")).otherwise(0)).alias("n_train"))


def stratified_split(df: DataFrame, y: str = "revenue", group: str = "store", n_splits: int = 5,
                     test_size: float = 0.2, n_bins: int = 5) -> DataFrame:
    """Group split plus the share of each target quantile bin on both sides of every fold."""
    from tillcast.operators.transforms import qcut

    b = qcut(df, y, n_bins, "_bin")
    counts = b.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    plan = group_split(df, group, n_splits, test_size)
    j = plan.join(counts, group, "inner")
    per = j.groupBy("fold", "is_test", F.col("_bin").alias("bin")).agg(F.sum("_n").alias("count"))
    tot = per.groupBy("fold", "is_test").agg(F.sum("count").alias("_tot"))
    return per.join(tot, ["fold", "is_test"]).select("fold", "is_test", "bin", "count",
                                                     (F.col("count") / F.col("_tot")).alias("proportion"))


def train_test_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, keys=("store", "date")) -> DataFrame:
    """Deterministic random split: a row is in the test side when its hashed key falls in the first
    ``test_fraction`` of the hash range (independent of partitioning and of re-execution)."""
    h = F.abs(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])) % F.lit(1_000_000)
    return df.withColumn("is_test", (h < F.lit(int(test_fraction * 1_000_000))).cast("int"))


#: Decay rates that a round of the search tries per cluster, besides those known already.
DECAY_TRIES = 9


def decay_errors(rows: DataFrame, plan: DataFrame, tries: DataFrame, most: int, group: str, cluster: str) -> DataFrame:
    """(cluster, decay, mean_rmse) of every decay that ``tries`` (cluster, _decays array) names for a cluster.

    One pass: three weighted sums per decay and (store, cluster, weekday), side by side in one aggregation."""
    j = rows.join(F.broadcast(tries.withColumnRenamed(cluster, "_c")), F.col(cluster).eqNullSafe(F.col("_c")))
    aggs = []
    for i in range(most):
        w = F.exp(-F.get("_decays", F.lit(i)) * F.col("_la"))
        aggs += [F.sum(w).alias(f"s0_{i}"), F.sum(w * F.col("_y")).alias(f"s1_{i}"), F.sum(w * F.col("_y") * F.col("_y")).alias(f"s2_{i}")]
    mom = j.groupBy(group, cluster, "_dow").agg(*aggs, F.first("_decays").alias("_decays"))
    sums = [F.array(*[F.col(f"{c}_{i}") for i in range(most)]).alias(c) for c in ("s0", "s1", "s2")]
    mom = mom.select(group, cluster, "_dow", F.explode(F.arrays_zip(F.col("_decays").alias("decay"), *sums)).alias("m"))  # a row per store, weekday and rate
    mom = mom.select(group, cluster, "_dow", "m.*").where("decay IS NOT NULL").join(plan, group)
    train, test = F.col("is_test") == 0, F.col("is_test") == 1
    side = mom.groupBy("fold", cluster, "_dow", "decay").agg(
        *[F.sum(F.when(train, F.col(c))).alias(f"tr_{c}") for c in ("s0", "s1")], *[F.sum(F.when(test, F.col(c))).alias(f"te_{c}") for c in ("s0", "s1", "s2")])
    side = side.where("te_s0 IS NOT NULL AND tr_s0 IS NOT NULL")
    pred = F.col("tr_s1") / F.col("tr_s0")
    sse = F.col("te_s2") - F.lit(2.0) * pred * F.col("te_s1") + pred * pred * F.col("te_s0")
    fold = side.groupBy("fold", cluster, "decay").agg(F.sqrt(F.greatest(F.sum(sse) / F.sum("te_s0"), F.lit(0.0))).alias("rmse"))
    return fold.groupBy(cluster, "decay").agg(F.avg("rmse").alias("mean_rmse"))


def decay_search(df: DataFrame, decays, group: str = "store", cluster: str = "store_cluster", n_splits: int = 5,
                 test_size: float = 0.2) -> DataFrame:
    """Per cluster, the time-decay rate of ``decays`` with the lowest mean weighted RMSE over group folds (D10).

    Prediction of a test row = decay-weighted mean revenue of the *train* rows of the same cluster and
    weekday; error weights are the same decay weights.  The error is a smooth curve over the decay: a round tries a
    few evenly spaced rates inside each cluster's bracket and narrows it to the neighbours of the best, until
    those are the neighbouring rates.  Each round is one pass over the written rows, without copying them.
    """
    from tillcast.session import cut_lineage, written

    grid = sorted(float(d) for d in decays)
    mx = df.agg(F.max("date").alias("_maxd"))
    rows = written(df.crossJoin(F.broadcast(mx)).select(
        group, cluster, F.weekday("date").alias("_dow"), F.col("revenue").alias("_y"),
        F.log1p(F.datediff(F.col("_maxd"), F.col("date")).cast("double")).alias("_la")), "decay-rows")
    plan = cut_lineage(group_split(df, group, n_splits, test_size))
    names = [r[0] for r in rows.select(cluster).distinct().collect()]  # clusters, a handful
    known: dict = {c: {} for c in names}
    bracket = {c: (0, len(grid) - 1) for c in names}
    while True:
        tries = {}
        for c, (a, b) in bracket.items():
            step = max(1, -(-(b - a) // (DECAY_TRIES - 1)))
            tries[c] = [i for i in [*range(a, b, step), b] if i not in known[c]]
        tries = {c: t for c, t in tries.items() if t}
        if not tries:
            break
        schema = df.select(cluster).schema.add("_decays", ArrayType(DoubleType()))
        table = df.sparkSession.createDataFrame([(c, [grid[i] for i in t]) for c, t in tries.items()], schema)
        place = {d: i for i, d in enumerate(grid)}
        for r in decay_errors(rows, plan, table, max(map(len, tries.values())), group, cluster).collect():
            known[r[cluster]][place[r["decay"]]] = r["mean_rmse"]
        for c in tries:
            seen = sorted(known[c])
            scored = [i for i in seen if known[c][i] is not None]
            if not scored:
                bracket[c] = (0, 0)
                continue
            best = min(scored, key=lambda i: (known[c][i], i))
            k = seen.index(best)
            bracket[c] = (seen[max(0, k - 1)], seen[min(len(seen) - 1, k + 1)])
    rows = []
    for c in names:
        scored = {i: e for i, e in known[c].items() if e is not None}
        if scored:
            best = min(scored, key=lambda i: (scored[i], i))
            rows.append((c, grid[best], scored[best]))
    schema = df.select(cluster).schema.add("best_decay", "double").add("mean_rmse", "double")
    return df.sparkSession.createDataFrame(rows, schema)
