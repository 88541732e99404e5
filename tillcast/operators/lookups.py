"""§2.3 scoring-time lookups: a *table* of (store, date, discount) requests
against the sales history, in one plan.

The reference answers one request at a time with per-row scans of the
history; here every lookup is an equi-join or a window after one shuffle on
``store``:

* exact-date lags: the history is emitted once per lag offset (date + n) and
  equi-joined on (store, date), then folded back with a conditional
  aggregate — a bounded 5× fan-out, no range join;
* "last w rows strictly before the date": history rows carry their own
  trailing-window stats; requests and history are unioned and each request
  takes the stats of the latest earlier history row with
  ``last(struct, ignorenulls)`` over the preceding rows (as-of join);
* same day last year / same day-of-year: equi-joins on shifted keys, the
  latter bounded by the number of years per (store, day-of-year).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.columns import safe_div, xavg

LAG_DAYS = (1, 3, 7, 14, 30)


def requests_from(daily: DataFrame) -> DataFrame:
    """Scoring requests derived from the sales table: every store-day with its planned discount."""
    from tillcast.functions.columns import clip

    return daily.select("store", "date", clip(F.col("disc_perc") / 100.0, 0.0, 1.0).alias("discount_pct"))


def lag_exact_date(requests: DataFrame, history: DataFrame, value: str = "revenue", days=LAG_DAYS) -> DataFrame:
    """Revenue of the same store exactly n days earlier (NULL if that day has no sale), plus diffs."""
    offs = F.explode(F.array(*[F.lit(n) for n in days])).alias("_n")
    shifted = history.select("store", F.col("date").alias("_hdate"), F.col(value).alias("_v"), offs)
    shifted = shifted.select("store", F.date_add("_hdate", F.col("_n")).alias("date"), "_n", "_v")
    hit = shifted.join(requests.select("store", "date").distinct(), ["store", "date"], "left_semi")
    folded = hit.groupBy("store", "date").agg(
        *[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(f"revenue_lag_{n}") for n in days])
    out = requests.join(folded, ["store", "date"], "left")
    pairs = [(1, 3), (3, 7), (7, 14), (14, 30)]
    return out.withColumns({f"revenue_lag_diff_{a}_{b}": F.col(f"revenue_lag_{a}") - F.col(f"revenue_lag_{b}")
                            for a, b in pairs if a in days and b in days})


def asof_tail(requests: DataFrame, history: DataFrame, stats: dict) -> DataFrame:
    """For each request, ``stats`` evaluated on the history rows of the same store strictly before its date.

    ``stats`` maps output name → (column expression builder taking a window
    frame); every builder is evaluated on history rows over a trailing frame
    that ends at the row itself, and the request picks the latest earlier row.
    """
    wh = Window.partitionBy("store").orderBy("date")
    h = history.select("store", "date", *[F.col(c) for c in {c for _, (c, _) in stats.items()}])
    h = h.withColumn("_st", F.struct(*[fn(F.col(c), wh).alias(name) for name, (c, fn) in stats.items()]))
    h = h.select("store", "date", F.lit(1).alias("_kind"), "_st")
    r = requests.withColumn("_kind", F.lit(0)).withColumn("_rid", F.monotonically_increasing_id())
    u = r.unionByName(h, allowMissingColumns=True)
    w = Window.partitionBy("store").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("_prev", F.last("_st", ignorenulls=True).over(w))
    out = u.where(F.col("_kind") == 0).drop("_kind", "_st", "_rid")
    return out.select(*[c for c in out.columns if c != "_prev"], *[F.col(f"_prev.{n}").alias(n) for n in stats])


def _tail_mean(w):
    return lambda c, wh: xavg(c, wh.rowsBetween(-(w - 1), 0))


def _tail_mean_plain(w):
    return lambda c, wh: F.avg(c).over(wh.rowsBetween(-(w - 1), 0))


def _tail_std(w):
    return lambda c, wh: F.stddev_samp(c).over(wh.rowsBetween(-(w - 1), 0))


def hist_tail_stats(requests: DataFrame, history: DataFrame, windows=(7, 14, 30)) -> DataFrame:
    stats = {}
    for w in windows:
        stats[f"revenue_rolling_mean_{w}d"] = ("revenue", _tail_mean(w))
        stats[f"revenue_rolling_std_{w}d"] = ("revenue", _tail_std(w))
    return asof_tail(requests, history, stats)


def hist_tail_mean14(requests: DataFrame, history: DataFrame) -> DataFrame:
    return asof_tail(requests, history, {
        "discount_rolling_mean_14d": ("discount_pct", _tail_mean_plain(14)),
        "revenue_rolling_mean_14d": ("revenue", _tail_mean(14)),
    })


def same_day_last_year(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Revenue at (store, date − 1 year); else the store's mean; else the mean of store means."""
    ly = history.select("store", F.col("date").alias("_ly"), F.col("revenue").alias("_ly_rev"))
    smean = history.groupBy("store").agg(xavg("revenue").alias("_smean"))
    gmean = smean.agg(F.avg("_smean").alias("_gmean"))
    out = (requests.withColumn("_ly", F.add_months("date", -12))
           .join(ly, ["store", "_ly"], "left")
           .join(smean, "store", "left")
           .crossJoin(F.broadcast(gmean)))
    return out.withColumn("same_day_revenue_last_year", F.coalesce("_ly_rev", "_smean", "_gmean")).drop(
        "_ly", "_ly_rev", "_smean", "_gmean")


def same_doy_3y(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Mean revenue on the same day-of-year in the previous three years, and its gap to the store-month mean."""
    h = history.select("store", F.dayofyear("date").alias("_doy"), F.year("date").alias("_y"), "revenue")
    r = requests.select("store", "date", F.dayofyear("date").alias("_doy"), F.year("date").alias("_ry"))
    m = r.join(h, ["store", "_doy"], "inner").where((F.col("_y") < F.col("_ry")) & (F.col("_y") >= F.col("_ry") - 3))
    doy = m.groupBy("store", "date").agg(xavg("revenue").alias("same_dayofyear_avg_3y"))
    sm = history.groupBy("store", F.month("date").alias("_m")).agg(xavg("revenue").alias("same_dayofyear_month_avg"))
    out = (requests.join(doy, ["store", "date"], "left")
           .withColumn("_m", F.month("date")).join(sm, ["store", "_m"], "left").drop("_m"))
    return out.withColumn("same_dayofyear_delta_vs_month",
                          F.col("same_dayofyear_avg_3y") - F.col("same_dayofyear_month_avg"))


def seasonal_join(requests: DataFrame, history: DataFrame) -> DataFrame:
    """⟕ store × month × weekday mean revenue of the history."""
    idx = history.groupBy("store", F.month("date").alias("month"), F.weekday("date").alias("weekday")).agg(
        xavg("revenue").alias("store_month_weekday_avg"))
    r = requests.withColumn("month", F.month("date")).withColumn("weekday", F.weekday("date"))
    return r.join(idx, ["store", "month", "weekday"], "left")


def is_festival(df: DataFrame, festivals: DataFrame) -> DataFrame:
    """Festival flag (semi-join semantics on a fixed 112-row calendar) and weekday-festival flag."""
    fd = festivals.select(F.col("date").alias("_fd")).distinct().withColumn("_isf", F.lit(1))
    out = df.join(F.broadcast(fd), F.col("date") == F.col("_fd"), "left")
    out = out.withColumn("is_festival", F.coalesce(F.col("_isf"), F.lit(0))).drop("_fd", "_isf")
    return out.withColumn("is_weekday_festival", ((F.col("is_festival") == 1) & (F.weekday("date") < 5)).cast("int"))


def days_to_festival(df: DataFrame, festivals: DataFrame) -> DataFrame:
    """Days to the next festival on or after the date (365 if none).

    The calendar becomes a row a day from its first to its last festival (its size is fixed), joined by date."""
    cal = festivals.agg(F.sort_array(F.collect_set("date")).alias("_fest"))
    days = cal.select("_fest", F.posexplode("_fest").alias("_k", "_next"))
    since = F.when(F.col("_k") > 0, F.date_add(F.get("_fest", F.col("_k") - 1), 1)).otherwise(F.col("_next"))
    days = days.select(F.explode(F.sequence(since, "_next")).alias("_day"), "_next").select("_day", F.datediff("_next", "_day").alias("_left"))
    first = cal.select(F.get("_fest", F.lit(0)).alias("_first"))
    out = df.join(F.broadcast(days), F.col("date") == F.col("_day"), "left").crossJoin(F.broadcast(first))
    early = F.when(F.col("date") < F.col("_first"), F.datediff("_first", "date"))
    return out.withColumn("days_to_festival", F.coalesce("_left", early, F.lit(365))).drop("_day", "_left", "_first")


def avg_fallback(requests: DataFrame, history: DataFrame) -> DataFrame:
    """store_month_avg: (store, month) → store → month → global mean, with the level used;
    store_dayofweek_avg: (store, weekday) → store → weekday → store_month_avg (if > 0) / global."""
    h = history.select("store", F.month("date").alias("month"), F.weekday("date").alias("day_of_week"), "revenue")
    sm = h.groupBy("store", "month").agg(xavg("revenue").alias("_sm"))
    sd = h.groupBy("store", "day_of_week").agg(xavg("revenue").alias("_sd"))
    s = h.groupBy("store").agg(xavg("revenue").alias("_s"))
    m = h.groupBy("month").agg(xavg("revenue").alias("_m"))
    d = h.groupBy("day_of_week").agg(xavg("revenue").alias("_d"))
    g = h.agg(xavg("revenue").alias("_g"))
    r = requests.withColumn("month", F.month("date")).withColumn("day_of_week", F.weekday("date"))
    out = (r.join(sm, ["store", "month"], "left").join(sd, ["store", "day_of_week"], "left")
           .join(s, "store", "left").join(F.broadcast(m), "month", "left").join(F.broadcast(d), "day_of_week", "left")
           .crossJoin(F.broadcast(g)))
    sma = F.coalesce("_sm", "_s", "_m", "_g")
    sma_level = (F.when(F.col("_sm").isNotNull(), 1).when(F.col("_s").isNotNull(), 2)
                 .when(F.col("_m").isNotNull(), 3).otherwise(4))
    out = out.withColumn("store_month_avg", sma).withColumn("store_month_avg_level", sma_level)
    last = F.when(F.col("store_month_avg") > 0, F.col("store_month_avg")).otherwise(F.col("_g"))
    sda = F.coalesce("_sd", "_s", "_d", last)
    sda_level = (F.when(F.col("_sd").isNotNull(), 1).when(F.col("_s").isNotNull(), 2)
                 .when(F.col("_d").isNotNull(), 3).otherwise(4))
    out = out.withColumn("store_dayofweek_avg", sda).withColumn("store_dayofweek_avg_level", sda_level)
    return out.drop("_sm", "_sd", "_s", "_m", "_d", "_g")


def lag_fallback(df: DataFrame, cols, global_mean_col: str = "_global_mean") -> DataFrame:
    """Zero / NULL lag → store_dayofweek_avg (if > 0) → store_month_avg (if > 0) → global mean (no noise, D14)."""
    fb = (F.when(F.col("store_dayofweek_avg") > 0, F.col("store_dayofweek_avg"))
          .when(F.col("store_month_avg") > 0, F.col("store_month_avg"))
          .otherwise(F.col(global_mean_col)))
    return df.withColumns({c: F.when(F.col(c).isNull() | (F.col(c) == 0), fb).otherwise(F.col(c)) for c in cols})


def no_history(requests: DataFrame, history: DataFrame, cols) -> DataFrame:
    """Requests whose store has no sale before the date: history-derived columns → the store's median revenue, else 0."""
    first = history.groupBy("store").agg(F.min("date").alias("_first"),
                                         F.percentile("revenue", 0.5).alias("_smed"))
    out = requests.join(first, "store", "left")
    nohist = F.col("_first").isNull() | (F.col("_first") >= F.col("date"))
    out = out.withColumn("has_history", (~nohist).cast("int"))
    out = out.withColumns({c: F.when(nohist, F.coalesce(F.col("_smed"), F.lit(0.0))).otherwise(F.col(c)) for c in cols})
    return out.drop("_first", "_smed")


def yoy_fallback(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Latest-year (store, month, weekday) mean × (1 + mean yearly growth) × (100 + discount %)/100;
    no matching history → global mean × the same discount factor."""
    h = history.select("store", F.month("date").alias("month"), F.weekday("date").alias("day_of_week"),
                       F.year("date").alias("year"), "revenue")
    y = h.groupBy("store", "month", "day_of_week", "year").agg(xavg("revenue").alias("_ym"))
    wy = Window.partitionBy("store", "month", "day_of_week").orderBy("year")
    y = y.withColumn("_g", safe_div(F.col("_ym"), F.lag("_ym").over(wy)) - F.lit(1.0))
    k = y.groupBy("store", "month", "day_of_week").agg(
        F.max_by("_ym", "year").alias("_latest"), F.avg("_g").alias("_growth"), F.count("_ym").alias("_ny"))
    g = history.agg(xavg("revenue").alias("_gm"))
    r = requests.withColumn("month", F.month("date")).withColumn("day_of_week", F.weekday("date"))
    out = r.join(k, ["store", "month", "day_of_week"], "left").crossJoin(F.broadcast(g))
    base = F.when(F.col("_latest").isNull(), F.col("_gm")).when(
        (F.col("_ny") > 1) & F.col("_growth").isNotNull(), F.col("_latest") * (F.lit(1.0) + F.col("_growth"))
    ).otherwise(F.col("_latest"))
    factor = (F.lit(100.0) + F.coalesce(F.col("discount_pct"), F.lit(0.0)) * 100.0) / 100.0
    return out.withColumn("yoy_fallback", base * factor).drop("_latest", "_growth", "_ny", "_gm")
