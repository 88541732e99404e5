"""Per-store time-series features as window functions.

All per-store windows share one spec ``Wsd = partitionBy(store).orderBy(date)``
so Catalyst evaluates them after a single exchange on ``store``; windows on
(store, month) or (store, day_of_week) re-sort inside that partitioning and
need no further shuffle.  A store has at most one row per day, so a window
group is bounded by the number of days in the history, whatever the skew
of the raw transactions.

pandas ``rolling(w, min_periods=1).f().shift(1)`` is ``f`` over rows
``(-w, -1)``; without the shift it is rows ``(-(w-1), 0)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.columns import safe_div, xavg
from tillcast.functions.quantiles import running_quantiles

LAGS = (1, 3, 7, 14, 30)
ROLLING = (7, 14, 30)


def wsd(store: str = "store", date: str = "date"):
    return Window.partitionBy(store).orderBy(date)


def _idx(store="store", date="date") -> Column:
    """0-based row position inside the store (pandas ``cumcount``)."""
    return F.row_number().over(wsd(store, date)) - F.lit(1)


def lags(df: DataFrame, value: str = "revenue", ns=LAGS, prefix: str = "revenue_lag_") -> DataFrame:
    w = wsd()
    return df.withColumns({f"{prefix}{n}": F.lag(value, n).over(w) for n in ns})


def lag_diffs(df: DataFrame, prefix: str = "revenue_lag_") -> DataFrame:
    pairs = [(1, 3), (3, 7), (7, 14), (14, 30)]
    return df.withColumns(
        {f"revenue_lag_diff_{a}_{b}": F.col(f"{prefix}{a}") - F.col(f"{prefix}{b}") for a, b in pairs}
    )


def rolling_lagged(df: DataFrame, value: str = "revenue", windows=ROLLING) -> DataFrame:
    """Mean / sample std of the previous w rows, current row excluded."""
    cols = {}
    for w in windows:
        fr = wsd().rowsBetween(-w, -1)
        cols[f"revenue_rolling_mean_{w}d"] = xavg(value, fr)
        cols[f"revenue_rolling_std_{w}d"] = F.stddev_samp(value).over(fr)
    return df.withColumns(cols)


def last3(df: DataFrame, value: str = "revenue") -> DataFrame:
    fr = wsd().rowsBetween(-3, -1)
    return df.withColumns(
        {
            "revenue_last_3_days": xavg(value, fr),
            "revenue_last_3_days_std": F.stddev_samp(value).over(fr),
        }
    )


def volatility3(df: DataFrame, value: str = "revenue") -> DataFrame:
    fr = wsd().rowsBetween(-3, -1)
    return df.withColumn("revenue_volatility_3d", safe_div(F.stddev_samp(value).over(fr), xavg(value, fr)))


def store_baselines(df: DataFrame, value: str = "revenue") -> DataFrame:
    """Whole-history store×month, store×day-of-month and store×weekday means (use future rows, D12)."""
    out = df
    for name, part in (("store_dayofweek_avg", "day_of_week"), ("store_month_avg", "month"), ("store_day_avg", "day")):
        out = out.withColumn(name, xavg(value, Window.partitionBy("store", part)))
    return out


def expanding_stats(df: DataFrame, keys, value: str = "revenue", median_col: str = "revenue_median",
                    std_col: str = "revenue_std") -> DataFrame:
    """Expanding median and sample std per group, current row included.

    The std is a running window aggregate; the exact running median comes
    from ``running_quantiles`` (one sorted buffer per group, linear in rows)
    instead of an unbounded ``percentile`` frame that re-sorts per row.  Both
    read the rows of one shuffle.
    """
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = df.repartition(*keys).withColumn(std_col, F.stddev_samp(value).over(w))
    return running_quantiles(out, keys, "date", value, {median_col: 0.5}, placed=True)


def expanding_store(df: DataFrame, value: str = "revenue") -> DataFrame:
    return expanding_stats(df, ["store"], value, "revenue_median", "revenue_std")


def expanding_store_month(df: DataFrame, value: str = "revenue") -> DataFrame:
    return expanding_stats(df, ["store", "month"], value, "store_month_revenue_median", "store_month_revenue_std")


def seasonal_index(df: DataFrame, value: str = "revenue") -> DataFrame:
    """Expanding (store, month) median ÷ the whole (store, month) median."""
    keys = ["store", "month"]
    out = df.repartition(*keys).withColumn("_med", F.percentile(value, 0.5).over(Window.partitionBy(*keys)))
    out = running_quantiles(out, keys, "date", value, {"_run_med": 0.5}, placed=True)
    return out.withColumn("seasonal_index", safe_div(F.col("_run_med"), F.col("_med"))).drop("_run_med", "_med")


def store_weekday_hist(df: DataFrame, value: str = "revenue") -> DataFrame:
    fr = Window.partitionBy("store", "day_of_week").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns(
        {"store_weekday_avg": xavg(value, fr), "store_weekday_std": F.stddev_samp(value).over(fr)}
    )


def day_over_day(df: DataFrame, value: str = "revenue") -> DataFrame:
    prev = F.lag(value, 1).over(wsd())
    return df.withColumn("revenue_day_over_day", safe_div(F.col(value), prev) - F.lit(1.0))


def week_over_week(df: DataFrame, value: str = "revenue") -> DataFrame:
    """pct_change(7) inside (store, weekday): seven same-weekday rows back."""
    prev = F.lag(value, 7).over(Window.partitionBy("store", "day_of_week").orderBy("date"))
    return df.withColumn("revenue_week_over_week", safe_div(F.col(value), prev) - F.lit(1.0))


def region_weekday_std(df: DataFrame, value: str = "revenue", order_by=("store", "date"),
                       out: str = "region_weekday_std", chunk_rows: int | None = None) -> DataFrame:
    """Sample std of the previous 28 rows inside (region, weekday), rows ordered by (store, date) (D11).

    There are only regions × 7 groups, so a plain window puts a whole group (possibly a third of all
    rows) into one task.  With ``chunk_rows`` the groups are cut into chunks of that many consecutive
    rows: an exact distributed rank gives every row its position p in the group, the window runs per
    (region, weekday, p // chunk_rows), and each chunk also receives the last 28 rows of the chunk before
    it as context rows (used by the frame, not emitted).  Results equal the unchunked window.
    """
    if not chunk_rows:
        fr = Window.partitionBy("region", "day_of_week").orderBy(*order_by).rowsBetween(-28, -1)
        return df.withColumn(out, F.stddev_samp(value).over(fr))
    from tillcast.functions.quantiles import rank_within

    key = F.concat_ws("|", F.coalesce(F.col("region"), F.lit("\\N")), F.col("day_of_week").cast("string"))
    d = df.withColumn("_grp", key)
    r = rank_within(d, "_grp", list(order_by), out="_pr", index_out="_p").drop("_pr")
    c = F.lit(int(chunk_rows))
    own = r.withColumn("_chunk", F.floor(F.col("_p") / c)).withColumn("_ctx", F.lit(0))
    ctx = (r.select("_grp", "_p", value).where(F.pmod(F.col("_p"), c) >= c - 28)
           .withColumn("_chunk", F.floor(F.col("_p") / c) + 1).withColumn("_ctx", F.lit(1)))
    u = own.unionByName(ctx, allowMissingColumns=True)
    fr = Window.partitionBy("_grp", "_chunk").orderBy("_p").rowsBetween(-28, -1)
    res = u.withColumn(out, F.stddev_samp(value).over(fr)).where(F.col("_ctx") == 0)
    return res.drop("_grp", "_p", "_chunk", "_ctx")


def since_high(df: DataFrame, value: str = "revenue", out: str = "time_since_last_high_revenue") -> DataFrame:
    """Rows since the last earlier row above its store's expanding 90th percentile; row index if none."""
    q = running_quantiles(df, ["store"], "date", value, {"_p90": 0.9})
    idx = _idx()
    q = q.withColumn("_i", idx)
    last = F.max(F.when(F.col(value) > F.col("_p90"), F.col("_i"))).over(
        wsd().rowsBetween(Window.unboundedPreceding, -1)
    )
    return q.withColumn(out, F.coalesce(F.col("_i") - last, F.col("_i"))).drop("_p90", "_i")


def lag7_percentile(df: DataFrame, value: str = "revenue") -> DataFrame:
    """Share of the previous 30 values below the value 7 rows back; NULL before row 30."""
    w = wsd()
    lag7 = F.lag(value, 7).over(w)
    prev30 = F.collect_list(value).over(w.rowsBetween(-30, -1))
    share = F.size(F.filter(F.col("_prev30"), lambda v: v < F.col("_lag7"))) / F.size(F.col("_prev30"))
    return (
        df.withColumn("_lag7", lag7)
        .withColumn("_prev30", prev30)
        .withColumn("_i", _idx())
        .withColumn(
            "revenue_lag_7_percentile",
            F.when((F.col("_i") >= 30) & F.col("_lag7").isNotNull(), share),
        )
        .drop("_lag7", "_prev30", "_i")
    )


def rolling_rank30(df: DataFrame, value: str = "revenue", fill: str | None = "store_month_avg") -> DataFrame:
    """Percentile rank (ties averaged) of the current value within the last 30 rows."""
    win = F.collect_list(value).over(wsd().rowsBetween(-29, 0))
    x = F.col(value)
    less = F.size(F.filter(F.col("_w30"), lambda v: v < x))
    equal = F.size(F.filter(F.col("_w30"), lambda v: v == x))
    rank = (less + (equal + F.lit(1)) / F.lit(2.0)) / F.size(F.col("_w30"))
    rank = F.when(x.isNull(), F.lit(None)).otherwise(rank)
    if fill:
        rank = F.coalesce(rank, F.col(fill))
    return df.withColumn("_w30", win).withColumn("revenue_rolling_rank_30d", rank).drop("_w30")


def median90(df: DataFrame, value: str = "revenue", fill: str | None = "store_month_avg") -> DataFrame:
    med = F.percentile(value, 0.5).over(wsd().rowsBetween(-89, 0))
    if fill:
        med = F.coalesce(med, F.col(fill))
    return df.withColumn("revenue_median_last_90d", med)


def demand_trend(df: DataFrame, value: str = "revenue") -> DataFrame:
    m90 = xavg(value, wsd().rowsBetween(-89, 0))
    m7 = xavg(value, wsd().rowsBetween(-6, 0))
    return df.withColumn("revenue_rolling_mean_90d", m90).withColumn(
        "demand_trend", m7 / (F.col("revenue_rolling_mean_90d") + F.lit(1e-6))
    )


def promo_recency(df: DataFrame, promo: str = "disc_value") -> DataFrame:
    """Rows since the last row with a discount (0 on such a row); row index if none yet."""
    i = _idx()
    last = F.max(F.when(F.col(promo) > 0, F.col("_i"))).over(wsd().rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_i", i)
        .withColumn("days_since_last_promo", F.coalesce(F.col("_i") - last, F.col("_i")))
        .drop("_i")
    )


def discount_rolling14(df: DataFrame, value: str = "disc_perc") -> DataFrame:
    fr = wsd().rowsBetween(-13, 0)
    return df.withColumns(
        {"discount_rolling_mean_14d": F.avg(value).over(fr), "discount_rolling_std_14d": F.stddev_samp(value).over(fr)}
    )


def first_appearance(df: DataFrame) -> DataFrame:
    return df.withColumn("is_first_appearance_of_store", (F.row_number().over(wsd()) == 1).cast("int"))


def volatility_ratio30(df: DataFrame, value: str = "revenue") -> DataFrame:
    fr = wsd().rowsBetween(-29, 0)
    return df.withColumn(
        "seasonal_volatility_ratio", F.stddev_samp(value).over(fr) / (xavg(value, fr) + F.lit(1e-6))
    )


def lead_time(df: DataFrame) -> DataFrame:
    """Days since the store's previous row (0 on its first row)."""
    prev = F.lag("date", 1).over(wsd())
    return df.withColumn("lead_time_days", F.coalesce(F.datediff(F.col("date"), prev), F.lit(0)))


def lead_time_scoring(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Days from the last date of the whole history to each request (null without a history)."""
    last = history.agg(F.max("date").alias("_last"))
    return requests.crossJoin(F.broadcast(last)).withColumn("lead_time_days", F.datediff(F.col("date"), F.col("_last"))).drop("_last")


def smooth_residuals(df: DataFrame, residual: str = "residual", out: str = "smoothed_abs_residual") -> DataFrame:
    """Centred 7-row median of |residual| per store."""
    fr = wsd().rowsBetween(-3, 3)
    return df.withColumn(out, F.percentile(F.abs(F.col(residual)), 0.5).over(fr))
