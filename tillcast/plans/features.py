"""The shared feature table: one lazy plan from (sales, stores, festivals) to one row per store-day.

Training and scoring use the same builder; every per-store window is
written against one ``partitionBy(store).orderBy(date)`` spec so Catalyst
evaluates them after a single exchange on ``store``.  ``CATALOGUE`` flags the
features whose definition looks at the current or future rows (D12), which
``leakage_audit`` reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.columns import clip
from tillcast.operators import transforms as T
from tillcast.operators import windows as W
from tillcast.operators.calendar import calendar_parts, cyclic_1, cyclic_23
from tillcast.operators.joins import join_store
from tillcast.operators.lookups import days_to_festival, is_festival
from tillcast.operators.partitions import dealt
from tillcast.operators.reports import target_encode
from tillcast.operators.rollup import disc_perc

FEATURES = [
    "year", "month", "day", "day_of_week", "quarter", "is_weekend",
    "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "day_of_year_sin2", "day_of_year_cos2", "week_of_year_sin2", "week_of_year_cos2",
    "store_area", "store_area_bucket", "is_online", "city_encoded", "region_encoded", "channel_encoded",
    "discount_pct", "is_discounted", "discount_pct_squared",
    "revenue_lag_1", "revenue_lag_3", "revenue_lag_7", "revenue_lag_14", "revenue_lag_30",
    "revenue_rolling_mean_7d", "revenue_rolling_std_7d", "revenue_rolling_mean_14d", "revenue_rolling_std_14d",
    "revenue_rolling_mean_30d", "revenue_rolling_std_30d", "revenue_last_3_days", "revenue_volatility_3d",
    "store_weekday_avg", "store_month_avg", "store_dayofweek_avg", "lead_time_days",
    "is_festival", "days_to_festival", "days_since_last_promo",
    "store_area_city_interaction", "discount_city_interaction", "revenue_lag_7_discount_interaction",
]

# name → (uses the current row, uses future rows)
CATALOGUE = {f: (False, False) for f in FEATURES}
CATALOGUE.update({
    "store_month_avg": (True, True), "store_dayofweek_avg": (True, True), "store_day_avg": (True, True),
    "seasonal_index": (True, True), "city_encoded": (True, True), "region_encoded": (True, True),
    "channel_encoded": (True, True), "store_area_bucket": (False, True),
    "demand_trend": (True, False), "revenue_median_last_90d": (True, False), "revenue_rolling_rank_30d": (True, False),
    # products with a target encoding inherit its look at the whole history
    "store_area_city_interaction": (True, True), "discount_city_interaction": (True, True),
    "discount_pct": (True, False), "is_discounted": (True, False), "discount_pct_squared": (True, False),
    "revenue_lag_7_discount_interaction": (True, False),
})


#: Columns of the feature table besides the features: what models, weights and reports read, and a flagged average.
KEPT = ["store", "date", "revenue", "store_day_avg", "target_log_ratio"]
#: Rows of the feature table that one task sorts, as a share of those of a narrow table.
WIDTH = 4


def build_feature_table(sales: DataFrame, stores: DataFrame, festivals: DataFrame, rows: int | None = None) -> DataFrame:
    """One row per store-day.  With ``rows``, the number of ``sales``, whole stores are dealt into partitions of a bounded size.

    The windows need the sales and the calendar alone, so they sort narrow rows; what is wide and local to a row comes after."""
    d = calendar_parts(sales if rows is None else dealt(sales, WIDTH * rows, "store"))
    # windows of one order are next to each other, so a store's rows are sorted once for each order
    d = (d.transform(W.lags).transform(W.rolling_lagged).transform(W.last3).transform(W.volatility3)
         .transform(W.lead_time).transform(W.promo_recency))
    d = d.withColumn("revenue_std", F.stddev_samp("revenue").over(W.wsd().rowsBetween(W.Window.unboundedPreceding, 0)))
    d = d.transform(W.store_weekday_hist).transform(W.store_baselines)
    d = join_store(d, stores).transform(lambda x: disc_perc(x, guarded=True))
    d = d.withColumn("discount_pct", clip(F.col("disc_perc") / 100.0, 0.0, 1.0))
    d = d.withColumn("is_discounted", (F.col("discount_pct") > 0).cast("int"))
    d = d.withColumn("discount_pct_squared", F.col("discount_pct") * F.col("discount_pct"))
    d = d.transform(cyclic_1).transform(cyclic_23)
    placed = join_store(sales, stores)  # encodings and edges are learnt without the shuffle
    d = target_encode(d, fit=placed)
    d = T.qcut(d, "store_area", 5, "store_area_bucket", fit=placed)
    d = is_festival(d, festivals).transform(lambda x: days_to_festival(x, festivals))
    d = T.interactions(d)
    d = T.ratio_target(d)
    return T.clean_matrix(d, FEATURES)
