"""Sales rollup and discount percentage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions.columns import clip, finite, safe_div

SALES_SCHEMA = T.StructType(
    [
        T.StructField("store", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("qty_sold", T.DoubleType(), True),
        T.StructField("revenue", T.DoubleType(), True),
        T.StructField("disc_value", T.DoubleType(), True),
    ]
)

MEASURES = ("qty_sold", "revenue", "disc_value")


def _no_nan(df: DataFrame, c: str):
    # pandas skips NaN in sums and the clean-up drops infinities; Spark would propagate both, so they are NULL.
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return finite(c)
    return F.col(c)


def daily_rollup(raw: DataFrame, keys=("store", "date")) -> DataFrame:
    """Σ qty, revenue, discount per (store, date).

    Partial aggregation runs map-side, so a store holding a third of all
    transactions is pre-combined before the shuffle; after it there is one
    row per store-day.  A group whose values are all missing sums to 0, as
    in pandas.
    """
    aggs = [
        F.coalesce(F.sum(_no_nan(raw, m)).cast("double"), F.lit(0.0)).alias(m)
        for m in MEASURES
        if m in raw.columns
    ]
    return raw.groupBy(*keys).agg(*aggs)


def disc_perc(df: DataFrame, guarded: bool = True, out: str = "disc_perc") -> DataFrame:
    """Discount share of the gross amount, in percent 0..100.

    guarded=True  (upload / batch report): 0 unless revenue + discount > 0.
    guarded=False (feature path): NaN → 0 and ±inf clipped, i.e. a positive
    discount over a zero gross amount gives 100.
    """
    gross = F.col("revenue") + F.col("disc_value")
    raw = safe_div(F.col("disc_value") * F.lit(100.0), gross)
    if guarded:
        val = F.when(gross > 0, raw).otherwise(F.lit(0.0))
    else:
        val = (
            F.when(gross != 0, raw)
            .when(F.col("disc_value") > 0, F.lit(100.0))
            .otherwise(F.lit(0.0))
        )
    return df.withColumn(out, clip(F.coalesce(val, F.lit(0.0)), 0.0, 100.0))


def discount_pct(df: DataFrame, src: str = "disc_perc") -> DataFrame:
    """Fraction form (decision D1: percent/100, clipped 0..1), flag and square."""
    pct = clip(F.coalesce(F.col(src), F.lit(0.0)) / F.lit(100.0), 0.0, 1.0)
    return (
        df.withColumn("discount_pct", pct)
        .withColumn("is_discounted", (F.col("discount_pct") > 0).cast("int"))
        .withColumn("discount_pct_squared", F.pow(F.col("discount_pct"), F.lit(2.0)))
    )
