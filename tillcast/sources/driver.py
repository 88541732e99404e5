"""The sales / stores views over the driver's TPC-H-style tables.

``sales``  = lineitem by (supplier, ship date):  a supplier is a store, a
ship date (+20 years, so the dates meet the 2015-2030 festival calendar)
is a business day.  Money is summed as DECIMAL and cast to DOUBLE only
after the sum, which makes the result independent of summation order.

``stores`` = supplier ⋈ nation ⋈ region (a few hundred thousand rows at
100 TB scale, so it is a broadcast-sized dimension only behind a check;
see ``operators.joins.join_store``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.partitions import dealt
from tillcast.operators.rollup import daily_rollup

YEARS_SHIFT_MONTHS = 240

# --- Fixed values: channel and cluster labels assigned to driver suppliers ---
CHANNELS = ["ONLINE", "LFR_LIFESTYLE", "EBO"]          # by s_suppkey % 3; index 0 is online
OFFLINE_CLUSTERS = ["PREMIUM_OFFLINE", "SEASONAL_SPECIALIST", "HOLIDAY_SPECIALIST", "MEDIUM_OFFLINE"]  # by s_suppkey % 4
# ---------------------------------------------------------------------------


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction-level sales: one row per line item (several per store-day)."""
    li = spark.read.parquet(_path(sf_dir, "lineitem"))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = F.col("l_discount").cast("decimal(6,4)")
    return li.select(
        F.col("l_suppkey").cast("string").alias("store"),
        F.add_months(F.to_date("l_shipdate"), YEARS_SHIFT_MONTHS).alias("date"),
        F.col("l_quantity").alias("qty_sold"),
        (price * (F.lit(1) - disc)).alias("revenue"),
        (price * disc).alias("disc_value"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sales: one row per (store, date).

    A store has a few line items a day, so combining them before the shuffle saves nearly no rows, while a task
    holds a group per row it reads; they are dealt first, and a task aggregates a bounded number of them."""
    rows = spark.read.parquet(_path(sf_dir, "lineitem")).count()  # from the files' footers
    return daily_rollup(dealt(raw_sales(spark, sf_dir), rows, "store", "date"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = spark.read.parquet(_path(sf_dir, "supplier"))
    nat = spark.read.parquet(_path(sf_dir, "nation"))
    reg = spark.read.parquet(_path(sf_dir, "region"))
    k3 = F.pmod(F.col("s_suppkey"), F.lit(3)).cast("int")
    k4 = F.pmod(F.col("s_suppkey"), F.lit(4)).cast("int")
    channel = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), k3 + 1)
    offline_cluster = F.element_at(F.array(*[F.lit(c) for c in OFFLINE_CLUSTERS]), k4 + 1)
    return (
        sup.join(nat, sup.s_nationkey == nat.n_nationkey, "left")
        .join(reg, F.col("n_regionkey") == reg.r_regionkey, "left")
        .select(
            F.col("s_suppkey").cast("string").alias("id"),
            channel.alias("channel"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("region"),
            (k3 == 0).cast("int").alias("is_online"),
            (F.lit(1000.0) + F.abs(F.col("s_acctbal")) / F.lit(2.0)).alias("store_area"),
            F.when(k3 == 0, F.lit("ONLINE")).otherwise(offline_cluster).alias("store_cluster"),
        )
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(_path(sf_dir, name))
