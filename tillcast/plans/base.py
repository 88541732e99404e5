"""Spark side of the shared base relations (mirrors ``sqlbase.PREFIX``).

As in the reference's workflow (upload → roll up once → every report reads
the processed table), the daily table is computed once per input folder and
written as Parquet into the shared folder; every report and feature query
reads the columns it needs of that copy.  The rollup and flagship queries
still run from the raw line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillcast.operators.calendar import calendar_parts
from tillcast.operators.joins import join_store
from tillcast.operators.partitions import dealt
from tillcast.operators.rollup import disc_perc
from tillcast.session import input_version, written
from tillcast.sources import driver

STORE_ATTRS = ["channel", "city", "region", "is_online", "store_area", "store_cluster"]
_DAILY: dict = {}


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver.sales(spark, sf_dir)


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver.stores(spark, sf_dir)


def daily_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales ⟕ stores + calendar parts + guarded discount percent (lazy)."""
    return (
        driver.sales(spark, sf_dir)
        .transform(lambda d: join_store(d, driver.stores(spark, sf_dir)))
        .transform(calendar_parts)
        .transform(lambda d: disc_perc(d, guarded=True))
    )


def version(spark: SparkSession, sf_dir: str) -> tuple:
    """State of the input files that the base relations read; a changed input has another one."""
    return input_version(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed daily table, written once per (application, input folder, input version)."""
    return _daily(spark, sf_dir)[0]


def daily_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``daily`` with whole stores in partitions of a bounded number of rows, as per-store windows read it."""
    return dealt(*_daily(spark, sf_dir), "store")


def _daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir))
    if key not in _DAILY:
        table = written(daily_plan(spark, sf_dir), "daily")
        _DAILY[key] = table, table.count()
    return _DAILY[key]
