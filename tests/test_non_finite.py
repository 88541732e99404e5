"""NULL, NaN and ±∞ measures: values of grouped and windowed means, and of the rollup."""

import datetime as dt
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillcast.functions.columns import xavg, xsum
from tillcast.operators.rollup import daily_rollup
from tillcast.sources.files import read_festivals


def test_means_skip_non_finite(spark):
    rows = [("a", 1, math.nan), ("a", 2, 1.0), ("b", 1, math.inf), ("b", 2, 1.0), ("c", 1, None), ("c", 2, -math.inf)]
    df = spark.createDataFrame(rows, "store string, k int, revenue double")
    got = {r["store"]: (r["s"], r["m"]) for r in df.groupBy("store").agg(xsum("revenue").alias("s"), xavg("revenue").alias("m")).collect()}
    assert got == {"a": (1.0, 1.0), "b": (1.0, 1.0), "c": (None, None)}
    w = Window.partitionBy("store").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    run = {(r["store"], r["k"]): r["m"] for r in df.select("store", "k", xavg("revenue", w).alias("m")).collect()}
    assert run == {("a", 1): None, ("a", 2): 1.0, ("b", 1): None, ("b", 2): 1.0, ("c", 1): None, ("c", 2): None}


def test_rollup_skips_non_finite(spark):
    d = dt.date(2024, 1, 1)
    rows = [("a", d, 1.0, 2.0, math.nan), ("a", d, math.inf, 3.0, 1.0)]
    r = daily_rollup(spark.createDataFrame(rows, "store string, date date, qty_sold double, revenue double, disc_value double")).first()
    assert (r["qty_sold"], r["revenue"], r["disc_value"]) == (1.0, 5.0, 1.0)


def test_calendar_by_uri_is_read(spark, tmp_path):
    path = tmp_path / "calendar.csv"
    path.write_text("date,festival\n2024-05-01,Own day\n")
    for p in (str(path), path.as_uri()):
        assert [r["festival"] for r in read_festivals(spark, p).collect()] == ["Own day"]
