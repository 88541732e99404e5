"""Streaming rollup equals the batch rollup; file sources, mapping and validation."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tillcast.sources import driver
from tillcast.sources import files as FS
from tillcast.streaming import rollup as SR


def test_stream_rollup_matches_batch(spark, sf_dir):
    raw = driver.raw_sales(spark, sf_dir).withColumn("_part", F.pmod(F.hash("store", "date"), F.lit(2)))
    src = tempfile.mkdtemp(prefix="tillcast-src-")
    out = tempfile.mkdtemp(prefix="tillcast-tab-")
    ck = tempfile.mkdtemp(prefix="tillcast-ck-")
    raw.where("_part = 0").drop("_part").write.mode("overwrite").parquet(f"{src}/a")
    q = SR.start(spark, f"{src}/*", out, ck)
    q.awaitTermination(300)
    raw.where("_part = 1").drop("_part").write.mode("overwrite").parquet(f"{src}/b")
    q = SR.start(spark, f"{src}/*", out, ck)  # restart from the checkpoint: only the new file is read
    q.awaitTermination(300)
    got = SR.read_rollup(spark, out)
    want = driver.sales(spark, sf_dir).select("store", "date", F.col("revenue").alias("want_revenue"))
    diff = got.join(want, ["store", "date"], "full_outer").where(
        F.col("revenue").isNull() | F.col("want_revenue").isNull()
        | (F.abs(F.col("revenue") - F.col("want_revenue")) > 1e-6)).count()
    assert diff == 0 and got.count() == want.count()


def test_csv_sales_source_and_parse(spark):
    d = tempfile.mkdtemp(prefix="tillcast-csv-")
    with open(f"{d}/sales.csv", "w") as f:
        f.write("store,date,qty_sold,revenue,disc_value\n1,2020-02-29,2,100.5,10\n2,2020-03-01 10:00:00,1,,0\n3,not-a-date,1,5,0\n")
    df = FS.read_sales(spark, f"{d}/sales.csv").orderBy("store").collect()
    assert str(df[0]["date"]) == "2020-02-29" and df[0]["revenue"] == 100.5
    assert str(df[1]["date"]) == "2020-03-01" and df[1]["revenue"] is None
    assert df[2]["date"] is None


def test_mapping_renames(spark):
    df = spark.createDataFrame([(1, "x")], "Store_ID int, Sale_Date string")
    assert FS.apply_mapping(df, {"Store_ID": "store", "Sale_Date": "date"}).columns == ["store", "date"]


def test_validate_input_rejects_empty_and_missing(spark):
    with pytest.raises(ValueError):
        FS.validate_input(spark.createDataFrame([], "store string, revenue double"))
    with pytest.raises(ValueError):
        FS.validate_input(spark.createDataFrame([("1",)], "store string"))
