"""The tasks of the rollup and of per-store windows hold a bounded number of rows, whatever the session's shuffle settings."""

from pyspark.sql import functions as F


def _shuffles_of_two(spark, monkeypatch, rows):
    from tillcast.operators import partitions

    monkeypatch.setattr(partitions, "ROWS_PER_TASK", rows)
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_rollup_partitions_follow_the_line_items(spark, sf_dir, monkeypatch):
    from tillcast.sources import driver

    want = sorted(map(tuple, driver.sales(spark, sf_dir).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        _shuffles_of_two(spark, monkeypatch, 100)
        got = driver.sales(spark, sf_dir).withColumn("_p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() / 100
    assert sorted(tuple(r)[:-1] for r in got) == want
    assert len({r["_p"] for r in got}) > n / 2  # a few of n may be empty


def test_window_partitions_follow_the_store_days(spark, sf_dir, monkeypatch):
    from tillcast.plans import base, catalog

    days = base.daily(spark, sf_dir).count()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("interval_spread", "band_sort", "rolling_rank30", "median90", "store_baselines", "clean_matrix"):
        query = catalog.queries()[name]
        want = sorted(map(tuple, query(spark, sf_dir).collect()))
        try:
            with monkeypatch.context() as m:
                _shuffles_of_two(spark, m, 100)
                got = query(spark, sf_dir)
                assert got.rdd.getNumPartitions() == -(-days // 100), name
                assert sorted(map(tuple, got.collect())) == want, name
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
