"""A fit's partitions are those of the cluster: the histograms that its passes shuffle must not grow with the rows."""

from pyspark.sql import functions as F

from tillcast.models import forest as FO


def test_partitions_do_not_follow_the_shuffle_settings(spark):
    rows = spark.range(20_000).select((F.col("id") % 500).cast("string").alias("store"), F.col("id").alias("date"), F.rand(1).alias("x"))
    want = spark.sparkContext.defaultParallelism
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    seen = []
    try:
        for parts, size in ((8, old["spark.sql.adaptive.advisoryPartitionSizeInBytes"]), (40, "1k")):  # 40: as of a larger table
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            data = FO.training_rows(rows)
            assert data.rdd.getNumPartitions() == want
            seen.append([tuple(r) for r in data.select(F.spark_partition_id(), "store", "date").collect()])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(seen[0]) == sorted(seen[1]) and len(seen[0]) == 20_000
    assert len({(p, s) for p, s, _ in seen[0]}) == 500  # a store is in one partition
    of = {}
    for p, s, d in seen[0]:
        of.setdefault(p, []).append((s, d))
    assert all(v == sorted(v) for v in of.values())
