"""Daily rollup as a Structured Streaming job (no data is ever dropped as late).

Each micro-batch of newly arrived transaction files is rolled up on its own
inside ``foreachBatch`` (map-side partial aggregation, then one shuffle on
(store, date)) and written as exact DECIMAL partial sums into partition
``batch_id=N`` of a parquet table in the shared folder; a retried batch
overwrites its own partition, so every batch lands exactly once.  There is
no streaming state to grow and no watermark: a store-day that shows up
again months later simply adds another partial.  ``read_rollup`` sums the
partials per store-day, which equals the batch ``daily_rollup`` of every
file seen so far; ``compact`` folds the partials into one base partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.operators.rollup import MEASURES

RAW_SCHEMA = T.StructType([
    T.StructField("store", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("qty_sold", T.DoubleType()), T.StructField("revenue", T.DecimalType(26, 6)),
    T.StructField("disc_value", T.DecimalType(26, 6)),
])
PARTIAL_TYPE = "decimal(38,6)"


def _partials(batch: DataFrame) -> DataFrame:
    return batch.groupBy("store", "date").agg(
        *[F.sum(F.col(m).cast(PARTIAL_TYPE)).alias(m) for m in MEASURES])


def start(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_dir: str, schema: T.StructType = RAW_SCHEMA,
          fmt: str = "parquet", available_now: bool = True):
    def sink(batch: DataFrame, batch_id: int):
        (_partials(batch).withColumn("batch_id", F.lit(batch_id)).write
         .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table_dir))

    src = spark.readStream.format(fmt).schema(schema).load(source_dir)
    w = src.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_rollup(spark: SparkSession, table_dir: str) -> DataFrame:
    t = spark.read.parquet(table_dir)
    return t.groupBy("store", "date").agg(
        *[F.coalesce(F.sum(m).cast("double"), F.lit(0.0)).alias(m) for m in MEASURES])


def compact(spark: SparkSession, table_dir: str, out_dir: str) -> str:
    """Fold all partials into one partition (batch_id = −1) of a new table; readers switch to ``out_dir``."""
    t = spark.read.parquet(table_dir)
    base = t.groupBy("store", "date").agg(*[F.sum(m).cast(PARTIAL_TYPE).alias(m) for m in MEASURES])
    base.withColumn("batch_id", F.lit(-1)).write.mode("overwrite").partitionBy("batch_id").parquet(out_dir)
    return out_dir
