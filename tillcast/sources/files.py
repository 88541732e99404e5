"""File sources and sinks, column mapping and input validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.operators.rollup import SALES_SCHEMA
from tillcast.sources import dates as DT

STORES_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("channel", T.StringType(), True),
    T.StructField("city", T.StringType(), True), T.StructField("region", T.StringType(), True),
    T.StructField("is_online", T.IntegerType(), True), T.StructField("store_area", T.DoubleType(), True),
])

REQUIRED_SALES = ["store", "date", "qty_sold", "revenue", "disc_value"]


def typed_sales(raw: DataFrame, schema: T.StructType = SALES_SCHEMA, by: str | None = None) -> DataFrame:
    """Sales read as text, typed: dates by the formats that their source votes for, numbers by ``try_cast``.

    ``reason`` names the first column whose text can't be read (else null) and ``_texts`` holds the texts."""
    out = DT.parsed(raw.withColumn("_texts", F.struct(*[F.col(f.name) for f in schema])), "date", by)
    fields = [f for f in schema if f.name != "date"]
    out = out.withColumns({f"_v_{f.name}": F.col(f.name).try_cast(f.dataType) for f in fields})
    bad = [F.when(F.col("date").isNull(), F.lit("date"))]
    bad += [F.when(F.col(f.name).isNotNull() & F.col(f"_v_{f.name}").isNull(), F.lit(f.name)) for f in fields]
    typed = [F.col("date") if f.name == "date" else F.col(f"_v_{f.name}").alias(f.name) for f in schema]
    return out.select(*typed, *([by] if by else []), F.coalesce(*bad).alias("reason"), "_texts")


def read_sales(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = SALES_SCHEMA, rejects: str | None = None) -> DataFrame:
    """Sales with an explicit schema (no inference).  Each CSV file's dates are read by the formats it votes for.

    With ``rejects``, rows with an unreadable date or number are left out and written there (CSV: the texts, the
    file and the column at fault); without it they stay, with NULL for what can't be read."""
    r = spark.read.format(fmt)
    if fmt != "csv":
        return r.schema(schema).load(path)
    raw = r.option("header", True).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).load(path)
    rows = typed_sales(raw.withColumn("file", F.input_file_name()), schema, by="file")
    if rejects:
        rows.where("reason IS NOT NULL").select("_texts.*", "file", "reason").write.option("header", True).csv(rejects)
        rows = rows.where("reason IS NULL")
    return rows.select(*schema.names)


def read_stores(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    df = spark.read.format(fmt).option("header", True).option("inferSchema", False).load(path)
    cols = [F.col(c).cast("string").alias(c) if c in ("id", "channel", "city", "region", "store_cluster") else F.col(c)
            for c in df.columns]
    out = df.select(*cols)
    for c, t in (("is_online", "int"), ("store_area", "double")):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast(t))
    return out


def read_festivals(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Festival calendar from a CSV (date, festival) on any store; without a path, the built-in calendar.

    A path that can't be read raises."""
    from tillcast.sources.festivals import festivals

    if path is None:
        return festivals(spark)
    df = spark.read.option("header", True).csv(path)
    return parse_dates(df, "date").select("date", F.trim("festival").alias("festival")).where(F.col("date").isNotNull())


def parse_dates(df: DataFrame, col: str = "date", by: str | None = None) -> DataFrame:
    """Text or timestamp → DATE by the formats that the texts vote for; NULL where none reads the text.

    ``dates.parse_with_rejects`` gives the unreadable rows apart."""
    t = df.schema[col].dataType
    if isinstance(t, T.DateType):
        return df
    return DT.parsed(df, col, by).drop("_raw")


def apply_mapping(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename uploaded columns (uploaded name → required name)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def validate_input(df: DataFrame, required=("revenue",)) -> DataFrame:
    """Reject an empty table or one without the required columns (cheap: schema + a 1-row probe)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if df.limit(1).count() == 0:
        raise ValueError("input table is empty")
    return df


def write_report(df: DataFrame, path: str, cols, fmt: str = "csv") -> str:
    """Write the selected report columns (one file set per report; header for CSV)."""
    w = df.select(*cols).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
    return path
