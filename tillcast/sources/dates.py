"""Dates from text of unknown format: a vote per source over all rows, and a quarantine for what doesn't parse.

Every format is tried on every text in one aggregation, which counts per source (a file, say) how many rows it can
read; text and format are matched by shape first, so a two-digit year is never read as one of four digits.  The
winner of a source reads its rows.  The other formats that won votes read the rows that the winner can't, but not
one that reads day and month the other way round: such a row can't be read consistently and is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values: (format, shape, order of day and month where both are numbers); earlier ones win equal votes.
FORMATS = [
    ("yyyy-MM-dd", r"\d{4}-\d{2}-\d{2}", ""), ("yyyy/MM/dd", r"\d{4}/\d{2}/\d{2}", ""), ("yyyyMMdd", r"\d{8}", ""),
    ("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}", "month"), ("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}", "day"),
    ("M-d-yyyy", r"\d{1,2}-\d{1,2}-\d{4}", "month"), ("d-M-yyyy", r"\d{1,2}-\d{1,2}-\d{4}", "day"),
    ("d.M.yyyy", r"\d{1,2}\.\d{1,2}\.\d{4}", "day"), ("d MMM yyyy", r"\d{1,2} [A-Za-z]{3} \d{4}", ""), ("MMM d, yyyy", r"[A-Za-z]{3} \d{1,2}, \d{4}", ""),
]
TIME = r"[T ]\d{1,2}:\d{2}.*"


def day_of(text: Column) -> Column:
    """The text without a time of day and surrounding blanks; empty text is null."""
    return F.nullif(F.regexp_replace(F.trim(text), TIME + "$", ""), F.lit(""))


def read_as(day: Column, i: int) -> Column:
    fmt, shape, _ = FORMATS[i]
    return F.when(day.rlike(f"^{shape}$"), F.try_to_date(day, fmt))


def votes(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """(by, n, v0 … v9): rows with a text per source, and how many of them each format reads."""
    day = day_of(F.col(col).cast("string"))
    rows = df.select((F.col(by) if by else F.lit(None).cast("string")).alias("_by"), day.alias("_d"))
    return rows.groupBy("_by").agg(F.count("_d").alias("n"), *[F.count(read_as(F.col("_d"), i)).alias(f"v{i}") for i in range(len(FORMATS))])


def ranked_formats(v: DataFrame) -> DataFrame:
    """(by, _formats): the formats with votes, most first, without those that contradict the winner's day and month."""
    listed = F.array(*[F.struct((-F.col(f"v{i}")).alias("votes"), F.lit(i).alias("i"), F.lit(order).alias("order")) for i, (_, _, order) in enumerate(FORMATS)])
    voted = F.array_sort(F.filter(listed, lambda x: x["votes"] < 0))
    ordered = F.filter(voted, lambda x: x["order"] != "")
    way = F.coalesce(F.get(ordered, F.lit(0))["order"], F.lit(""))
    kept = F.transform(F.array(way), lambda w: F.filter(voted, lambda x: (x["order"] == "") | (x["order"] == w)))
    return v.select("_by", F.transform(F.get(kept, F.lit(0)), lambda x: x["i"]).alias("_formats"))


def parsed(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """``df`` with ``col`` as DATE and ``_raw``, the text that it was read from (null texts stay null)."""
    t = df.schema[col].dataType
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df.withColumn("_raw", F.col(col).cast("string")).withColumn(col, F.to_date(F.col(col)))
    from tillcast.operators.joins import maybe_broadcast

    formats = maybe_broadcast(ranked_formats(votes(df, col, by)), materialize=True)  # one row per source
    src = df.withColumn("_raw", F.col(col).cast("string")).withColumn("_by0", F.col(by) if by else F.lit(None).cast("string"))
    j = src.join(formats, F.col("_by0").eqNullSafe(F.col("_by")), "left").withColumn("_day", day_of(F.col("_raw")))
    tried = F.transform("_formats", lambda i: reduce(lambda rest, k: F.when(i == k, read_as(F.col("_day"), k)).otherwise(rest), range(len(FORMATS)), F.lit(None).cast("date")))
    first = F.get(F.filter(tried, lambda d: d.isNotNull()), F.lit(0))
    return j.withColumn(col, first).drop("_by", "_by0", "_formats", "_day")


def parse_with_rejects(df: DataFrame, col: str = "date", by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the rows whose date could be read, as DATE, and the others with their text and the reason.

    Rows without a text are rejected as ``missing``, others as ``unreadable``.  ``by`` names the column whose values
    vote apart (such as the file name); null is a source of its own.  The votes read all rows once."""
    out = parsed(df, col, by)
    bad = out.where(F.col(col).isNull())
    reason = F.when(F.trim("_raw").isNull() | (F.trim("_raw") == ""), "missing").otherwise("unreadable")
    return out.where(F.col(col).isNotNull()).drop("_raw"), bad.withColumn(col, F.col("_raw")).withColumn("reason", reason).drop("_raw")
