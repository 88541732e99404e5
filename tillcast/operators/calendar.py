"""Calendar parts and cyclic encodings (pure projections, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.columns import cyc_cos, cyc_sin


def calendar_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """year, month, day, day_of_week (Monday = 0), quarter, is_weekend, day_of_year, ISO week."""
    d = F.col(date)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day": F.dayofmonth(d),
            "day_of_week": F.weekday(d),
            "quarter": F.quarter(d),
            "is_weekend": (F.weekday(d) >= 5).cast("int"),
            "day_of_year": F.dayofyear(d),
            "week_of_year": F.weekofyear(d),
        }
    )


def cyclic_1(df: DataFrame) -> DataFrame:
    """First harmonic of weekday/7 and month/12."""
    return df.withColumns(
        {
            "day_of_week_sin": cyc_sin("day_of_week", 7),
            "day_of_week_cos": cyc_cos("day_of_week", 7),
            "month_sin": cyc_sin("month", 12),
            "month_cos": cyc_cos("month", 12),
        }
    )


def cyclic_23(df: DataFrame) -> DataFrame:
    """Second and third harmonics of day-of-year/365 and ISO week/52."""
    cols = {}
    for h in (2, 3):
        cols[f"day_of_year_sin{h}"] = cyc_sin("day_of_year", 365, h)
        cols[f"day_of_year_cos{h}"] = cyc_cos("day_of_year", 365, h)
        cols[f"week_of_year_sin{h}"] = cyc_sin("week_of_year", 52, h)
        cols[f"week_of_year_cos{h}"] = cyc_cos("week_of_year", 52, h)
    return df.withColumns(cols)


def festival_season(df: DataFrame, discount: str = "discount_pct") -> DataFrame:
    """Festival season (Oct-Feb) flag and its product with the discount."""
    flag = F.col("month").isin(10, 11, 12, 1, 2).cast("int")
    return df.withColumn("is_festival_season", flag).withColumn(
        "festival_discount_interaction", F.col("is_festival_season") * F.col(discount)
    )


def weekend_discount(df: DataFrame, discount: str = "discount_pct") -> DataFrame:
    return df.withColumn("weekend_discount_interaction", F.col("is_weekend") * F.col(discount))
