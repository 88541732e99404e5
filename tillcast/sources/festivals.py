"""Festival calendar dimension (2015-2030).

The calendar is a small fixed dimension (7 dates per year, 112 rows), so it
is created as a literal DataFrame and broadcast.  Users with their own
calendar pass it to ``read_festivals`` instead.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FIRST_YEAR = 2015
LAST_YEAR = 2030

# --- Fixed values (must equal the published festival calendar) -------------
# Festivals on the same day every year, as (month, day, name).
FIXED_DATE_FESTIVALS = [
    (1, 1, "New Year"),
    (1, 26, "Republic Day"),
    (12, 25, "Christmas"),
]

# Festivals whose date moves, one date per year 2015..2030, in year order.
MOVABLE_FESTIVALS = {
    "Holi": [
        "2015-03-06", "2016-03-24", "2017-03-13", "2018-03-02", "2019-03-21", "2020-03-10",
        "2021-03-29", "2022-03-18", "2023-03-08", "2024-03-25", "2025-03-14", "2026-03-04",
        "2027-03-22", "2028-03-11", "2029-03-01", "2030-03-20",
    ],
    "Rakhi": [
        "2015-08-29", "2016-08-18", "2017-08-07", "2018-08-26", "2019-08-15", "2020-08-03",
        "2021-08-22", "2022-08-11", "2023-08-30", "2024-08-19", "2025-08-09", "2026-08-28",
        "2027-08-18", "2028-08-06", "2029-08-23", "2030-08-13",
    ],
    "Eid": [
        "2015-07-18", "2016-07-07", "2017-06-26", "2018-06-15", "2019-06-05", "2020-05-25",
        "2021-05-14", "2022-05-03", "2023-04-22", "2024-04-10", "2025-03-30", "2026-03-20",
        "2027-03-09", "2028-02-26", "2029-02-14", "2030-02-04",
    ],
    "Diwali": [
        "2015-11-11", "2016-10-30", "2017-10-19", "2018-11-07", "2019-10-27", "2020-11-14",
        "2021-11-04", "2022-10-24", "2023-11-12", "2024-11-01", "2025-10-20", "2026-11-08",
        "2027-10-29", "2028-10-17", "2029-11-05", "2030-10-26",
    ],
}
# ---------------------------------------------------------------------------

FESTIVAL_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType(), False), T.StructField("festival", T.StringType(), False)]
)


def festival_rows() -> list[tuple[_dt.date, str]]:
    rows = []
    for year in range(FIRST_YEAR, LAST_YEAR + 1):
        for month, day, name in FIXED_DATE_FESTIVALS:
            rows.append((_dt.date(year, month, day), name))
    for name, dates in MOVABLE_FESTIVALS.items():
        for d in dates:
            rows.append((_dt.date.fromisoformat(d), name))
    rows.sort()
    return rows


def festivals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(festival_rows(), FESTIVAL_SCHEMA)


def festivals_sql_values() -> str:
    """The same calendar as a DuckDB/ANSI ``VALUES`` list (for oracle queries)."""
    vals = ", ".join(f"(DATE '{d.isoformat()}', '{n}')" for d, n in festival_rows())
    return f"SELECT * FROM (VALUES {vals}) AS f(date, festival)"
