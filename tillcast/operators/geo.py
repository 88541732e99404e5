"""City → state → region classification (broadcast lookups on fixed dimensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: city → state and state → region lookup tables ---
CITY_TO_STATE = [
    ("MUMBAI", "MAHARASHTRA"),
    ("DELHI", "DELHI"),
    ("BANGALORE", "KARNATAKA"),
    ("HYDERABAD", "TELANGANA"),
    ("CHENNAI", "TAMIL NADU"),
    ("KOLKATA", "WEST BENGAL"),
    ("PUNE", "MAHARASHTRA"),
    ("AHMEDABAD", "GUJARAT"),
    ("JAIPUR", "RAJASTHAN"),
    ("LUCKNOW", "UTTAR PRADESH"),
]
STATE_TO_REGION = [
    ("MAHARASHTRA", "WEST"),
    ("DELHI", "NORTH"),
    ("KARNATAKA", "SOUTH"),
    ("TELANGANA", "SOUTH"),
    ("TAMIL NADU", "SOUTH"),
    ("WEST BENGAL", "EAST"),
    ("GUJARAT", "WEST"),
    ("RAJASTHAN", "NORTH"),
    ("UTTAR PRADESH", "NORTH"),
]
# ---------------------------------------------------------------------


def geo_classify(stores_df: DataFrame, city: str = "city") -> DataFrame:
    """Add ``state`` and ``region_classified``; unmapped cities get NULL (exact, case-sensitive keys)."""
    spark = stores_df.sparkSession
    c2s = spark.createDataFrame(CITY_TO_STATE, "_city string, state string")
    s2r = spark.createDataFrame(STATE_TO_REGION, "state string, region_classified string")
    out = stores_df.join(F.broadcast(c2s), F.col(city) == F.col("_city"), "left").drop("_city")
    return out.join(F.broadcast(s2r), "state", "left")


def city_state_sql() -> str:
    rows = ", ".join(f"('{c}', '{s}')" for c, s in CITY_TO_STATE)
    return f"SELECT * FROM (VALUES {rows}) AS c2s(_city, state)"


def state_region_sql() -> str:
    rows = ", ".join(f"('{s}', '{r}')" for s, r in STATE_TO_REGION)
    return f"SELECT * FROM (VALUES {rows}) AS s2r(state, region_classified)"
