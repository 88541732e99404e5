"""Shared CTE prefix of every oracle query (DuckDB dialect).

It re-derives, independently of the Spark code, the same ``sales``,
``stores``, ``festivals`` and ``daily`` (sales ⟕ stores + calendar + discount)
relations from the pre-registered driver views.
"""

from __future__ import annotations

from tillcast.sources.driver import CHANNELS, OFFLINE_CLUSTERS, YEARS_SHIFT_MONTHS
from tillcast.sources.festivals import festivals_sql_values


def _list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


PREFIX = f"""WITH sales AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS store,
         CAST(CAST(l_shipdate AS DATE) + INTERVAL {YEARS_SHIFT_MONTHS} MONTH AS DATE) AS date,
         COALESCE(CAST(SUM(l_quantity) AS DOUBLE), 0.0) AS qty_sold,
         COALESCE(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(6,4)))) AS DOUBLE), 0.0) AS revenue,
         COALESCE(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(6,4))) AS DOUBLE), 0.0) AS disc_value
  FROM lineitem
  GROUP BY 1, 2
), stores AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id,
         ({_list(CHANNELS)})[CAST(s_suppkey % 3 AS INTEGER) + 1] AS channel,
         n_name AS city,
         r_name AS region,
         CAST(s_suppkey % 3 = 0 AS INTEGER) AS is_online,
         1000.0 + abs(s_acctbal) / 2.0 AS store_area,
         CASE WHEN s_suppkey % 3 = 0 THEN 'ONLINE'
              ELSE ({_list(OFFLINE_CLUSTERS)})[CAST(s_suppkey % 4 AS INTEGER) + 1] END AS store_cluster
  FROM supplier
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
), festivals AS (
  {festivals_sql_values()}
), daily AS (
  SELECT s.store, s.date, s.qty_sold, s.revenue, s.disc_value,
         st.channel, st.city, st.region, st.is_online, st.store_area, st.store_cluster,
         year(s.date) AS year, month(s.date) AS month, day(s.date) AS day,
         isodow(s.date) - 1 AS day_of_week, quarter(s.date) AS quarter,
         CAST(isodow(s.date) >= 6 AS INTEGER) AS is_weekend,
         dayofyear(s.date) AS day_of_year, weekofyear(s.date) AS week_of_year,
         CASE WHEN s.revenue + s.disc_value > 0
              THEN LEAST(GREATEST(s.disc_value * 100.0 / (s.revenue + s.disc_value), 0.0), 100.0)
              ELSE 0.0 END AS disc_perc
  FROM sales s LEFT JOIN stores st ON s.store = st.id
)"""


def sql(body: str) -> str:
    """PREFIX followed by ``body`` (either ``SELECT ...`` or ``, more_ctes AS (...) SELECT ...``)."""
    body = body.strip()
    sep = "\n" if body.startswith(",") else "\n"
    return PREFIX + sep + body


def recursive(body: str) -> str:
    """``sql`` whose further CTEs may refer to themselves."""
    return sql(body).replace("WITH sales", "WITH RECURSIVE sales", 1)


def over(o: str) -> str:
    return f" OVER {o}" if o else ""


def XSUM(x: str, o: str = "") -> str:
    """DuckDB twin of ``functions.columns.xsum``."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(38,6))){over(o)} AS DOUBLE)"


def XAVG(x: str, o: str = "") -> str:
    """DuckDB twin of ``functions.columns.xavg``."""
    return f"({XSUM(x, o)} / CAST(NULLIF(COUNT({x}){over(o)}, 0) AS DOUBLE))"
