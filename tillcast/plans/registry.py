"""Query registry: key → (Spark builder, DuckDB oracle SQL, rounded columns).

Each Spark builder takes (spark, sf_dir) and returns a lazy DataFrame over
the given tables.  Computed doubles listed in ``dbl`` are rounded to four
decimals as round(x*1e4)/1e4 on both sides, so summation order (Spark vs
DuckDB) cannot change the compared value.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions.columns import round4, round_fixed


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    dbl: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def _normalise(df: DataFrame, dbl) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        if f.name in dbl:
            k = dbl[f.name]
            c = round4(c.cast("double")) if k is None else round_fixed(c.cast("double"), k)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None, dbl: str | tuple = ()):
    toks = dbl.split() if isinstance(dbl, str) else list(dbl)
    dbl_t = tuple(toks)
    dbl_map = {t.split(":")[0]: (int(t.split(":")[1]) if ":" in t else None) for t in toks}

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _normalise(fn(spark, sf_dir), dbl_map)

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, sql, dbl_t)
        return fn

    return deco


def sql_round(c: str) -> str:
    """DuckDB twin of ``functions.columns.round4``."""
    x = f"CAST({c} AS DOUBLE)"
    return (f"CASE WHEN abs({x}) >= 1e6 THEN round({x}) "
            f"WHEN abs({x}) >= 1e3 THEN round({x} * 100.0) / 100.0 "
            f"WHEN abs({x}) >= 1.0 THEN round({x} * 10000.0) / 10000.0 "
            f"ELSE round({x} * 1000000.0) / 1000000.0 END + 0.0")


def oracle(q: Query) -> str | None:
    if q.sql is None:
        return None
    if not q.dbl:
        return q.sql
    parts = []
    for t in q.dbl:
        c, _, k = t.partition(":")
        if k:
            m = float(10 ** int(k))
            parts.append(f"round(CAST({c} AS DOUBLE) * {m}) / {m} + 0.0 AS {c}")
        else:
            parts.append(f"{sql_round(c)} AS {c}")
    repl = ", ".join(parts)
    return f"SELECT * REPLACE ({repl}) FROM (\n{q.sql}\n) AS oracle_q"
