"""Column-expression helpers.

All of these build JVM-side expressions (no Python on executors), so they
stay inside whole-stage codegen.  ANSI mode is on in Spark 4, so every
division goes through ``try_divide`` (NULL on a zero denominator) and NaN /
infinity are turned into NULL before aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_or",
    "safe_div",
    "clip",
    "finite",
    "zero_if_bad",
    "cyc_sin",
    "cyc_cos",
    "round4",
    "bucket_right_closed",
    "bucket_left_closed",
    "two_pi",
    "xavg",
    "xsum",
]

two_pi = 2.0 * math.pi


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (pandas gives inf/NaN there)."""
    return F.try_divide(col_or(num), col_or(den))


def clip(c, lo=None, hi=None) -> Column:
    """Like ``Series.clip``: NULL stays NULL (``greatest``/``least`` would skip it)."""
    x = col_or(c)
    out = x
    if lo is not None:
        out = F.when(out < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(hi), F.lit(hi)).otherwise(out)
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def finite(c) -> Column:
    """NaN and ±inf → NULL."""
    x = col_or(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def zero_if_bad(c) -> Column:
    """NULL / NaN / ±inf → 0 (the reference's final ``replace(inf).fillna(0)``)."""
    return F.coalesce(finite(c), F.lit(0.0))


def cyc_sin(c, period: float, harmonic: int = 1) -> Column:
    return F.sin(F.lit(two_pi * harmonic) * col_or(c) / F.lit(float(period)))


def cyc_cos(c, period: float, harmonic: int = 1) -> Column:
    return F.cos(F.lit(two_pi * harmonic) * col_or(c) / F.lit(float(period)))


def round4(c) -> Column:
    """Magnitude-tiered rounding for result comparison across engines.

    |x| ≥ 1e6 → integer, ≥ 1e3 → 2 decimals, ≥ 1 → 4 decimals, else 6 decimals,
    each as round(x·10^k)/10^k, which Spark and DuckDB evaluate identically.
    The step stays ~1e-7 of the value or coarser, so summation-order noise
    (~1e-15 relative) almost never straddles a rounding boundary.
    """
    x = col_or(c)
    a = F.abs(x)

    def r(k):
        m = F.lit(float(10 ** k))
        return F.round(x * m, 0) / m

    # "+ 0.0" turns a rounded -0.0 into 0.0 (IEEE), which both engines then print alike
    return F.when(a >= 1e6, F.round(x, 0)).when(a >= 1e3, r(2)).when(a >= 1.0, r(4)).otherwise(r(6)) + F.lit(0.0)


def round_fixed(c, k: int) -> Column:
    """Round to k decimals as round(x·10^k)/10^k (+0.0 to drop the sign of zero)."""
    m = F.lit(float(10 ** k))
    return F.round(col_or(c) * m, 0) / m + F.lit(0.0)


def bucket_right_closed(x, edges) -> Column:
    """Index of the right-closed bucket (e_{i-1}, e_i] holding x, given an ARRAY of sorted edges.

    Equals ``pd.qcut(..., labels=False, duplicates='drop')`` once the edges are
    exact quantiles: count of distinct *inner* edges strictly below x.
    The first bucket is closed on the left too (pandas ``include_lowest``).
    """
    return bucket_of_inner(x, inner_edges(edges))


def inner_edges(edges) -> Column:
    """The distinct edges without the outer two."""
    e = F.array_distinct(col_or(edges))
    return F.slice(e, 2, F.greatest(F.size(e) - 2, F.lit(0)))


def bucket_of_inner(x, inner) -> Column:
    """``bucket_right_closed`` of a table that holds the ``inner_edges`` already (one row, not one call per row)."""
    return F.when(col_or(x).isNull(), F.lit(None)).otherwise(F.size(F.filter(col_or(inner), lambda v: v < col_or(x))))


def bucket_left_closed(x, edges) -> Column:
    """Index of the left-closed bucket [e_i, e_{i+1}) (sklearn KBinsDiscretizer / np.digitize).

    Values past the outer edges fall into the first / last bucket.
    """
    e = F.array_distinct(col_or(edges))
    inner = F.slice(e, 2, F.greatest(F.size(e) - 2, F.lit(0)))
    return F.when(col_or(x).isNull(), F.lit(None)).otherwise(
        F.size(F.filter(inner, lambda v: v <= col_or(x)))
    )


def finite(c) -> Column:
    """The value as a double, or NULL where it is NaN or infinite (as after the reference's clean-up)."""
    x = col_or(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


MONEY_DECIMAL = "decimal(38,6)"


MICRO = 1_000_000.0


def xsum(c, over=None) -> Column:
    """Order-independent sum of a money column, cast to DOUBLE once.

    Double sums depend on the order rows arrive in (i.e. on partitioning);
    these give the same bits on any cluster layout.  Aggregates over groups
    of unknown size sum DECIMAL(38,6).  Window frames here are per-store
    frames (bounded by one store's history), so they sum exact LONG
    micro-units (money has at most 6 decimals), which is the same exact
    value and much cheaper than a BigDecimal per row and frame; an
    overflow would raise under ANSI, never wrap.
    """
    if over is None:
        return F.sum(finite(c).cast(MONEY_DECIMAL)).cast("double")
    micro = F.round(finite(c) * F.lit(MICRO), 0).cast("long")
    return F.sum(micro).over(over).cast("double") / F.lit(MICRO)


def xavg(c, over=None) -> Column:
    """Mean of a money column as xsum / count of its finite values (NULL on an empty frame)."""
    n = F.count(finite(c))
    if over is not None:
        n = n.over(over)
    return F.try_divide(xsum(c, over), n.cast("double"))


def round2(c) -> Column:
    """Round to 2 decimals as round(x·100)/100 (half away from zero)."""
    return F.round(col_or(c) * F.lit(100.0), 0) / F.lit(100.0)
