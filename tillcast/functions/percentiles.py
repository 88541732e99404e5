"""Exact percentiles of columns of any size by radix descent.

Every wanted rank starts with the range [min, max] of its group.  One pass counts the rows of each range in at
most ``CELLS`` + 1 cells, which are runs of an order-preserving 64-bit code of the doubles; the cell that holds
the rank, narrowed to the smallest and largest value in it, is the range of the next pass.  A rank is settled
once its range holds one value.  A pass shrinks the code range ``CELLS``-fold, so at most six are needed, in
practice two or three.  Nothing that is held, shuffled or broadcast grows with the number of rows: a pass sends
at most CELLS + 1 counts per range and task, ties are one cell, and there is no fallback that collects a group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 12
CELLS = 1 << CELL_BITS
MAX_PASSES = 8
#: Wanted ranks (times groups) up to which their table goes through the driver between two passes; beyond it is
#: checkpointed, and beyond the second number the open ranges (a few numbers each) are no longer broadcast.
DRIVER_RANKS, BROADCAST_RANKS = 4_096, 500_000

# The IEEE 754 double format.
MANTISSA = 52
MIN_NORMAL = 2.0**-1022
MAX_FINITE = 1.7976931348623157e308


def double_code(v: Column) -> Column:
    """The bits of a double as a bigint in the order of the values; both zeros are 0.  NaN isn't allowed."""
    a = F.abs(v)
    near = F.floor(F.log2(a)).cast("int")  # off by one at most, close to powers of two
    part = a / F.pow(F.lit(2.0), near)
    e = near + F.when(part >= 2.0, 1).when(part < 1.0, -1).otherwise(0)
    normal = F.shiftleft((e + 1023).cast("bigint"), MANTISSA) + ((a / F.pow(F.lit(2.0), e) - 1.0) * 2.0**MANTISSA).cast("bigint")
    code = (F.when(a < MIN_NORMAL, (a * 2.0**537 * 2.0**537).cast("bigint"))
            .when(a > MAX_FINITE, F.lit(2047 << MANTISSA)).otherwise(normal))
    return F.when(v < 0, -code).otherwise(code)


def shift_for(lo: Column, hi: Column) -> Column:
    """The number of low code bits to drop, so that [lo, hi] spans at most CELLS + 1 cells."""
    half = F.shiftright(hi, 1) - F.shiftright(lo, 1)  # the whole difference may not fit 63 bits
    return F.greatest(F.lit(0), F.length(F.bin(half)) + 1 - CELL_BITS).cast("int")


def open_ranges(state: DataFrame, by) -> DataFrame:
    """The ranges that unsettled ranks are in, with their shift."""
    r = state.where("_lo < _hi").select(*by, "_lo", "_hi", "_base")
    return r.withColumn("_s", shift_for(double_code(F.col("_lo")), double_code(F.col("_hi"))))


def cell_counts(src: DataFrame, ranges: DataFrame, by) -> DataFrame:
    """(by, _lo, _hi, _base, _cell, _n, _min, _max): the rows of every range, counted in its cells."""
    same = reduce(and_, [F.col(f"s.`{c}`") == F.col(f"r.`{c}`") for c in by])
    inside = (F.col("s._v") >= F.col("r._lo")) & (F.col("s._v") <= F.col("r._hi"))  # ranges of a group are disjoint
    rows = src.alias("s").join(ranges.alias("r"), same & inside)
    cell = F.call_function("shiftright", double_code(F.col("_v")), F.col("_s")).alias("_cell")
    rows = rows.select(*[F.col(f"s.`{c}`") for c in by], "_v", "_lo", "_hi", "_base", cell)
    return rows.groupBy(*by, "_lo", "_hi", "_base", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))


def narrowed(state: DataFrame, cells: DataFrame, by) -> DataFrame:
    """The unsettled ranks of ``state`` in the cells that hold them."""
    w = Window.partitionBy(*by, "_lo", "_hi").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS + 1 rows at most
    cells = cells.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
    cells = cells.select(*by, "_lo", "_hi", "_before", F.col("_n").alias("_rows"), "_min", "_max")
    hit = state.where("_lo < _hi").join(cells, [*by, "_lo", "_hi"]).where("_before <= _rank AND _rank < _before + _rows")
    return hit.select(*by, "n", "_t", "_rank", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_before").alias("_base"))


def exact_percentiles(df: DataFrame, value: str, probs, by=(), prefix: str = "q") -> DataFrame:
    """Exact linear-interpolation percentiles of ``value`` per group, without one task holding a group.

    The values are written once, in one narrow table, and each pass reads only that.  NULL and NaN are skipped,
    groups with a null key are left out.  Output: ``by`` columns, ``n`` and one column ``{prefix}{i}`` per prob."""
    from tillcast.session import cut_lineage, written

    probs, by = [float(p) for p in probs], list(by)
    whole = not by
    if whole:
        by, df = ["_g"], df.withColumn("_g", F.lit(0))
    v = F.col(value).cast("double") + 0.0  # one zero
    src = written(df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")), "values")

    def ranks(p: float):
        pos = F.lit(p) * (F.col("n") - 1)
        return F.floor(pos).cast("bigint"), F.ceil(pos).cast("bigint"), pos

    wanted = [k for p in probs for k in ranks(p)[:2]]
    state = src.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = state.select(*by, "n", F.posexplode(F.array(*wanted)).alias("_t", "_rank"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_base"))
    state = cut_lineage(state)
    n_ranks = state.count()

    small = n_ranks <= DRIVER_RANKS

    def kept(state: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """The table of ranks cut from its lineage, its open ranges, and whether there are any."""
        if not small:
            state = cut_lineage(state)
            return state, open_ranges(state, by).dropDuplicates(), not state.where("_lo < _hi").isEmpty()
        rows = state.collect()
        state = F.broadcast(df.sparkSession.createDataFrame(rows, state.schema))
        some = {(*[r[c] for c in by], r["_base"]): r for r in rows if r["_lo"] < r["_hi"]}
        return state, open_ranges(df.sparkSession.createDataFrame(list(some.values()), state.schema), by), bool(some)

    state, ranges, some = kept(state)
    for _ in range(MAX_PASSES):
        if not some:
            break
        cells = cell_counts(src, F.broadcast(ranges) if n_ranks <= BROADCAST_RANKS else ranges, by)
        state, ranges, some = kept(state.where("_lo = _hi").unionByName(narrowed(state, cells, by)))
    else:
        raise RuntimeError(f"percentiles of {value} did not settle in {MAX_PASSES} passes")

    at = state.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("_t") == i, F.col("_lo"))).alias(f"_t{i}") for i in range(len(wanted))])
    outs = []
    for i, p in enumerate(probs):
        k0, k1, pos = ranks(p)
        v0, v1, frac = F.col(f"_t{2 * i}"), F.col(f"_t{2 * i + 1}"), pos - k0
        outs.append(F.when(k0 == k1, v0).otherwise((F.lit(1.0) - frac) * v0 + frac * v1).alias(f"{prefix}{i}"))
    res = at.select(*by, "n", *outs)
    return res.drop("_g") if whole else res
