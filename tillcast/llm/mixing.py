"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

DataFrame functions only.  The level λ solves Σ min(cap_s, λ·w_s) = budget: sources above their cap are
clamped, the rest of the budget is shared again by weight, until no further source is above.  Only three sums
per round reach the driver; the number of rounds is at most the number of sources and in practice a few.

Each source then takes every document ``whole`` times, and once more a seeded fraction of them: documents in
the order of a hash, up to the one whose middle crosses the rest of the target.  The crossing is found by sums
over hash buckets, then over the finer buckets of the one that holds it, and then inside one fine bucket per source
(a 16-millionth of it), so a source of any size is never ordered by one task.  Rows that repeat id and text share
a hash; where the crossing lies among them, they are numbered over a range partitioning and as many as fit are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.quantiles import rank_within
from tillcast.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix"
#: Hex digits of the order hash that name a bucket, coarse and fine: 16^3 buckets each time for one task to add up.
BUCKET_DIGITS = (3, 6)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(id_: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), id_.cast("string"), F.md5(text.cast("binary"))))


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(id, source, nosrc, src, size, key): what mixing needs of each row, without the text.

    ``src``/``nosrc`` stand for the source in joins: null is a source of its own, apart from the empty string."""
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    return df.select(
        F.col(id_col).alias("id"), source.alias("source"), source.isNull().alias("nosrc"), F.coalesce(source, F.lit("")).alias("src"),
        n_words(text).alias("size"), order_key(F.col(id_col), text, seed).alias("key"))


def mixture(rows: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of ``rows`` (see ``sized``; read several times, so pass a written table):
    src, nosrc, source_size, weight, target, whole, cut.

    Sources in code point order, null last, have the weights in turn, repeating.  ``budget`` is a share of all
    sizes; no target exceeds ``max_epochs`` times its source.  A document is taken ``whole`` times and, where
    its key is at most ``cut``, once more.  Sources without words have target 0; an empty table gives none."""
    by = ["nosrc", "src"]
    src = materialize(rows.groupBy(*by).agg(F.sum("size").alias("source_size")), "sources")
    src = rank_within(src, None, ["nosrc", "src"], out="_rank", index_out="_pos").drop("_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    src = materialize(src.select(*by, "source_size", w.alias("weight"), (F.col("source_size") * max_epochs).alias("cap")), "weights")

    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("cap")
        got = src.agg(
            F.sum("source_size").alias("total"), F.sum(over.cast("int")).alias("n"), F.count(F.lit(1)).alias("of"),
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        if not got["of"] or got["n"] == clamped or got["n"] == got["of"]:
            break
        clamped, level = got["n"], (budget * got["total"] - got["caps"]) / got["weights"]
    target = F.least(F.col("cap").cast("double"), F.lit(level or 0.0) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    src = materialize(src.withColumn("target", target).withColumn("whole", whole)
                      .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    # The bucket in which the rest of the target ends, ever finer; buckets before it are taken whole.
    edge, inside = src.select(*by, "rest", F.lit("").alias("bucket"), F.lit(0).cast("bigint").alias("before")), rows
    for digits in BUCKET_DIGITS:
        cells = inside.join(edge, by) if digits == BUCKET_DIGITS[0] else inside.withColumn("bucket", F.substring("key", 1, digits - 3)).join(edge, [*by, "bucket"])
        sums = cells.withColumn("bucket", F.substring("key", 1, digits)).groupBy(*by, "bucket").agg(
            F.sum("size").alias("b_size"), F.first("rest").alias("rest"), F.first("before").alias("base"))
        upto = F.col("base") + F.sum("b_size").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("b_size")
        sums = sums.withColumn("before", upto).where("before <= rest AND rest <= before + b_size")
        edge = materialize(sums.groupBy(*by).agg(F.min("bucket").alias("bucket"), F.min("rest").alias("rest"), F.min("before").alias("before")), "edges")
    # Inside it, rows with the same hash are equal: of n rows of a size, m fit.
    inside = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS[-1])).join(edge, [*by, "bucket"])
    keys = inside.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    run = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy(*by).orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    keys = keys.withColumn("done", F.col("before") + F.coalesce(run, F.lit(0)))
    one = (F.col("done") * 2 + F.col("size") <= F.col("rest") * 2).cast("bigint")
    fit = F.when((F.col("n") == 1) | (F.col("size") == 0), one * F.col("n")).otherwise(
        F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("rest") - F.col("done")) / F.col("size") + 0.5))).cast("bigint"))
    keys = keys.withColumn("m", fit)
    cut = keys.groupBy(*by).agg(F.max(F.when(F.col("m") == F.col("n"), F.col("key"))).alias("last"),
                                F.max(F.when((F.col("m") > 0) & (F.col("m") < F.col("n")), F.struct("key", "m"))).alias("part"))
    return materialize(
        src.join(edge.select(*by, "bucket"), by, "left").join(cut, by, "left")
        .select(*by, "source_size", "weight", "target", "whole", F.coalesce("last", "bucket").alias("cut"), F.col("part.key").alias("part"), F.col("part.m").alias("fit")), "mixture")


def repetitions(rows: DataFrame, plan: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``rows`` (with nosrc, src and key) and the plan's source_size, target and ``times``: how often the mix
    takes each.

    The plan has a row per source; Spark broadcasts it only while it is below its size threshold.  Equal rows
    at the crossing are written and numbered; there are none unless rows repeat."""
    joined = rows.join(plan.drop("weight"), ["nosrc", "src"])
    part = F.col("key") == F.col("part")
    extra = F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    if plan.where("part IS NOT NULL").isEmpty():
        joined = joined.withColumn("_more", extra)
    else:
        equal = materialize(joined.where(part).withColumn("_mid", F.monotonically_increasing_id()), "equal-rows").withColumn("_group", F.struct("nosrc", "src"))
        equal = rank_within(equal, "_group", ["_mid"], out="_rank", index_out="_nth")
        equal = equal.withColumn("_more", (F.col("_nth") < F.col("fit")).cast("int")).drop("_mid", "_group", "_rank", "_nth")
        joined = joined.where(~F.coalesce(part, F.lit(False))).withColumn("_more", extra).unionByName(equal)
    times = F.least(F.col("whole") + F.col("_more"), F.lit(max_epochs))
    return joined.withColumn("times", times).drop("whole", "cut", "part", "fit", "_more")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """(id, size, source_size, target, taken) of every row of ``df``.

    Null texts have size 0 and are taken with no words; null sources are one source; null ids are ordinary
    rows.  Rows that repeat id and text are taken as often as fits the target, which of them doesn't matter.  Reruns
    give the same rows."""
    rows = materialize(sized(df, id_col, text_col, source_col), "sizes")
    out = repetitions(rows, mixture(rows, **params), params.get("max_epochs", MAX_EPOCHS))
    return out.select("id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("bigint").alias("taken"))


def repeat(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mix itself: each row of ``df`` as often as the plan takes it (0, 1, … times), columns unchanged."""
    rows = materialize(sized(df, id_col, text_col, source_col), "sizes")
    plan = mixture(rows, **params)
    source = F.col(f"_row.`{source_col}`").cast("string")
    text = F.col(f"_row.`{text_col}`").cast("string")
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    wide = wide.select("_row", source.isNull().alias("nosrc"), F.coalesce(source, F.lit("")).alias("src"),
                       order_key(F.col(f"_row.`{id_col}`"), text, SEED).alias("key"))
    out = repetitions(wide, plan, params.get("max_epochs", MAX_EPOCHS)).where("times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_i")).select("_row.*")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), md5(text))) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS BIGINT) AS cap,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest_w
  FROM s WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - caps) / rest_w AS lam FROM c),
l AS (SELECT arg_min(lam, caps) AS lam FROM f WHERE lam * w <= cap),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), lam * w) AS target FROM s, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (whole + CASE WHEN 2 * done + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
