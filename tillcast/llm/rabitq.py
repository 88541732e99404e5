"""Near-duplicate embeddings with randomised-rotation binary codes.

A unit vector is rotated by seeded random rotations; the signs are its binary code.  With the first rotation's
code o' = sign(Rx)/√d and the stored factor ⟨o', Rx⟩, the inner product with a vector y is estimated without
bias as ⟨o', Ry⟩/⟨o', Rx⟩, with an error that shrinks as 1/√d.  Pairs whose upper confidence bound stays below
the threshold are done; the others are recomputed exactly, in double precision.

Candidates share BAND_BITS consecutive signs in one of BANDS groups, within one label.  A pair at the
threshold 0.98 misses all bands with a probability of 3·10⁻⁵, a closer pair with less.  Equal vectors collapse
first.  Buckets are dealt into blocks; a unit of work is a pair of blocks of one bucket, and it returns counts
and a spanning forest, never its pairs.  A pair is counted in the first band that both share.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import materialize
from tillcast.llm.components import components

BANDS, BAND_BITS = 24, 16
SEED = 11
#: Half-width of the confidence bound, in multiples of √((1−f²)/f²)/√(d−1).
EPSILON = 5.0
BLOCK = 512
THRESHOLD = 0.98


@lru_cache(maxsize=8)
def rotations(d: int) -> np.ndarray:
    """Enough random rotations of dimension d, stacked, for all bands' bits."""
    rng = np.random.default_rng((SEED, d))
    n = -(-BANDS * BAND_BITS // d)
    return np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(n)])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (scaled by their largest component first, so nothing overflows)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def band_keys(u: np.ndarray) -> np.ndarray:
    """The signs of all rotations in BANDS groups of BAND_BITS bits."""
    bits = (u @ rotations(u.shape[1]).T)[:, : BANDS * BAND_BITS] >= 0
    return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def codes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sign code, correction factor, rotated vector) of unit vectors, by the first rotation."""
    d = u.shape[1]
    r = u @ rotations(d)[:d].T
    code = np.where(r >= 0, 1.0, -1.0) / np.sqrt(d)
    return code.astype(np.float32), (code * r).sum(axis=1), r.astype(np.float32)


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs (p, q) with cosine(a[p], b[q]) >= threshold, and how many pairs were recomputed exactly."""
    code, f, _ = codes(a)
    _, _, turned = codes(b)
    d = a.shape[1]
    width = EPSILON * np.sqrt(np.maximum(1 - f * f, 0)) / f / np.sqrt(max(d - 1, 1))
    estimate = (code @ turned.T) / f[:, None].astype(np.float32)
    p, q = np.nonzero(estimate + (width + 1e-5)[:, None].astype(np.float32) >= threshold)
    ok = np.zeros(len(p), bool)
    for i in range(0, len(p), 65536):
        s = slice(i, i + 65536)
        ok[s] = np.einsum("ij,ij->i", a[p[s]], b[q[s]]) >= threshold
    return p[ok], q[ok], len(p)


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), float).reshape(len(col), d)


def _forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n vertices."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, p, low[q])
        np.minimum.at(new, q, new[p])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(rid, id, label, vec, d): rows numbered; vec is null where the row links with nothing."""
    kind = df.schema[vec_col].dataType.elementType
    v = F.col(vec_col).cast(T.ArrayType(kind if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DoubleType()))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & F.col(label_col).isNotNull() & fine & F.exists(v, lambda x: x != 0)
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.when(ok, v).alias("vec"))
    return materialize(src.withColumn("d", F.size("vec")).withColumn("rid", F.monotonically_increasing_id()), "vectors")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows are compared when labels are equal and not null and dimensions agree.  A vector that is null, empty,
    zero, or holds a null or non-finite component links with nothing (0 links, its own component).  Rows that
    repeat a vector link with each other.  Null ids take part, but name a component only if all its ids are
    null; rows that repeat an id are separate vertices."""
    table = vectors(df, id_col, vec_col, label_col)
    some = table.where("vec IS NOT NULL")
    reps = materialize(some.groupBy("label", "vec", "d").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("weight")), "distinct")

    def bands(batches):
        for b in batches:
            rid, ds = b.column(0), b.column(2).to_numpy()
            for d in np.unique(ds):
                at = pa.array(np.flatnonzero(ds == d))
                keys = band_keys(unit(_matrix(b.column(1).take(at), d)))
                flat = pa.array((np.arange(BANDS) * 65536 + keys.astype(np.int64)).reshape(-1).astype(np.int32))
                ends = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([rid.take(at), pa.ListArray.from_arrays(ends, flat)], ["rid", "keys"])

    keyed = reps.select("rid", "vec", "d").mapInArrow(bands, "rid bigint, keys array<int>")
    keyed = materialize(keyed.join(reps.select("rid", "label", "d"), "rid"), "keys")
    rows = keyed.select("rid", "label", "d", F.explode("keys").alias("key"))
    by = ["label", "d", "key"]
    buckets = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    active = rows.join(buckets, by)
    # Deal each bucket into blocks; every pair of blocks is a unit of work.
    active = (active.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
              .withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("rid", *by, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine"))
    work = active.join(reps.select("rid", "vec", "weight"), "rid")

    schema = "rid bigint, links bigint, root bigint"

    def solve(rows):
        d, key, i, j = rows[0][2], rows[0][3], rows[0][4], rows[0][5]
        rid, mine, weight = (np.array([r[k] for r in rows]) for k in (0, 6, 8))
        u = unit(np.array([r[7] for r in rows], float).reshape(len(rows), d))
        here, there = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        if len(rows) < 2 or not len(here) or not len(there):
            return None
        p, q, _ = linked(u[here], u[there], threshold)
        p, q = here[p], there[q]
        keep = (p < q) if i == j else np.ones(len(p), bool)
        p, q = p[keep], q[keep]
        band = key >> 16
        if band and len(p):
            k = band_keys(u)[:, :band]
            earlier = np.zeros(len(p), bool)
            for c in range(band):
                earlier |= k[p, c] == k[q, c]
            p, q = p[~earlier], q[~earlier]
        if not len(p):
            return None
        links = np.bincount(p, weight[q], len(rows)) + np.bincount(q, weight[p], len(rows))
        root = rid[_forest(len(rows), p, q)]
        at = links > 0
        return rid[at], links[at].astype(np.int64), root[at]

    def run(batches):
        held, out = [], []

        def flush():
            got = solve(held)
            if got:
                out.append(got)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[-1][1:6] != r[1:6]:
                    flush()
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["rid", "links", "root"])
                out = []
        if held:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["rid", "links", "root"])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unit_of_work = [*by, "i", "j"]
    found = (work.select("rid", *by, "i", "j", "mine", "vec", "weight").repartition(n, *unit_of_work).sortWithinPartitions(*unit_of_work)
             .mapInArrow(run, schema))
    found = materialize(found, "found")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    per_rep = (reps.select("rid", "weight", "label", "d", "vec").join(counts, "rid", "left").join(comp.withColumnRenamed("id", "rid"), "rid", "left")
               .select("label", "vec", "d", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rid").alias("c")))
    placed = materialize(some.join(per_rep, ["label", "vec", "d"]).select("rid", "id", "n_links", "c"), "placed")
    heads = materialize(placed.groupBy("c").agg(F.min("id").alias("component_id")), "heads")
    named = placed.join(heads, "c").select("rid", "n_links", "component_id")
    out = table.select("rid", "id", F.col("vec").isNull().alias("alone")).join(named, "rid", "left")
    cid = F.when(F.col("alone"), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), cid.alias("component_id"),
                      F.coalesce(F.col("id") == cid, cid.isNull()).alias("kept"))
