"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and components.

Signature: element e visits the SLOTS positions in the order of its own random permutation; at its j-th visit
it offers the value j + u.  A position keeps its minimum.  Values of later visits are larger, so a text stops
after the first round in which every position is filled.  Rounds run over all texts of a pass at once.

Search: equal sets collapse to one representative.  Representatives that share a band meet in a bucket; each
is verified against the bucket's first one, on the full sets.  A bucket whose members are then all in one
component is closed.  Members of open buckets that hang together form a cluster, which is dealt into blocks: a
task compares the signatures of two blocks, verifies pairs of different components that are not clearly below
the threshold on the full sets, and returns a spanning forest of the links it found, never its pairs.  So no
link between components that a band has brought together is lost, while a group of n copies costs n rows.

Only fixed-size tables reach the driver; every step is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.common import LOWER, U64, SpanHash, bloom, bloom_has, lean, materialize, mix64, signed, text_buffers, word_spans
from tillcast.llm.components import components

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: A band pair whose signatures agree in less than this share is not verified: at a similarity of 0.8 that is
#: over five standard deviations off (about one pair in 10 million).
CLEARLY_BELOW = 0.62
#: Members of a cluster that one block holds.
BLOCK = 512
SIMILAR = (80, 100)
_PASS = 1 << 20


def shingles(buf: np.ndarray, off: np.ndarray, width: int):
    """Distinct shingle hashes of each text: (text, hash) ordered by text, then hash."""
    m = len(off) - 1
    start, end, doc = word_spans(buf, off)
    h = SpanHash(LOWER[buf])(start, end)
    n = np.bincount(doc, minlength=m)
    first = np.cumsum(n) - n
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    of = np.repeat(np.arange(m), count)
    at = np.arange(len(of)) + np.repeat(first - (np.cumsum(count) - count), count)
    left = np.minimum(np.repeat(n, count), width)
    x = left.astype(U64)
    for k in range(width):
        inside = left > k
        x = np.where(inside, mix64(x * U64(0x8CB92BA72F3D8DD7) + h[np.where(inside, at + k, at)]) if len(at) else x, x)
    bits = U64(max(1, int(m).bit_length()))
    order = np.argsort((of.astype(U64) << (U64(64) - bits)) | (x >> bits))
    of, x = of[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
    return of[new], x[new]


def signatures(of: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash of each of m sets given as (set, hash); empty sets keep the largest value everywhere."""
    sig = np.full((m, SLOTS), 2**64 - 1, U64)
    flat = sig.reshape(-1)
    perm = None
    for j in range(SLOTS):
        u = mix64(x + U64(j * 0x9E6C63D0676A9A99 % 2**64))
        k = j + ((u & U64(0xFFFF)) % U64(SLOTS - j)).astype(np.int64)
        slot = k if perm is None else perm[np.arange(len(x)), k]
        np.minimum.at(flat, of * SLOTS + slot, (U64(j) << U64(56)) | (u >> U64(8)))
        open_ = sig.max(axis=1) >= (U64(j + 1) << U64(56)) if j + 1 < SLOTS else np.zeros(m, bool)
        on = open_[of]
        if not on.any():
            break
        if perm is None:
            perm = np.tile(np.arange(SLOTS, dtype=np.uint8), (int(on.sum()), 1))
            perm[np.arange(len(perm)), k[on]] = 0
            of, x = of[on], x[on]
        else:
            perm[np.arange(len(x)), k] = perm[:, j]
            if not on.all():
                of, x, perm = of[on], x[on], perm[on]
    return sig


def set_hashes(of: np.ndarray, x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums per set: equal for equal sets."""
    h = np.zeros((2, m), U64)
    np.add.at(h[0], of, mix64(x ^ U64(0x1D8E4E27C47D124F)))
    np.add.at(h[1], of, mix64(x + U64(0xEB44ACCAB455D165)))
    return h[0], h[1]


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), U64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, U64)
        for c in range(ROWS):
            h = mix64(h * U64(0x589965CC75374CC3) + sig[:, b * ROWS + c])
        keys[:, b] = h
    return keys


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), signed(values))


def _tag(ids: pa.Array, h1: np.ndarray) -> np.ndarray:
    """One hash of a document's id and set, to recognise representatives when texts are read again."""
    import pyarrow.compute as pc

    return mix64(h1 ^ mix64(pc.fill_null(ids.cast(pa.int64()), -1).to_numpy(zero_copy_only=False).view(U64)))


def signed_table(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(rid, doc, xx, n, h1, h2, tag, bands, sig) of every row; rid numbers the rows, xx is the text's hash."""

    def run(batches):
        for b in batches:
            for row, buf, off in text_buffers(b.column(1), _PASS):
                m = len(off) - 1
                of, x = shingles(buf, off, width)
                sig = signatures(of, x, m)
                h1, h2 = set_hashes(of, x, m)
                ids = b.column(0).slice(row, m)
                small = (sig ^ (sig >> U64(40))).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([
                    ids, b.column(2).slice(row, m), pa.array(np.bincount(of, minlength=m)), signed(h1), signed(h2), signed(_tag(ids, h1)),
                    _lists(band_keys(sig).reshape(-1), np.arange(0, m * BANDS + 1, BANDS)), pa.array([s.tobytes() for s in small], pa.binary())],
                    ["doc", "xx", "n", "h1", "h2", "tag", "bands", "sig"])

    src = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn("xx", F.xxhash64("text"))
    out = src.mapInArrow(lean(run), "doc bigint, xx bigint, n bigint, h1 bigint, h2 bigint, tag bigint, bands array<bigint>, sig binary")
    return materialize(out.withColumn("rid", F.monotonically_increasing_id()), "signatures")


def _sets(df: DataFrame, id_col: str, text_col: str, width: int, needed: DataFrame) -> DataFrame:
    """(id, n, set) for ``needed`` (id, h1, h2, tag): texts are read again, and only rows whose tag passes a
    fixed-size Bloom filter leave the task; the join drops what it lets through wrongly."""
    bits = bloom(needed.select("tag"))

    def run(batches):
        for b in batches:
            for row, buf, off in text_buffers(b.column(1), _PASS):
                m = len(off) - 1
                of, x = shingles(buf, off, width)
                h1, h2 = set_hashes(of, x, m)
                hit = bloom_has(bits, _tag(b.column(0).slice(row, m), h1))
                keep = hit[of]
                ends = np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=m)[hit])])
                if hit.any():
                    yield pa.RecordBatch.from_arrays([signed(h1[hit]), signed(h2[hit]), _lists(x[keep], ends)], ["h1", "h2", "set"])

    src = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    got = src.mapInArrow(lean(run), "h1 bigint, h2 bigint, set array<bigint>")
    return materialize(got.join(needed.select("id", "h1", "h2"), ["h1", "h2"]).select("id", "set"), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets have Jaccard similarity of at least similar[0] / similar[1]."""
    num, den = similar
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).cast("bigint").alias("s"))
    return materialize(joined.where(F.col("i") * den >= (F.col("s") - F.col("i")) * num).select("a", "b").distinct(), "links")


def _cross_links(rows: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links (a, b) that connect, among rows (cluster, members, id, c, sig, set), different components c of a
    cluster.  Pairs whose vertices are already connected in a task are not verified again there."""
    num, den = similar
    dealt = (rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
             .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "c", "sig", "set"))

    def links(i, j, mine, ids, c, sig, sets):
        parent: dict[int, int] = {}

        def find(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        size = np.array([len(x) for x in sets])
        here, there = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        for p in here:
            q = there[(c[there] != c[p]) & ((ids[there] > ids[p]) if i == j else True)]
            q = q[(size[q] * den >= size[p] * num) & (size[p] * den >= size[q] * num)]
            like = (sig[q] == sig[p]).mean(axis=1)
            for o in q[np.argsort(-like)][: int((like >= CLEARLY_BELOW).sum())]:
                x, y = find(c[p]), find(c[o])
                if x == y:
                    continue
                both = len(np.intersect1d(sets[p], sets[o], assume_unique=True))
                if both * den >= (size[p] + size[o] - both) * num:
                    parent[max(x, y)] = min(x, y)
                    yield ids[p], ids[o]

    def run(batches):
        held, out = [], []  # held: one pair of blocks

        def flush():
            cols = list(zip(*held))
            if len(set(cols[5])) > 1:
                sig = np.stack([np.frombuffer(x, np.uint16) for x in cols[6]])
                out.extend(links(cols[1][0], cols[2][0], np.array(cols[3]), np.array(cols[4]), np.array(cols[5]), sig, cols[7]))

        for b in batches:
            small = list(zip(*(b.column(k).to_pylist() for k in range(7))))
            ends = b.column(7).offsets.to_numpy()
            flat = b.column(7).values.to_numpy(zero_copy_only=False)
            for k, r in enumerate(small):
                if held and held[-1][:3] != r[:3]:
                    flush()
                    held = []
                held.append((*r, flat[ends[k] : ends[k + 1]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
                out = []
        if held:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(lean(run), "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(id, xx, n_shingles, component_id, kept, first) of every row.

    Sets are the distinct shingles of ``width`` words (ASCII lower case); a text with fewer words is one
    shingle, one without words (null, empty) has an empty set and links with nothing.  component_id is the
    smallest id reachable over links; kept says that it is the row's own.  Rows are the vertices: rows that
    repeat an id and differ in text may be in different components.  Null ids take part, but never name a
    component unless all its ids are null.  ``first`` marks one row of each component, also where an id is
    repeated, and every row that links with nothing; xx is the hash of the text, to find the row again."""
    table = signed_table(df, id_col, text_col, width)
    some = table.where("n > 0")
    reps = some.groupBy("h1", "h2").agg(F.min(F.struct("rid", "tag", "bands", "sig")).alias("r"))
    reps = materialize(reps.select(F.col("r.rid").alias("id"), "h1", "h2", "r.tag", "r.bands", "r.sig"), "reps")

    rows = reps.select("id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo < hi")
    buckets = materialize(buckets.select("key", "lo", "members"), "buckets")
    members = materialize(rows.join(buckets, "key"), "members")

    needed = materialize(reps.select("id", "h1", "h2", "tag").join(members.select("id").distinct(), "id", "left_semi"), "needed")
    sets = _sets(df, id_col, text_col, width, needed)
    links = _verify(members.where("id > lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct(), sets, similar)

    comp = materialize(components(links), "components")
    placed = members.where("members > 2").join(comp, "id", "left").select("key", "lo", "members", "id", F.coalesce("component", "id").alias("c"))
    placed = materialize(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    open_rows = materialize(placed.join(open_keys, "key", "left_semi").select("lo", "id", "c"), "open")
    cluster = materialize(components(open_rows.select(F.col("lo").alias("a"), F.col("id").alias("b"))), "clusters")
    size = materialize(cluster.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "cluster-sizes")
    rows = (open_rows.select("id", "c").distinct().join(cluster, "id").join(size, "component")
            .select("id", "c", F.col("component").alias("cluster"), "members").join(reps.select("id", "sig"), "id").join(sets, "id"))
    more = materialize(_cross_links(rows, similar), "cross-links")
    if more.limit(1).count():
        comp = materialize(components(links.unionByName(more)), "components")

    by_rep = reps.select("id", "h1", "h2").join(comp, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("c"))
    by_rep = materialize(by_rep, "classes")
    placed = materialize(some.select("rid", "doc", "h1", "h2").join(by_rep, ["h1", "h2"]).select("rid", "doc", "c"), "rows")
    heads = placed.groupBy("c").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "rid")).alias("head"))
    heads = materialize(heads.select("c", F.col("head.doc").alias("component_id"), F.col("head.rid").alias("first_rid")), "heads")
    named = placed.join(heads, "c").select("rid", "component_id", "first_rid")
    out = table.select("rid", "doc", "xx", "n").join(named, "rid", "left")
    alone = F.col("n") == 0
    cid = F.when(alone, F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias("id"), "xx", F.col("n").alias("n_shingles"), cid.alias("component_id"),
                      F.coalesce(F.col("doc") == cid, cid.isNull()).alias("kept"),
                      F.coalesce(F.col("rid") == F.col("first_rid"), F.lit(True)).alias("first"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row of ``df`` for each component, the one with the smallest id, and all rows without a shingle.

    Columns are unchanged.  Of rows that repeat id and text one stays."""
    last = F.lit((1 << 63) - 1)
    plan = near_duplicates(df, id_col, text_col, width, similar).where("first")
    plan = materialize(plan.select(F.coalesce("id", last).alias("_key"), F.col("xx").alias("_hash"), (F.col("n_shingles") == 0).alias("_none")).distinct(), "kept")
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    wide = wide.withColumns({"_key": F.coalesce(F.col(f"_row.`{id_col}`").cast("bigint"), last), "_hash": F.xxhash64(F.col(f"_row.`{text_col}`").cast("string"))})
    nth = F.row_number().over(Window.partitionBy("_key", "_hash").orderBy("_hash"))
    out = wide.join(plan, ["_key", "_hash"]).withColumn("_nth", nth).where("_nth = 1 OR _none")
    return out.select("_row.*")
