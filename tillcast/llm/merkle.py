"""Merkle manifest of a table: one tree of row digests per source, and one over the sources.

Where a row's leaf stands among its source's leaves is a rank query, not a sort.  The doc_ids of a source form
a bitmap, cut into chunks of ``CHUNK`` ids:

* Every task packs the ids of its rows into containers per (source, chunk), as a list of offsets while there
  are few and as bits otherwise, and sends only these; containers of a chunk are merged by OR.
* The popcounts of the chunks are added up into a directory of ``LEVELS`` levels: a radix tree over the chunk
  number, so that no group of the directory has more than 2 ** RADIX entries, however the ids are spread.
* The coordinate of a leaf is the directory's count before its chunk plus the popcount below it inside.

The coordinates then key slot arrays: a task that holds the digests of ``RUN`` leaves, each in its slot, reduces
``DEPTH`` levels of the tree at once and passes one digest up.  A second pass goes down: it gives each run the
siblings of the nodes above it, so that every leaf gets its whole proof in the task that holds its run.

A row that repeats a doc_id (or has none) can't have a bit of its own.  Chunks whose rows outnumber their bits
are looked at again: repeated ids are counted, the coordinates after them are shifted, and the rows of one id
are numbered by leaf digest over a range partitioning, so that no task holds all rows of an id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.quantiles import rank_within
from tillcast.llm.common import materialize

FANOUT, DEPTH = 3, 6
RUN = FANOUT**DEPTH
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
RADIX, LEVELS = 13, 4
#: A container lists its offsets (two bytes each) up to this many, else it holds CHUNK bits.
LISTED = CHUNK // 16
BY = ["named", "src"]


# ---- leaves ----------------------------------------------------------------------------------------------
def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaves(df: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """(id, named, src, key, leaf, altered) of every row: the digest of ``FIELDS`` and of the tampered ones.

    ``named``/``src`` stand for the source in joins (a null source is one of its own, before the empty string).
    ``key`` is the id as an unsigned number in ascending order; ``altered`` is null where nothing changed."""
    c = {f: F.col(f"`{f}`") for f in FIELDS}
    leaf, other = digest([c[f] for f in FIELDS]), digest([(tampered or {}).get(f, c[f]) for f in FIELDS])
    source = c["source"].cast("string")
    rows = df.select(c["doc_id"].cast("bigint").alias("id"), source.isNotNull().alias("named"), F.coalesce(source, F.lit("")).alias("src"), leaf.alias("leaf"), other.alias("altered"))
    key = F.col("id").bitwiseXOR(F.lit(-(1 << 63)))
    return rows.select("id", *BY, F.coalesce(F.shiftrightunsigned(key, CHUNK_BITS), F.lit(-1)).alias("chunk"),
                       F.coalesce(key.bitwiseAND(F.lit(CHUNK - 1)), F.lit(0)).cast("int").alias("bit"), "leaf", F.when(F.col("altered") != F.col("leaf"), F.col("altered")).alias("altered"))


# ---- bitmaps ---------------------------------------------------------------------------------------------
def pack(flags: np.ndarray) -> bytes:
    """A container of CHUNK flags."""
    bits = np.flatnonzero(flags)
    if len(bits) <= LISTED:
        return b"L" + bits.astype("<u2").tobytes()
    return b"B" + np.packbits(flags, bitorder="little").tobytes()


def flags_at(bits) -> np.ndarray:
    flags = np.zeros(CHUNK, bool)
    flags[np.asarray(bits, np.int64)] = True
    return flags


def flags_of(container: bytes) -> np.ndarray:
    if container[:1] == b"B":
        return np.unpackbits(np.frombuffer(container, np.uint8, offset=1), bitorder="little").astype(bool)
    return flags_at(np.frombuffer(container, "<u2", offset=1))


_CHUNKS = "named boolean, src string, chunk bigint, bits binary, n bigint"


def _pack_batches(batches):
    """One container for each (source, chunk) of a batch."""
    for b in batches:
        groups = pa.Table.from_batches([b]).group_by([*BY, "chunk"]).aggregate([("bit", "list")])
        bits = groups["bit_list"].to_pylist()
        yield pa.RecordBatch.from_arrays(
            [*[groups[c].combine_chunks() for c in (*BY, "chunk")], pa.array([pack(flags_at(x)) for x in bits], pa.binary()),
             pa.array([len(x) for x in bits], pa.int64())], [*BY, "chunk", "bits", "n"])


def _merge_chunk(key, t):
    flags = np.zeros(CHUNK, bool)
    for c in t["bits"]:
        flags |= flags_of(c.as_py())
    n = sum(t["n"].to_pylist())
    return pa.table({"named": [key[0].as_py()], "src": [key[1].as_py()], "chunk": [key[2].as_py()], "bits": [pack(flags)],
                     "n": [n], "popcount": [int(flags.sum())]})


def chunk_bitmaps(rows: DataFrame) -> DataFrame:
    """(named, src, chunk, bits, n, popcount): the merged bitmap of every source's chunk and its number of rows."""
    parts = rows.select(*BY, "chunk", "bit").mapInArrow(_pack_batches, _CHUNKS)
    return parts.groupBy(*BY, "chunk").applyInArrow(_merge_chunk, _CHUNKS + ", popcount bigint")


def directory(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``before``: the rows of the source in all earlier chunks, by a radix tree of counts."""
    digit = lambda level: F.col("chunk").bitwiseAND(F.lit(-(1 << (RADIX * level)))) if level else F.col("chunk")
    out = None
    for level in reversed(range(LEVELS)):  # the node of a level is named by its first chunk; its parent covers 2 ** RADIX of them
        parent = F.lit(0) if level == LEVELS - 1 else digit(level + 1)
        cells = chunks.withColumn("up", parent).groupBy(*BY, "up", digit(level).alias("node")).agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*BY, "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.select(*BY, "up", "node", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("count"))
        if out is not None:
            cells = cells.join(out.select(*BY, F.col("node").alias("up"), F.col("before").alias("above")), [*BY, "up"])
        out = cells.select(*BY, "node", (F.col("count") + (F.col("above") if out is not None else 0)).cast("bigint").alias("before"))
    return chunks.join(out.withColumnRenamed("node", "chunk"), [*BY, "chunk"])


def _coordinates(bits: np.ndarray, chunk: pa.Table) -> pa.Array:
    """The place of each of a chunk's ids among the rows of its source: directory count plus popcount below."""
    below = np.zeros(CHUNK + 1, np.int64)
    np.cumsum(flags_of(chunk["bits"][0].as_py()), out=below[1:])
    for r in chunk["repeats"][0].as_py() or []:
        below[r["bit"] + 1 :] += r["extra"]
    return pa.array(chunk["before"][0].as_py() + below[bits], pa.int64())


_PLACED = "id bigint, named boolean, src string, leaf binary, altered binary, index bigint"
_FIRST = "named boolean, src string, chunk bigint, bit int, times bigint, first bigint"


def _place_rows(key, rows, chunk):
    return rows.select(["id", *BY, "leaf", "altered"]).append_column("index", _coordinates(rows["bit"].to_numpy(), chunk))


def _place_repeats(key, repeats, chunk):
    return repeats.select([*BY, "chunk", "bit", "times"]).append_column("first", _coordinates(repeats["bit"].to_numpy(), chunk))


def placed(rows: DataFrame) -> DataFrame:
    """(id, named, src, leaf, altered, index) of ``leaves``: the place of each among its source's, from 0."""
    at, key = [*BY, "chunk"], [*BY, "chunk", "bit"]
    chunks = materialize(directory(materialize(chunk_bitmaps(rows), "merkle-bitmaps")), "merkle-directory")
    if not chunks.where("n > popcount").limit(1).count():
        lone = chunks.withColumn("repeats", F.lit(None).cast("array<struct<bit:int,extra:bigint>>"))
        return rows.groupBy(*at).cogroup(lone.groupBy(*at)).applyInArrow(_place_rows, _PLACED)

    crowded = rows.join(chunks.where("n > popcount").select(*at), at, "left_semi")
    repeats = materialize(crowded.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "merkle-repeats")
    listed = repeats.groupBy(*at).agg(F.collect_list(F.struct("bit", (F.col("times") - 1).alias("extra"))).alias("repeats"))  # at most CHUNK entries
    chunks = materialize(chunks.join(listed, at, "left"), "merkle-counts")
    lone = rows.join(repeats.select(*key), key, "left_anti").groupBy(*at).cogroup(chunks.groupBy(*at)).applyInArrow(_place_rows, _PLACED)
    first = materialize(repeats.groupBy(*at).cogroup(chunks.groupBy(*at)).applyInArrow(_place_repeats, _FIRST), "merkle-first")
    many = rows.join(first, key)
    few = many.where(F.col("times") <= CHUNK).withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("leaf")) - 1)
    hot = rank_within(many.where(F.col("times") > CHUNK).withColumn("group", F.struct(*key)), "group", ["leaf"], out="_rank", index_out="_nth")
    for part in (few, hot):
        lone = lone.unionByName(part.select("id", *BY, "leaf", "altered", (F.col("first") + F.col("_nth")).cast("bigint").alias("index")))
    return lone


# ---- trees -----------------------------------------------------------------------------------------------
def h(parts: list[bytes]) -> bytes:
    """sha256 of digests concatenated as hex text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def reduce_run(slots: list[bytes], whole: bool) -> list[list[bytes]]:
    """The levels of one run's subtree, its slots first.  A ``whole`` tree ends as soon as one node is left;
    a run of a larger tree goes through all DEPTH levels."""
    levels = [slots]
    while len(levels) <= DEPTH and not (whole and len(levels[-1]) == 1):
        last = levels[-1]
        levels.append([h(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return levels


def steps(levels: list[list[bytes]], slot: int) -> bytes:
    """The way up from a slot to the run's root: per level the place in its three and the siblings, left to right."""
    out = []
    for level in levels[:-1]:
        first, place = slot - slot % FANOUT, slot % FANOUT
        others = level[first : first + place] + level[slot + 1 : first + FANOUT]
        out.append(bytes([place, len(others)]) + b"".join(others))
        slot //= FANOUT
    return b"".join(out)


def siblings(way: bytes) -> list[tuple[int, list[bytes]]]:
    out, i = [], 0
    while i < len(way):
        place, n = way[i], way[i + 1]
        out.append((place, [way[i + 2 + 32 * k : i + 34 + 32 * k] for k in range(n)]))
        i += 2 + 32 * n
    return out


def fold(node: bytes, way: list[tuple[int, list[bytes]]]) -> bytes:
    for place, others in way:
        node = h([*others[:place], node, *others[place:]])
    return node


def _slots(t: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Digests in their slots, and each row's slot.  The rows of a run come in any order."""
    at = (t["index"].to_numpy() % RUN).astype(np.int64)
    slots: list = [None] * len(at)
    for i, d in zip(at.tolist(), t["leaf"].to_pylist()):
        slots[i] = d
    if any(d is None for d in slots):
        raise ValueError("the slots of a run must be filled without gaps: rows were lost or came twice")
    return slots, at


_NODE = "named boolean, src string, index bigint, leaf binary"


def _roots(key, t):
    slots, _ = _slots(t)
    root = reduce_run(slots, t["total"][0].as_py() <= RUN)[-1][0]
    return pa.table({"named": [key[0].as_py()], "src": [key[1].as_py()], "index": [key[2].as_py()], "leaf": [root]})


def by_run(df: DataFrame):
    return df.withColumn("run", F.floor(F.col("index") / RUN).cast("bigint")).groupBy(*BY, "run")


def counted(nodes: DataFrame, totals: DataFrame, shrink: int) -> DataFrame:
    """``nodes`` with ``total``: how many nodes their source's tree has ``shrink`` rounds above the leaves."""
    left = F.col("total")
    for _ in range(shrink):
        left = F.ceil(left / RUN).cast("bigint")
    return nodes.join(totals.select(*BY, left.alias("total")), BY)


def climb(nodes: DataFrame, totals: DataFrame, most: int) -> list[DataFrame]:
    """The nodes of every DEPTH-th level (named, src, index, leaf, total), leaves first; the last has one per source."""
    rounds, left = [counted(nodes, totals, 0)], most
    while left > 1:
        up = by_run(rounds[-1].select(*BY, "index", "leaf", "total")).applyInArrow(_roots, _NODE)
        rounds.append(materialize(counted(up, totals, len(rounds)), "merkle-nodes"))
        left = -(-left // RUN)
    return rounds


_WAY = "named boolean, src string, index bigint, way binary"


def _ways(key, t, above):
    slots, at = _slots(t)
    levels, up = reduce_run(slots, t["total"][0].as_py() <= RUN), above["way"][0].as_py()
    return t.select([*BY, "index"]).append_column("way", pa.array([steps(levels, s) + up for s in at.tolist()], pa.binary()))


def descend(rounds: list[DataFrame], ways: DataFrame) -> DataFrame:
    """The way to the root (``ways`` of the last round's nodes, prolonged) for the runs of the first round's nodes."""
    for nodes in reversed(rounds[1:-1]):
        ways = materialize(by_run(nodes).cogroup(as_run(ways)).applyInArrow(_ways, _WAY), "merkle-ways")
    return ways


def as_run(ways: DataFrame):
    return ways.groupBy(*BY, F.col("index").alias("run"))


_OUT = "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(whole_proofs: bool):
    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = pa.schema([("id", pa.int64()), *[(c, pa.string()) for c in texts], ("verified", pa.bool_()), *([("proof", pa.binary())] if whole_proofs else [])])

    def prove(key, t, above):
        slots, at = _slots(t)
        levels, up = reduce_run(slots, t["total"][0].as_py() <= RUN), above["way"][0].as_py()
        upper, subroot, root = siblings(up), above["subroot"][0].as_py(), above["root"][0].as_py()
        rows = []
        for i, slot, altered in zip(t["id"].to_pylist(), at.tolist(), t["altered"].to_pylist()):
            near = steps(levels, slot)
            way = siblings(near) + upper
            folded = fold(altered or slots[slot], way)
            proof = h([o for _, others in way for o in others])
            rows.append((i, slots[slot].hex(), subroot.hex(), root.hex(), proof.hex(), folded.hex(), folded == root, *([near + up] if whole_proofs else [])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return prove


def manifest(df: DataFrame, tampered: dict[str, Column] | None = None, proofs: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``df`` (columns ``FIELDS``).

    A leaf is the sha256 of the row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and value.
    Every 3 consecutive leaves of a source, ascending by doc_id, become the digest of their hex digests, and so
    on until the source's subroot is left; the subroots, ascending by source (null first), give the root alike.
    ``proof_sha256`` is the digest of the siblings on the way from the leaf to the root.  ``folded_root`` is the
    root recomputed from the siblings and the leaf of the fields ``tampered`` (field name: expression), if any;
    ``verified`` tells whether it is the root.  With ``proofs`` the siblings come along as ``proof``: per level
    one byte for the place in its three, one for the number of siblings, and their 32-byte digests.

    Rows without doc_id come first; rows that share a doc_id ascend by leaf, and equal ones are
    interchangeable.  doc_id is cast to bigint; other columns are ignored.  An empty table gives an empty one."""
    spark, schema = df.sparkSession, _OUT + (", proof binary" if proofs else "")
    rows = materialize(leaves(df, tampered), "merkle-leaves")
    nodes = materialize(placed(rows), "merkle-placed")
    totals = materialize(nodes.groupBy(*BY).agg(F.count(F.lit(1)).alias("total")), "merkle-totals")
    most, sources = totals.agg(F.max("total"), F.count(F.lit(1))).first()
    if not sources:
        return spark.createDataFrame([], schema)
    trees = climb(nodes, totals, most)

    # The tree over the sources: all its nodes are of one group.
    subroots = materialize(rank_within(trees[-1].select(*BY, F.col("leaf").alias("subroot")), None, BY, out="_rank", index_out="_at").drop("_rank"), "merkle-subroots")
    one = [F.lit(True).alias("named"), F.lit("").alias("src")]
    top = materialize(subroots.select(*one, F.col("_at").cast("bigint").alias("index"), F.col("subroot").alias("leaf")), "merkle-top")
    total = spark.createDataFrame([(True, "", sources)], "named boolean, src string, total bigint")
    upper = climb(top, total, sources)
    root = upper[-1].first()["leaf"]
    # Each source's way from its subroot to the root.
    start = upper[-1].select(*BY, "index", F.lit(b"").alias("way"))
    ways = descend(upper, start)
    if len(upper) > 1:
        ways = by_run(upper[0]).cogroup(as_run(ways)).applyInArrow(_ways, _WAY)
    ways = materialize(ways.select("index", "way"), "merkle-ways")
    start = subroots.join(ways, F.col("_at") == F.col("index")).select(*BY, F.lit(0).cast("bigint").alias("index"), "way")
    above = descend(trees, start).join(subroots.drop("_at"), BY).withColumn("root", F.lit(bytes(root)))
    return by_run(trees[0]).cogroup(as_run(above)).applyInArrow(_proofs(proofs), schema)


def fold_proof(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf digest and its ``proof`` (see ``manifest``) lead to."""
    return fold(leaf, siblings(proof))


def op12_manifest(docs: DataFrame) -> DataFrame:
    """``manifest`` of ``docs`` where every row with an even crc32 of its doc_id has lost its newlines."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    flat = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest(docs, {"text": flat}).withColumnRenamed("id", "doc_id")


def _op12_sql() -> str:
    """The trees by recursion over sorted leaves, three pos a time."""
    def enc(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def h_of(text: str) -> str:
        return f"sha256({' || '.join(enc(text if c == 'text' else c) for c in FIELDS)})"

    bytes_ = "list_transform(range(1, len(d) + 1), lambda i: ascii(substr(d, i, 1))::BIGINT)"
    shifted = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {shifted}), 4294967295)"

    def tree(name: str, start: str) -> str:
        return f"""{name} AS (
  {start}
  UNION ALL
  SELECT source, lvl + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY source, lvl, pos // 3)"""

    return f"""
WITH RECURSIVE
e AS (SELECT *, ({crc.replace("len(d)", "len(doc_id::VARCHAR)").replace("substr(d,", "substr(doc_id::VARCHAR,")} & 1) = 0 AS even FROM documents),
f AS (SELECT doc_id, source, {h_of("text")} AS leaf, {h_of("(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)")} AS alt FROM e),
l AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY source) AS n FROM f),
{tree("t", "SELECT source, 0 AS lvl, pos, n, leaf AS node FROM l")},
s AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{tree("u", "SELECT '' AS source, 0 AS lvl, pos, n, subroot AS node FROM s")},
w AS (
  SELECT r, t.lvl, string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (3 ** t.lvl)::BIGINT) AS le, string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (3 ** t.lvl)::BIGINT) AS ri
  FROM l JOIN t ON t.source IS NOT DISTINCT FROM l.source AND t.n > 1 AND t.pos // 3 = l.pos // (3 ** (t.lvl + 1))::BIGINT GROUP BY r, t.lvl
  UNION ALL
  SELECT r, 1000 + u.lvl, string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos < s.pos // (3 ** u.lvl)::BIGINT), string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos > s.pos // (3 ** u.lvl)::BIGINT)
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN u ON u.n > 1 AND u.pos // 3 = s.pos // (3 ** (u.lvl + 1))::BIGINT GROUP BY r, u.lvl),
x AS (SELECT r, coalesce(le, '') AS le, coalesce(ri, '') AS ri, row_number() OVER (PARTITION BY r ORDER BY lvl) AS step, count(*) OVER (PARTITION BY r) AS steps FROM w),
p AS (SELECT r, sha256(string_agg(le || ri, '' ORDER BY step)) AS proof FROM x GROUP BY r),
g AS (
  SELECT r, 0::BIGINT AS step, alt AS node FROM l
  UNION ALL
  SELECT g.r, g.step + 1, sha256(x.le || g.node || x.ri) FROM g JOIN x ON x.r = g.r AND x.step = g.step + 1),
z AS (SELECT r, arg_max(node, step) AS folded FROM g GROUP BY r),
o AS (SELECT node AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN z USING (r) LEFT JOIN p USING (r), o
"""


OP12_SQL = _op12_sql()
