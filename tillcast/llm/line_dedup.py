"""Near-duplicate lines over all documents by an exact set-similarity join; later matches are removed.

A line is the set of its words (ASCII lower case).  Its words are ordered by rarity over the whole corpus; two
sets with Jaccard similarity t share a word in their prefixes of |x| − ⌈t|x|⌉ + 1 words, their sizes differ by
t at most, the positions of the shared word bound their overlap, and so do parity bitmaps: a word flips one bit,
and two sets differ in at least as many words as their bitmaps do in bits.

Sets that share a prefix word meet in a bucket, which holds sizes, positions and bitmaps only.  Words are dealt into
slots of some SLOT_ROWS rows, and what a task has for a slot travels as one row, so that Spark shuffles few rows.  Buckets
send on a spanning forest of the pairs that pass all filters.  Sets that hang together by such pairs form a cluster, so a
similar pair is always within one.  The clusters' sets are read again from the texts and dealt into blocks; a task
compares two blocks, verifies the pairs that the bitmaps allow on the full sets, each pair in one task, and returns
a row a set (weight of its links, whether an earlier line is among them) and a spanning forest, never its pairs.
Words with more than LARGE sets are dealt into blocks as well, so no task holds a frequent word or a cluster.

Word counts are kept in a table of a fixed number of cells, which bounds them from above and orders all words
alike everywhere; the order affects speed only, never the result.  Words are compared by 46-bit hashes, equal
sets by a 64-bit hash: exact up to collisions of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import (LOWER, U64, SpanHash, bloom, bloom_has, cell_blocks, lean, materialize, mix64, signed,
                                 sum_cells, text_buffers, word_spans)
from tillcast.llm.components import components, stars

CELLS = 1 << 20
SIMILAR = (80, 100)
#: Rows that a task compares at once, and sets of one word that it holds.
CHUNK = 200_000
LARGE = 4096
#: Bucket rows of a slot in expectation, and those that a task sorts by slot at once.
SLOT_ROWS = 50_000
SORTED_ROWS = 500_000
#: Words (in all sets together) that a block of a cluster holds in expectation.
BLOCK_WORDS = 1 << 18
#: Words with at least 2^(HOT_CLASS / 2) − 1 occurrences (by the table) go the way of frequent words.
HOT_CLASS = 24
_HASH_BITS = 46
_MASK = U64((1 << _HASH_BITS) - 1)
_LAST = (1 << 63) - 1
#: Words of the wide parity bitmap, and the least sizes of sets that have it folded to 128 bits and whole.
WIDE = [f"w{i}" for i in range(4)]
FOLDED_SIZE, WIDE_SIZE = 48, 192
#: A key with more than this share of a table's rows is joined by broadcast: at most 1,000 keys have it.
HOT_SHARE = 1000
ROWS = ["key", "h", "size", "pos", "bits", *WIDE]
PACKED = ["h", "size", "bits", *WIDE]


def need(size, num: int, den: int):
    """⌈size · num / den⌉."""
    return -(-size * num // den)


def line_sets(buf: np.ndarray, off: np.ndarray, classes: np.ndarray):
    """Sets of all lines that have a word.

    Returns (text, line number, start in ``words``, size, hash of the set, parity bitmap, words): each set's
    words ascending, the rarest first.  A word is its class (rarity) in the high bits and its hash below."""
    breaks = np.unique(np.concatenate([off, np.flatnonzero(buf == 10) + 1]))
    start, end, line = word_spans(buf, breaks)
    h = SpanHash(LOWER[buf])(start, end)
    word = (classes[(h & U64(CELLS - 1)).astype(np.int64)].astype(U64) << U64(_HASH_BITS)) | (h >> U64(64 - _HASH_BITS))
    room = U64(max(1, int(len(breaks)).bit_length()))
    if room <= U64(58 - _HASH_BITS):  # both fit into one key
        order = np.argsort((line.astype(U64) << (U64(64) - room)) | ((word << U64(58 - _HASH_BITS)) >> room))
    else:
        order = np.lexsort((word, line))
    word, line = word[order], line[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (line[1:] != line[:-1])
    word, line = word[new], line[new]
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(line)])
    # A hash of the words alone, without their classes, so that it is the same whatever the corpus.
    h = np.add.reduceat(mix64(word & _MASK), first) if len(first) else np.zeros(0, U64)
    bits = np.bitwise_xor.reduceat(U64(1) << (word & U64(63)), first) if len(first) else h
    at = breaks[line[first]] if len(first) else np.zeros(0, np.int64)
    text = np.searchsorted(off, at, "right") - 1
    number = line[first] - np.searchsorted(breaks, off[text]) if len(first) else first
    return text, number, first, size, mix64(h), bits, word


def wide_bitmaps(first: np.ndarray, size: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """The sets' parity bitmaps, 64 bits an array: whole, folded into the first two arrays, or zero, by size."""
    if not len(first):
        return [np.zeros(0, U64) for _ in WIDE]
    bit = U64(1) << ((word >> U64(6)) & U64(63))
    part = (word >> U64(12)) & U64(len(WIDE) - 1)
    a, b, c, d = (np.bitwise_xor.reduceat(np.where(part == U64(i), bit, U64(0)), first) for i in range(len(WIDE)))
    none, whole = U64(0), size >= WIDE_SIZE
    some = size >= FOLDED_SIZE
    return [np.where(whole, a, np.where(some, a ^ c, none)), np.where(whole, b, np.where(some, b ^ d, none)),
            np.where(whole, c, none), np.where(whole, d, none)]


def word_classes(df: DataFrame, text_col: str) -> np.ndarray:
    """Class of every cell: floor(2·log2(1 + occurrences in the corpus of the words in the cell))."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for _, buf, off in text_buffers(b.column(0)):
                start, end, _ = word_spans(buf, off)
                np.add.at(total, (SpanHash(LOWER[buf])(start, end) & U64(CELLS - 1)).astype(np.int64), 1)
        yield cell_blocks(total)

    parts = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(count), "block int, data binary")
    return np.floor(2 * np.log2(1 + sum_cells(parts, CELLS).astype(float))).clip(0, 63).astype(np.uint8)


def _tag(h, doc, line):
    return mix64(h.view(U64) ^ mix64(doc.view(U64) * U64(0x9E3779B97F4A7C15) + line.astype(U64)))


def lines_table(df: DataFrame, id_col: str, text_col: str, classes: np.ndarray, similar) -> DataFrame:
    """(rid, id, xx, doc, line, h, size, bits, w0 …, prefix, hot): one row per line that has a word, and one with line −1 per
    text that has none.  rid numbers the texts; doc is the id with null last; prefix is empty where no
    different set can be similar, and its frequent words, the last ones, are in ``hot`` instead."""
    num, den = similar

    def run(batches):
        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            for row, buf, off in text_buffers(b.column(1)):
                m = len(off) - 1
                text, number, first, size, h, bits, word = line_sets(buf, off, classes)
                prefix = size - need(size, num, den) + 1
                prefix = np.where(size * den >= (size + 1) * num, prefix, 0)  # a larger set can match
                none = np.flatnonzero(np.bincount(text, minlength=m) == 0)
                ends = np.concatenate([[0], np.cumsum(prefix)])
                taken = word[np.arange(ends[-1]) + np.repeat(first - ends[:-1], prefix)]
                hot = (taken >> U64(_HASH_BITS)) >= U64(HOT_CLASS)
                hot_ends = np.concatenate([[0], np.cumsum(hot)])[ends]
                of = np.concatenate([text, none])
                pad = np.zeros(len(none), np.int64)
                ids = b.column(0).slice(row, m).take(pa.array(of))
                wide = [signed(np.concatenate([w, pad.astype(U64)])) for w in wide_bitmaps(first, size, word)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(rid + of), ids, b.column(2).slice(row, m).take(pa.array(of)), pa.array(np.concatenate([number, pad - 1]).astype(np.int32)),
                    signed(np.concatenate([h, pad.astype(U64)])), pa.array(np.concatenate([size, pad]).astype(np.int32)),
                    signed(np.concatenate([bits, pad.astype(U64)])), *wide,
                    *[pa.ListArray.from_arrays(pa.array(np.concatenate([at, pad + at[-1]]).astype(np.int32)), signed(taken[mine]))
                      for at, mine in ((ends - hot_ends, ~hot), (hot_ends, hot))]],
                    ["rid", "id", "xx", "line", "h", "size", "bits", *WIDE, "prefix", "hot"])
                rid += m

    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("xx", F.xxhash64("text"))
    wide = ", ".join(f"{w} bigint" for w in WIDE)
    out = src.mapInArrow(lean(run), f"rid bigint, id bigint, xx bigint, line int, h bigint, size int, bits bigint, {wide}, prefix array<bigint>, hot array<bigint>")
    return materialize(out.withColumn("doc", F.coalesce("id", F.lit(_LAST))), "lines")


def _differ(a: list[np.ndarray], b: list[np.ndarray], small: np.ndarray) -> np.ndarray:
    """Bits in which wide bitmaps differ, folded where the smaller set has ``small`` words and no whole bitmap."""
    x = [(p ^ q).view(U64) for p, q in zip(a, b)]
    whole = sum(np.bitwise_count(v).astype(np.int64) for v in x)
    return np.where(small >= WIDE_SIZE, whole, np.bitwise_count(x[0] ^ x[2]).astype(np.int64) + np.bitwise_count(x[1] ^ x[3]))


def _packed(slots: int):
    """Over rows (PACKED) of sets with words from a position on: (slot, n, data), the rows (ROWS) of a slot's words one column
    after the other.  A set that a task sees again is left out, and so are the wide bitmaps of sets that have none."""

    def pack(cols, words, ends):
        h, size, bits, wide, pos = cols[0], cols[1], cols[2], cols[3:7], cols[7]
        # Rows of a set have the same words, or different ones only.
        _, new = np.unique(mix64(words[ends[:-1]].view(U64) + mix64(h.view(U64))), return_index=True)
        n = np.diff(ends)[new]
        of = np.repeat(new, n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        words = words[ends[of] + nth]
        slot = ((words.view(U64) & _MASK) % U64(slots)).astype(np.int64)
        order = np.argsort(slot)
        slot, of = slot[order], of[order]
        cols = [words[order], h[of], bits[of], size[of].astype(np.int32), (pos[of] + nth[order]).astype(np.int32)]
        some = size[of] >= FOLDED_SIZE
        wide = [w[of[some]] for w in wide]
        before = np.concatenate([[0], np.cumsum(some)])
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        stop = np.r_[first[1:], len(slot)]
        data = [b"".join([*[c[i:j].tobytes() for c in cols], *[w[before[i] : before[j]].tobytes() for w in wide]]) for i, j in zip(first.tolist(), stop.tolist())]
        out = pa.RecordBatch.from_arrays([pa.array(slot[first]), pa.array(stop - first), pa.array(data, pa.binary())], ["slot", "n", "data"])
        return [out.slice(i, 64) for i in range(0, len(first), 64)]

    def run(batches):
        held, n = [], 0
        for b in batches:
            ends = b.column(8).offsets.to_numpy()
            held.append(([b.column(k).to_numpy(zero_copy_only=False) for k in range(8)], b.column(8).values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)))
            n += int(ends[-1] - ends[0])
            if n >= SORTED_ROWS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    def flush(held):
        cols, words, sizes = zip(*held)
        return pack([np.concatenate(x) for x in zip(*cols)], np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))

    return run


def _unpacked(n: int, data: memoryview) -> list[np.ndarray]:
    """The columns (ROWS) of a row of ``_packed``."""
    cols, at = [], 0
    for kind in (np.int64, np.int64, np.int64, np.int32, np.int32):
        cols.append(np.frombuffer(data, kind, n, at))
        at += cols[-1].nbytes
    key, h, bits, size, pos = cols
    some = size >= FOLDED_SIZE
    wide = np.zeros((len(WIDE), n), np.int64)
    wide[:, some] = np.frombuffer(data, np.int64, offset=at).reshape(len(WIDE), -1)
    return [key, h, size, pos, bits, *wide]


def _candidates(similar):
    """Over rows of ``_packed`` sorted by slot: edges (a, b) that span, in each key's bucket, the pairs that pass the filters."""
    num, den = similar

    def solve(cols):
        order = np.lexsort((cols[1], cols[2], cols[0]))
        cols = [x[order] for x in cols]
        twin = np.zeros(len(order), bool)  # copies of one set in a bucket
        twin[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
        key, h, size, pos, bits, *wide = [x[~twin] for x in cols]
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        before = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        ids, of = np.unique(h, return_inverse=True)
        root = np.arange(len(ids))  # of sets, not rows: what one bucket has connected is not compared in the next
        left, right = [], []
        j, k = np.flatnonzero(before >= 1), 1
        while len(j):
            i = j - k
            near = size[i] * den >= size[j] * num  # sizes ascend: sets further off are smaller still
            j, i = j[near], i[near]
            both = size[i] + size[j]
            ok = np.minimum(size[i] - pos[i], size[j] - pos[j]) * (num + den) >= both * num
            ok &= np.bitwise_count((bits[i] ^ bits[j]).view(U64)).astype(np.int64) * (num + den) <= both * (den - num)
            ok &= root[of[i]] != root[of[j]]
            x, y = i[ok], j[ok]
            fits = _differ([w[x] for w in wide], [w[y] for w in wide], size[x]) * (num + den) <= (size[x] + size[y]) * (den - num)
            x, y = x[fits | (size[x] < FOLDED_SIZE)], y[fits | (size[x] < FOLDED_SIZE)]
            for p, q in zip(of[x].tolist(), of[y].tolist()):
                a, b = p, q
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    left.append(a)
                    right.append(b)
            while len(x) and (root[root] != root).any():
                root = root[root]
            k += 1
            j = j[before[j] >= k]
        return stars(ids[np.array(left, int)], ids[np.array(right, int)])

    def emit(held):
        cols = [np.concatenate(x) for x in zip(*(_unpacked(*x) for x in held))]
        order = np.argsort(cols[0])
        key = cols[0][order]
        same = key[1:] == key[:-1]
        pair = order[np.r_[same, False] | np.r_[False, same]]
        a, b = solve([x[pair] for x in cols])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held, n, last = [], 0, None
        for batch in batches:
            for slot, m, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if n >= CHUNK and slot != last:
                    yield emit(held)
                    held, n = [], 0
                last = slot
                held.append((m, memoryview(data.as_buffer())))
                n += m
        if held:
            yield emit(held)

    return run


def _row_bloom(rows: DataFrame) -> np.ndarray:
    """Bloom filter (see common.bloom) of the rows' sets at their lines and of the ids of their texts."""

    def tags(h, doc, line):
        return np.concatenate([_tag(h, doc, line), mix64(np.unique(doc))])

    return bloom(rows.select("h", "doc", "line"), 2 * rows.count(), tags)


def _sets(df: DataFrame, id_col: str, text_col: str, classes: np.ndarray, needed: DataFrame) -> DataFrame:
    """(h, set) of at least the needed sets, read again at their earliest lines (see common.bloom)."""
    bits = _row_bloom(needed)

    def run(batches):
        for b in batches:
            docs = b.column(0).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(bloom_has(bits, mix64(docs)))  # texts that hold a needed line
            docs = docs[some]
            for row, buf, off in text_buffers(b.column(1).take(pa.array(some))):
                text, number, first, size, h, _, word = line_sets(buf, off, classes)
                if not len(h):
                    continue
                hit = bloom_has(bits, _tag(h.view(np.int64), docs[row + text], number))
                ends = np.concatenate([[0], np.cumsum(size[hit])])
                take = np.arange(ends[-1]) + np.repeat(first[hit] - ends[:-1], size[hit])
                yield pa.RecordBatch.from_arrays([signed(h[hit]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), signed(word[take]))], ["h", "set"])

    src = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run), "h bigint, set array<bigint>")


def _compare(cross, mine, h, doc, line, n, words, size, similar):
    """Links among the sets of one unit, ``cross``: between its two blocks, else in its one.  Returns per linked set the weight of its
    links and whether an earlier line is among them, and edges that span the links, from each set to the smallest it hangs with."""
    num, den = similar
    order = np.lexsort((h, size))
    start = (np.cumsum(size) - size)[order]
    mine, h, doc, line, n, size = (x[order] for x in (mine, h, doc, line, n, size))
    take = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    word = words[take].view(U64)
    first = np.cumsum(size) - size
    wide = wide_bitmaps(first, np.full(len(h), WIDE_SIZE), word)
    _, word = np.unique(word, return_inverse=True)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, line, doc))] = np.arange(len(h))
    near, gone, label = np.zeros(len(h), np.int64), np.zeros(len(h), bool), np.arange(len(h))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    mark = np.zeros(int(word.max()) + 1, bool)
    stop = np.searchsorted(size, size * den // num, "right")
    for p in range(len(h) - 1):
        q = np.arange(p + 1, stop[p])
        if cross:
            q = q[mine[q] != mine[p]]
        both = size[q] + size[p]
        differ = sum(np.bitwise_count(w[q] ^ w[p]).astype(np.int64) for w in wide)
        ok = differ * (num + den) <= both * (den - num)
        q, both = q[ok], both[ok]
        if not len(q):
            continue
        own = word[first[p] : first[p] + size[p]]
        mark[own] = True
        ends = np.cumsum(size[q])
        at = np.arange(int(ends[-1])) + np.repeat(first[q] - (ends - size[q]), size[q])
        common = np.add.reduceat(mark[word[at]].astype(np.int64), ends - size[q])
        mark[own] = False
        q = q[common * den >= (both - common) * num]
        if not len(q):
            continue
        near[p] += n[q].sum()
        near[q] += n[p]
        gone[p] |= (rank[q] < rank[p]).any()
        gone[q] |= rank[p] < rank[q]
        new = q[label[q] != label[p]]
        if len(new):
            found, at = np.unique(label[new], return_index=True)
            a.append(np.repeat(h[p], len(at)))
            b.append(h[new[at]])
            label[np.isin(label, found)] = label[p]
    some = near > 0
    return h[some], near[some], gone[some], *stars(np.concatenate(a), np.concatenate(b))


def _verified(rows: DataFrame, similar) -> DataFrame:
    """(h, near, gone, b) of rows (key, i, j, mine, h, doc, line, n, set): see ``_compare``; b is an edge's other end."""

    def run(batches):
        held, last = [], None

        def flush():
            cols = [np.concatenate(x) for x in zip(*held)]
            if len(cols[1]) < 2:
                return
            h, near, gone, a, b = _compare(last[1] != last[2], *cols, similar)
            if len(h):
                k, m = len(h), len(a)
                flag = np.arange(k + m) >= k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h, a])), pa.array(np.concatenate([near, np.zeros(m, np.int64)])),
                     pa.array(np.concatenate([gone, np.zeros(m, bool)])), pa.array(np.concatenate([np.zeros(k, np.int64), b]), mask=~flag)],
                    ["h", "near", "gone", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, mine, h, doc, line, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
            ends = batch.column(8).offsets.to_numpy()
            words = batch.column(8).values.to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
                unit = (key[s], i[s], j[s])
                if held and unit != last:
                    yield from flush()
                    held = []
                last = unit
                held.append((mine[s:e], h[s:e], doc[s:e], line[s:e], n[s:e], words[ends[s] : ends[e]], np.diff(ends[s : e + 1]).astype(np.int64)))
        if held:
            yield from flush()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["key", "i", "j"]
    rows = rows.select(*by, "mine", "h", "doc", "line", "n", "set").repartition(parts, *by).sortWithinPartitions(*by)
    return materialize(rows.mapInArrow(lean(run), "h bigint, near bigint, gone boolean, b bigint"), "links")


def _join_spread(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has a key once and the number of its rows in ``weight``.

    Keys with more than 1/HOT_SHARE of the ``total`` rows, at most HOT_SHARE of them, are broadcast; so no task of
    the shuffled rest holds a frequent key."""
    hot = F.col(weight) > max(total // HOT_SHARE, LARGE)
    few = table.where(hot)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(table.where(~hot), key)
    return rest.unionByName(rows.join(F.broadcast(few), key))


def _links(df: DataFrame, id_col: str, text_col: str, similar) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines (``lines_table``); the different sets (h, o, n: earliest line and number of lines); their links
    (h, near, gone, b) as in ``_verified``."""
    classes = word_classes(df, text_col)
    table = lines_table(df, id_col, text_col, classes, similar)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # Frequent words: a row a set, and for those with more than LARGE sets a row for each pair of blocks.
    hot = table.where(F.size("hot") > 0).select("h", "size", "bits", *WIDE, F.size("prefix").alias("from"), F.posexplode("hot").alias("at", "key"))
    hot = hot.withColumn("pos", F.col("from") + F.col("at"))
    frequent = materialize(hot.groupBy("key", "h").agg(*[F.first(c).alias(c) for c in ROWS[2:]]), "frequent")
    counts = materialize(frequent.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "frequent-words")
    few = frequent.join(counts.where(F.col("sets") <= LARGE).select("key"), "key", "left_semi")
    large = counts.where(F.col("sets") > LARGE).withColumn("blocks", F.ceil(F.col("sets") / LARGE).cast("int"))
    dealt = _join_spread(frequent, large, "key", "sets", frequent.count()).withColumn("mine", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("mine <> other")
    dealt = dealt.withColumn("key", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))

    rows = table.where(F.size("prefix") > 0).select(*PACKED, F.lit(0).alias("pos"), F.col("prefix").alias("words"))
    for more in (few, dealt):
        rows = rows.unionByName(more.select(*PACKED, "pos", F.array("key").alias("words")))
    num, den = similar
    total = table.agg(F.sum(F.col("size") * ((den - num) / den) + 1)).first()[0] or 0
    packed = rows.mapInArrow(lean(_packed(max(parts, int(total / SLOT_ROWS)))), "slot bigint, n bigint, data binary")
    packed = packed.repartitionById(parts, F.pmod("slot", F.lit(parts)).cast("int")).sortWithinPartitions("slot")
    edges = materialize(packed.mapInArrow(lean(_candidates(similar)), "a bigint, b bigint"), "buckets")

    sets = table.where("size > 0").groupBy("h").agg(F.min(F.struct("doc", "line")).alias("o"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    sets = materialize(sets, "copies")
    clusters = components(edges).select(F.col("id").alias("h"), "component")
    placed = materialize(clusters.join(sets, "h").select("h", "component", "o.doc", "o.line", "n", "size"), "clusters")
    words = placed.groupBy("component").agg(F.ceil(F.sum("size") / BLOCK_WORDS).cast("int").alias("blocks"), F.count(F.lit(1)).alias("members"))
    words = materialize(words, "cluster-sizes")
    units = _join_spread(placed, words, "component", "members", placed.count()).withColumn("mine", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    units = units.join(_sets(df, id_col, text_col, classes, placed).dropDuplicates(["h"]), "h")
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select(F.col("component").alias("key"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "h", "doc", "line", "n", "set")
    return table, sets, _verified(units, similar)


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(id, xx, n_lines, removed) of every row: lines that have a word, and the sorted numbers of those that go.

    Lines end at "\\n" and are numbered from 0; lines without a word are not counted and stay.  A line goes if
    an earlier line has a word set of at least the similarity similar[0] / similar[1] (in particular, the same
    set); whether that line stays itself doesn't matter.  Null ids come last.  Of rows that repeat an id, lines
    with the same number are ordered by a hash of their set, and equal lines at the same place don't remove
    each other.  Null and empty texts have no lines.  xx is the hash of the text, to find the row again."""
    table, sets, links = _links(df, id_col, text_col, similar)
    gone = links.where("b IS NULL").groupBy("h").agg(F.max("gone").alias("gone"))
    marks = sets.join(gone, "h", "left").where("n > 1 OR gone").select("h", "o", "n", "gone")
    marks = materialize(marks, "marks")
    lines = table.where("size > 0").select("rid", "doc", "line", "h")
    lines = _join_spread(lines, marks, "h", "n", lines.count())
    gone = lines.where(F.coalesce("gone", F.lit(False)) | (F.struct("doc", "line") > F.col("o"))).select("rid", "line")
    gone = gone.groupBy("rid").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    docs = table.groupBy("rid").agg(F.first("id").alias("id"), F.first("xx").alias("xx"), F.count(F.when(F.col("size") > 0, 1)).alias("n_lines"))
    return docs.join(gone, "rid", "left").select("id", "xx", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``removals`` with a column matches: (line, class_id, class_line, n_links) of every line that is similar to another.

    All pairs of different sets are verified.  n_links counts the other lines that are similar to the line, equal
    ones included; lines that hang together by such links are a class, named by the id and number of its earliest
    line (a null id if it has one).  removed is as in ``removals``."""
    table, sets, links = _links(df, id_col, text_col, similar)
    near = links.where("b IS NULL").groupBy("h").agg(F.sum("near").alias("near"), F.max("gone").alias("gone"))
    comp = components(links.where("b IS NOT NULL").select(F.col("h").alias("a"), "b")).select(F.col("id").alias("h"), "component")
    placed = sets.join(near, "h", "left").join(comp, "h", "left")
    placed = placed.select("h", "o", "n", F.coalesce("gone", F.lit(False)).alias("gone"), F.coalesce("component", "h").alias("c"),
                           (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links")).where("n_links > 0")
    placed = materialize(placed, "placed")
    heads = materialize(placed.groupBy("c").agg(F.min("o").alias("head"), F.count(F.lit(1)).alias("members")), "heads")
    marks = materialize(_join_spread(placed, heads, "c", "members", placed.count()), "marks")
    lines = table.where("size > 0").select("rid", "doc", "line", "h")
    lines = _join_spread(lines, marks, "h", "n", lines.count())
    match = F.struct("line", F.nullif(F.col("head.doc"), F.lit(_LAST)).alias("class_id"), F.col("head.line").alias("class_line"), "n_links")
    lines = lines.select("rid", "line", match.alias("match"), (F.col("gone") | (F.struct("doc", "line") > F.col("o"))).alias("gone"))
    lines = lines.groupBy("rid").agg(F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("removed"), F.sort_array(F.collect_list("match")).alias("matches"))
    docs = table.groupBy("rid").agg(F.first("id").alias("id"), F.first("xx").alias("xx"), F.count(F.when(F.col("size") > 0, 1)).alias("n_lines"))
    out = docs.join(lines, "rid", "left")
    return out.select("id", "xx", "n_lines", *[F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("removed", "matches")])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``df`` without the lines that ``removals`` names; a text that loses its last line with a word is dropped.

    Texts without such a line from the start stay as they are.  Columns are unchanged."""
    plan = removals(df, id_col, text_col, similar)
    plan = materialize(plan.select(F.col("id").alias("_id"), F.col("xx").alias("_xx"), F.col("n_lines").alias("_n"), F.col("removed").alias("_removed"))
                       .where(F.size("_removed") > 0).dropDuplicates(["_id", "_xx"]), "removals")
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    text = F.col(f"_row.`{text_col}`").cast("string")
    wide = wide.withColumns({"_key": F.col(f"_row.`{id_col}`").cast("bigint"), "_hash": F.xxhash64(text)})
    out = wide.join(plan, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_xx")), "left")
    out = out.where(F.col("_n").isNull() | (F.size("_removed") < F.col("_n")))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.array_join(F.transform(F.filter(lines, lambda s: ~F.array_contains("_removed", s["i"])), lambda s: s["x"]), "\n")
    new = F.when(F.col("_removed").isNull(), F.col(f"_row.`{text_col}`")).otherwise(kept)
    return out.select(*[new.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in df.columns])
