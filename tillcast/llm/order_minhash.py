"""Order MinHash fingerprints, sensitive to edit distance.

The k-mers of a text are numbered by occurrence, so a repeated one is several elements.  For each of BINS
orders the PICK smallest elements are selected; their k-mers, put back into text order and hashed as a tuple,
are one component of the fingerprint.  The likeness of two fingerprints is their share of equal components.

All orders come from one pass over the elements: in round r an element falls into one pseudo-random bin with
a pseudo-random value, and (r, value) is its place in that bin's order.  Long texts need one round; short ones
as many as it takes, and a last sweep brings every element to every bin.  Everything is vectorised over all
texts of a pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import U64, SpanHash, mix64, text_buffers

KMER = 8
BINS = 64
PICK = 2
_BIN_BITS = 6
#: Arrivals per bin that a long text's filter keeps, and that the random rounds aim at before the sweep.
KEPT, ARRIVALS = 12, 8
_ROUNDS = 64
#: Range parts per shuffle partition: small parts even out.
PARTS = 4


def _elements(buf: np.ndarray, off: np.ndarray):
    """(text, position, k-mer hash, element hash) of all occurrence-numbered k-mers, and code points per text."""
    head = (buf & 0xC0) != 0x80
    start = np.flatnonzero(head)
    upto = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(head, out=upto[1:])
    upto = upto[off]
    n = np.diff(upto)
    count = np.where(n > 0, np.maximum(n - KMER + 1, 1), 0)
    of = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(of)) + np.repeat(upto[:-1] - (np.cumsum(count) - count), count)
    edge = np.concatenate([start, [len(buf)]])
    stop = edge[np.minimum(first + KMER, np.repeat(upto[1:], count))]
    gram = SpanHash(buf)(edge[first], stop) if len(of) else np.zeros(0, U64)
    # Occurrences: sort by (hash salted with the text, position) in one 64-bit key.
    bits = U64(max(1, int(len(of)).bit_length()))
    own = mix64(gram + of.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    order = (np.sort(((own >> bits) << bits) | np.arange(len(of), dtype=U64)) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    again = np.zeros(len(of), bool)
    again[1:] = own[order[1:]] == own[order[:-1]]
    dup = np.flatnonzero(again)
    elem = mix64(gram)
    if len(dup):
        run = np.arange(len(of))
        run[again] = 0
        occ = dup - np.maximum.accumulate(run)[dup]
        where = order[dup]
        elem[where] = mix64(gram[where] + occ.astype(U64) * U64(0x9FB21C651E98DF25))
    return of, np.arange(len(of)), gram, elem, n


def _smallest(key_bin, rank, elem_index, elem, bins):
    """Per bin, the indexes of its PICK smallest distinct elements by rank (-1 where there are fewer)."""
    room = U64(64 - max(1, int(bins).bit_length()))
    order = np.argsort((key_bin.astype(U64) << room) | (rank >> (U64(64) - room)))
    out = np.full((bins, PICK), -1, np.int64)
    b, e = key_bin[order], elem_index[order]
    h = elem[e]
    for p in range(PICK):
        free = np.ones(len(b), bool)
        for q in range(p):
            taken = out[b, q]
            free &= (taken >= 0) & (h != elem[taken])
        at = np.flatnonzero(free)
        first = np.ones(len(at), bool)
        first[1:] = b[at[1:]] != b[at[:-1]]
        out[b[at[first]], p] = e[at[first]]
    return out


def fingerprints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(BINS 32-bit components per text, code points per text); null is as empty, equal texts have equal rows."""
    sig = np.zeros((len(col), BINS), np.uint32)
    chars = np.zeros(len(col), np.int64)
    for row, buf, off in text_buffers(col):
        m = len(off) - 1
        of, pos, gram, elem, chars[row : row + m] = _elements(buf, off)
        size = np.bincount(of, minlength=m)
        picked = np.full((m * BINS, PICK), -1, np.int64)
        # Round 0 in long texts: only values low enough to be among the smallest of a bin are sorted.
        low = elem << U64(_BIN_BITS)
        limit = np.full(m, 2**64 - 1, U64)
        many = size > 2 * KEPT * BINS
        limit[many] = (KEPT * BINS / size[many] * 2.0**64).astype(U64)
        limit[size < ARRIVALS * BINS] = 0  # too short for one round
        keep = np.flatnonzero(low < np.repeat(limit, size))
        if len(keep):
            bins = of[keep] * BINS + (elem[keep] >> U64(64 - _BIN_BITS)).astype(np.int64)
            picked = _smallest(bins, low[keep], keep, elem, m * BINS)
        want = np.minimum(size, PICK)
        short = (picked >= 0).reshape(m, BINS, PICK).sum(axis=2).min(axis=1) < want
        if short.any():
            _rounds(np.flatnonzero(short), of, elem, size, picked)
        sig[row : row + m] = _tuples(picked, pos, gram).reshape(m, BINS)
    return sig, chars


def _rounds(texts, of, elem, size, picked):
    """Select for texts that one round does not fill: random rounds, then the sweep over all bins."""
    code = np.full(len(size), -1)
    code[texts] = np.arange(len(texts))
    mine = np.flatnonzero(code[of] >= 0)
    todo = code[of[mine]]
    rounds = np.minimum(_ROUNDS, ARRIVALS * BINS // np.maximum(size[texts], 1) + 1)
    parts = []
    for r in range(int(rounds.max())):
        on = mine[rounds[todo] > r]
        u = mix64(elem[on] + U64(r * 0xA0761D6478BD642F % 2**64)) if r else elem[on]
        parts.append((code[of[on]] * BINS + (u >> U64(64 - _BIN_BITS)).astype(np.int64), (U64(r) << U64(56)) | ((u << U64(_BIN_BITS)) >> U64(8)), on))
    out = _smallest(*(np.concatenate(x) for x in zip(*parts)), elem, len(texts) * BINS)
    filled = (out >= 0).reshape(len(texts), BINS, PICK).sum(axis=2).min(axis=1)
    rest = np.flatnonzero(filled < np.minimum(size[texts], PICK))
    if len(rest):
        # The sweep: in round _ROUNDS + s an element is in bin (element + s) mod BINS.
        sub = np.full(len(texts), -1)
        sub[rest] = np.arange(len(rest))
        on = mine[sub[todo] >= 0]
        u = mix64(elem[on] ^ U64(0xE7037ED1A0B428DB))
        for s in range(BINS):
            parts.append((code[of[on]] * BINS + ((u & U64(BINS - 1)).astype(np.int64) + s) % BINS, (U64(_ROUNDS + s) << U64(56)) | (u >> U64(8)), on))
        b, k, e = (np.concatenate(x) for x in zip(*parts))
        some = sub[b // BINS] >= 0
        again = _smallest(b[some], k[some], e[some], elem, len(texts) * BINS).reshape(len(texts), BINS * PICK)
        out.reshape(len(texts), BINS * PICK)[rest] = again[rest]
    picked.reshape(len(size), BINS * PICK)[texts] = out.reshape(len(texts), BINS * PICK)


def _tuples(picked, pos, gram):
    """Hash each bin's k-mers in text order."""
    none = picked < 0
    if not len(pos):  # only empty texts
        pos, gram = np.zeros(1, np.int64), np.zeros(1, U64)
    order = np.argsort(np.where(none, np.iinfo(np.int64).max, pos[picked]), axis=1, kind="stable")
    h = np.zeros(len(picked), U64)
    for p in range(PICK):
        at = np.take_along_axis(picked, order[:, p : p + 1], axis=1)[:, 0]
        h = mix64(h * U64(0x8EBC6AF09C88C6E3) + np.where(at < 0, U64(p + 1), gram[at]))
    return (h >> U64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _part(splits: list[int], key):
    """Index of the range that ``key`` is in, as a balanced tree of comparisons."""
    def tree(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(splits[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(splits))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, extra, id, text) so that in each part the rows with extra = 0 are in ascending id, and the row
    after them (extra = 1) is the first one of the next part; the last part ends with the table's first row.

    One shuffle of the texts.  Only range bounds and one id per range reach the driver.  Null ids come last;
    rows that repeat an id are ordered by a hash of their text."""
    spark = df.sparkSession
    top = (1 << 63) - 1
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    key = F.coalesce(F.col("id"), F.lit(top))
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * PARTS
    ids = src.select(key.alias("key"))
    bounds = sorted(set(ids.approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    bounds = [min(int(b), top) for b in bounds]  # quantiles come back as doubles
    part = _part(bounds, key)
    firsts = sorted((r["part"], r["first"]) for r in ids.select(_part(bounds, F.col("key")).alias("part"), "key")
                    .groupBy("part").agg(F.min("key").alias("first")).collect())
    ends = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "key bigint, before int")
    rows = src.withColumns({"key": key, "part": part}).join(F.broadcast(ends), "key", "left")  # one row per part
    places = F.array(F.struct("part", F.lit(0).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(1).alias("extra")))
    places = F.when(F.col("before").isNull(), F.slice(places, 1, 1)).otherwise(places)
    rows = rows.select(F.explode(places).alias("p"), "key", "id", "text").select("p.part", "p.extra", "key", "id", "text")
    return (rows.repartition(max(1, n // PARTS), "part")
            .sortWithinPartitions("part", "extra", "key", F.xxhash64("text")).select("part", "extra", "id", "text"))


def compare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row's whole text and of its edited text (its last half replaced by the first as
    many code points of the next row's text), with the likeness of both and to the next row's.

    Null texts are empty; a single row is its own next; null ids come last and repeated ids are ordered by
    their text.  An empty table gives no rows."""
    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def results(ids, texts, sigs, chars, nexts, next_sigs):
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts)]
        esig, _ = fingerprints(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(chars), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([s.tobytes().hex() for s in sigs], pa.string()), pa.array([s.tobytes().hex() for s in esig], pa.string()),
            pa.array(likeness(sigs, esig)), pa.array(likeness(sigs, next_sigs))], names)

    def run(batches):
        held = None  # the last row, whose next one is still to come
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                part, extra, ids = (c.column(i).to_pylist() for i in range(3))
                texts = [t or "" for t in c.column(3).to_pylist()]
                sigs, chars = fingerprints(pa.array(texts, pa.large_string()))
                if held:
                    part, extra, ids, texts = held[0] + part, held[1] + extra, held[2] + ids, held[3] + texts
                    sigs, chars = np.concatenate([held[4], sigs]), np.concatenate([held[5], chars])
                i = [k for k in range(len(ids) - 1) if extra[k] == 0 and part[k + 1] == part[k]]
                if i:
                    j = [k + 1 for k in i]
                    yield results([ids[k] for k in i], [texts[k] for k in i], sigs[i], chars[i], [texts[k] for k in j], sigs[j])
                held = part[-1:], extra[-1:], ids[-1:], texts[-1:], sigs[-1:], chars[-1:]

    return with_next(df, id_col, text_col).mapInArrow(run, schema)
