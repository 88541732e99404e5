"""Helpers shared by the training-data operators: shared-folder tables, vectorised text hashing, cell tables.

Text hashing works on the UTF-8 bytes of a whole Arrow batch.  A span hash is the polynomial prefix sum of
its bytes, shifted to the span's start and mixed, so any number of spans (words, k-mers) costs a few NumPy
passes over the batch and no per-row Python.
"""

from __future__ import annotations

import ctypes
import uuid
import zlib
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.session import shared_folder

U64 = np.uint64
#: Bytes of text that one vectorised pass looks at (a longer text is a pass of its own).
PASS_BYTES = 1 << 17


# ---- tables in the shared folder -------------------------------------------------------------------------
def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet into the cluster's shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


# ---- memory of the Python workers -------------------------------------------------------------------------
def hand_back() -> None:
    """Give freed memory back to the system, Arrow's and the C library's (where it can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """``run`` for mapInArrow, with its memory handed back when a task ends: Spark keeps idle workers for later tasks."""

    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return task


# ---- hashing ---------------------------------------------------------------------------------------------
def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, PASS_BYTES + 1)
        for key, base in (("p", _BASE), ("q", _INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
        if size > 4 * PASS_BYTES:  # tables for one very long text are not kept
            return _POW.pop("p"), _POW.pop("q")
    return _POW["p"], _POW["q"]


class SpanHash:
    """Hashes of byte spans [start, end) of one buffer; equal byte strings have equal hashes anywhere."""

    def __init__(self, buf: np.ndarray):
        p, self._q = _powers(len(buf) + 1)
        self._sum = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE[buf] * p[: len(buf)], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * self._q[start]
        return mix64(h + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_buffers(col: pa.Array, size: int = 0):
    """(first row, buffer, offsets) for runs of whole texts of about ``size`` bytes; null texts are empty."""
    size = size or PASS_BYTES
    col = pc_fill(col)
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(col):
        stop = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield row, data[off[row] : off[stop]], (off[row : stop + 1] - off[row])
        row = stop


def pc_fill(col: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(col.cast(pa.large_string()), "")


def word_spans(buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, none across a break, and the break each is in.

    ``breaks``: ascending offsets (0 … len(buf)) of the segments; segment i is [breaks[i], breaks[i+1])."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(buf))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(breaks, start, "right") - 1


# ---- tables of a fixed number of cells -------------------------------------------------------------------
BLOCKS = 64


def sum_cells(partials: DataFrame, cells: int, dtype: str = "int64") -> np.ndarray:
    """Add up per-task cell blocks (block int, data: deflated cells of ``dtype``) and return the whole table.

    The table has a fixed number of cells, whatever the input, so it may go to the driver and be broadcast.
    Tasks send their blocks on to sqrt-many groups first, so that no task reads what all tasks have sent."""

    return _fold_cells(partials, cells // BLOCKS, dtype, np.add)


def _fold_cells(partials: DataFrame, width: int, dtype: str, op) -> np.ndarray:
    def fold(key, pdf):
        import pandas as pd

        total = np.zeros(width, dtype)
        for d in pdf["data"]:
            op(total, np.frombuffer(zlib.decompress(d), dtype), out=total)
        return pd.DataFrame({"block": [key[0]], "data": [zlib.compress(total.tobytes(), 1)]})

    schema = "block int, data binary"
    n = max(1, int(partials.sparkSession.sparkContext.defaultParallelism ** 0.5))
    part = (F.abs(F.hash(F.xxhash64("data"))) % n).alias("part")
    once = partials.select("block", "data", part).groupBy("block", "part").applyInPandas(fold, schema)
    rows = once.groupBy("block").applyInPandas(fold, schema).collect()
    out = np.zeros((BLOCKS, width), dtype)
    for r in rows:
        out[r["block"]] = np.frombuffer(zlib.decompress(r["data"]), dtype)
    return out.reshape(-1)


def cell_blocks(table: np.ndarray) -> pa.RecordBatch:
    rows = table.reshape(BLOCKS, -1)
    used = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([zlib.compress(rows[i].tobytes(), 1) for i in used], pa.binary())],
                                      ["block", "data"])


BLOOM_BITS = (1 << 24, 1 << 28)


def bloom(ids: DataFrame, n: int = 0, tags=None) -> np.ndarray:
    """Two-hash Bloom filter of a 64-bit column: 8 flags and more for each of ``n`` ids, packed, 2 to 32 MB.

    With ``tags`` the ids are what it returns for the columns, as arrays.  It runs in the same Python worker: one mapInArrow
    on another would take two workers a task, and executors keep them all.  The filter only spares work: what it lets
    through wrongly is dropped by the join that follows."""
    size = min(max(BLOOM_BITS[0], 1 << (8 * n).bit_length()), BLOOM_BITS[1])

    def flags(batches):
        seen = np.zeros(size, np.uint8)
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            for cell in bloom_cells(tags(*cols) if tags else cols[0], size):
                seen[cell] = 1
        yield cell_blocks(np.packbits(seen))

    return _fold_cells(ids.mapInArrow(lean(flags), "block int, data binary"), size // 8 // BLOCKS, "uint8", np.bitwise_or)


def bloom_cells(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(ids.view(U64))
    return (h & U64(size - 1)).astype(np.int64), ((h >> U64(32)) & U64(size - 1)).astype(np.int64)


def bloom_has(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    hit = np.ones(len(ids), bool)
    for cell in bloom_cells(ids, 8 * len(bits)):
        hit &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's bigint (same bits)."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# ---- folds and labelled samples --------------------------------------------------------------------------
def crc_fold(id_, folds: int):
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(id_.cast("string").cast("binary")) % folds


def held_out(id_, folds: int, fold: int):
    """Whether the id is in the held-out fold; a null id is not (and is never learned from either)."""
    return F.coalesce(crc_fold(id_, folds) == fold, F.lit(False))


def uniform(seed: str, id_):
    """A number in [0, 1) that depends on the seed and the id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), id_.cast("string")), F.lit(1 << 30)) / float(1 << 30)


def learnable(labels: DataFrame, id_col: str, label_col: str, folds: int, fold: int) -> DataFrame:
    """The distinct (id, label) outside the held-out fold, without null ids and labels."""
    got = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    return got.where(crc_fold(F.col("id"), folds) != fold).distinct()


def sample_labels(labels: DataFrame, id_col: str, label_col: str, folds: int, fold: int, rows: int, per_class: bool = False) -> DataFrame:
    """(id, label) outside the held-out fold: all of them, or a hash sample of ``rows`` in expectation.

    With ``per_class`` each label value has ``rows``.  Rows with null id or label are left out, repeats count once."""
    got = learnable(labels, id_col, label_col, folds, fold)
    counts = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} if per_class else {None: got.count()}
    keep = F.lit(False)
    for label, n in counts.items():
        drawn = uniform("sample", F.col("id")) < min(1.0, rows / max(n, 1))
        keep = keep | (drawn if label is None else (F.col("label") == label) & drawn)
    return got.where(keep)
