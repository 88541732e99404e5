"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pairs waiting to be merged lie in one bucket per merge rank; a bucket holds positions of a linked list of
tokens.  A two-level bitmap says which buckets are not empty, and find-first-set on it gives the next rank in
constant time.  Merging at a position changes the pairs beside it; entries that no longer hold their pair are
stale and skipped when popped.  A pre-token of n bytes therefore costs O(n log n) at most, however long it is.

Rows are independent: the scan's partitions are the tasks, no shuffle, and each Python worker keeps the
vocabulary and a bounded memo of short pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import lean

#: Short pre-tokens whose ids a worker remembers (two generations of this many), and what counts as short.
MEMO_ENTRIES = 500_000
MEMO_CHARS = 64


class ByteBPE:
    """Encoder and decoder for a table of token bytes → rank and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._new, self._old = {}, {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token (at least one byte)."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        # The token at i is piece[i:after[i]]; pair[i] is the rank of it joined with the next one, -1 for none.
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = ranks.get
        pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        # top flags the words that have a flag, a word flags the non-empty buckets of 256 ranks.
        top, words, buckets = 0, {}, {}
        for i, r in enumerate(pair):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)  # ascending: a heap already
                else:
                    buckets[r] = [i]
                    w = r >> 8
                    if w in words:
                        words[w] |= 1 << (r & 255)
                    else:
                        words[w] = 1 << (r & 255)
                        top |= 1 << w
        while top:
            w = (top & -top).bit_length() - 1
            flags = words[w]
            rank = w << 8 | (flags & -flags).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                flags &= flags - 1
                if flags:
                    words[w] = flags
                else:
                    del words[w]
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale: a merge beside it took one of its tokens
            j = after[i]
            k = after[i] = after[j]
            pair[i] = pair[j] = -1
            for p in (before[i], i):
                if p >= 0 and (q := after[p]) < n:
                    r = pair[p] = rank_of(piece[p : after[q]], -1)
                    if r >= 0:
                        if r in buckets:
                            heappush(buckets[r], p)
                        else:
                            buckets[r] = [p]
                            w = r >> 8
                            if w in words:
                                words[w] |= 1 << (r & 255)
                            else:
                                words[w] = 1 << (r & 255)
                                top |= 1 << w
            if k < n:
                before[k] = i
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _packed(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            ids = np.array(self.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self._new) >= MEMO_ENTRIES:
                self._old, self._new = self._new, {}
            self._new[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        get, packed = self._new.get, self._packed
        out = []
        for p in self.pieces(text):
            ids = get(p)
            if ids is None:
                ids = packed(p)
                get = self._new.get
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The coder of a rank file (base64 token, space, rank on each line), once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ByteBPE(ranks, pattern)


def _vocabulary(path, pattern):
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return path, pattern


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """(id, ids array<bigint>) of every row's whole text.

    Null and empty texts have no ids.  Every row gives one row: repeated rows and null ids stay as they are,
    other columns are ignored.  ``path`` is the rank file, which every machine must have."""
    path, pattern = _vocabulary(path, pattern)

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            packed = [bpe.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run), f"id {src.schema['id'].dataType.simpleString()}, ids array<bigint>")


def decode(df: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """(id, data binary): the bytes that each row's ids stand for; null ids give no bytes."""
    path, pattern = _vocabulary(path, pattern)

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            out = [bpe.decode(np.asarray(ids or [], "<u4").tobytes()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "data"])

    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return src.mapInArrow(lean(run), f"id {src.schema['id'].dataType.simpleString()}, data binary")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
            pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes every whole text, decodes the ids, digests both.

    Same rows and rules as ``encode``; the ids stay inside the task, so no row carries a long array."""
    path, pattern = _vocabulary(path, pattern)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t) if t else b""
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names)

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run), f"id {src.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
