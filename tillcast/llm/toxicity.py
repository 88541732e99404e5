"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Labels mark documents, and most of a toxic document is ordinary text, so the toxic dictionary holds the words
that set toxic documents apart: words that recur among them in several contexts (copies of one passage count
once), more often than chance explains, and are rare elsewhere.  Each is there once, so the dictionary grows
with the vocabulary.  The ordinary dictionary is trained on windows of ordinary documents.

A window of text is compressed twice, with the ordinary dictionary alone and followed by the toxic one; both
know ordinary text, so the bytes that the toxic one saves measure toxic content.  As pieces of toxic words are
ordinary, its words are also compressed as codes that match whole or not at all, without and with the toxic
words' codes.  Statistics of these savings over all windows of a text, at several thresholds, are calibrated
by logistic regression; each half of the sample is measured with dictionaries trained on the other half.

Training reads a bounded sample (the parameters below); scoring is map-only over whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import held_out, learnable, materialize, sample_labels, uniform

#: Labelled documents of each class that train.
SAMPLE_DOCS = 4_000
#: Bytes of sampled text that reach the driver, at most in expectation.
SAMPLE_BYTES = 64 << 20
WINDOW = 64
LEVEL = 3
#: Zstandard begins no match in the last 8 bytes: they follow every window.
PAD = bytes(range(8))
ORDINARY_BYTES = 32 << 10
#: Bytes of a word's code: with fewer, zstandard stores a window with a single match as it is.
CODE_BYTES = 16
#: Share of words that may be in the toxic vocabulary by chance, and how many times as common as elsewhere a word of it is.
FALSE_WORDS, MIN_RATIO = 0.05, 20.0
THRESHOLDS = (2, 3, 4, 5, 6, 7)

_CUT = re.compile(rb"[\s\S]{1,%d}(?:\s|$)|[\s\S]{1,%d}" % (WINDOW, WINDOW))
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def normal(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split()) + b" "


def _train(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself is the dictionary
        return b"".join(samples)[-size:]


@lru_cache(1 << 16)
def _code(word: bytes) -> bytes:
    return hashlib.blake2b(word, digest_size=CODE_BYTES).digest()


def coded(text: bytes) -> bytes:
    """The text's words as hashes of one length, which match whole or not at all."""
    return b"".join(map(_code, _WORD.findall(text)))


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.mean, self.sd, self.w = np.zeros(1), np.ones(1), np.zeros(2)
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window of the whole text: of the text, and of its words' codes."""
        if self._pair is None:
            self._pair = []
            for raw in (self.ordinary, self.ordinary + self.toxic, b"", coded(self.toxic)):
                data = zstandard.ZstdCompressionDict(raw or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(level=LEVEL)
                self._pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        plain, toxic, plain_coded, toxic_coded = self._pair
        windows = _CUT.findall(normal(text))
        codes = [coded(w) + PAD for w in windows]
        windows = [w + PAD for w in windows]
        return np.array([[len(plain(w)) - len(toxic(w)) for w in windows], [len(plain_coded(w)) - len(toxic_coded(w)) for w in codes]], float)

    def features(self, text: str | None) -> np.ndarray:
        out = []
        for s in self.savings(text):
            top = np.sort(np.r_[np.zeros(4), s])[-4:]
            out += [*top, *((s >= t).sum() / np.sqrt(len(s)) for t in THRESHOLDS), s.mean()]
        return np.array([*out, np.log(len(s))])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression with a small ridge, by Newton steps."""
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.sd]
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (p - y) + w * (np.arange(len(w)) > 0))
        self.w = w

    def score(self, text: str | None) -> float:
        v = self.w[0] + ((self.features(text) - self.mean) / self.sd) @ self.w[1:]
        return float(1 / (1 + np.exp(-np.clip(v, -30, 30))))


def _tails(n: int, share: float) -> np.ndarray:
    """P(X ≥ k) for k = 0 … n of a binomial count X of n."""
    logs = np.r_[0, np.cumsum(np.log(np.arange(1, n + 1)))]
    k = np.arange(n + 1)
    return np.minimum(1.0, np.cumsum(np.exp(logs[n] - logs - logs[::-1] + k * np.log(share) + (n - k) * np.log1p(-share))[::-1])[::-1])


def apart(in_toxic: dict[bytes, int], in_ordinary: dict[bytes, int], toxic: int, ordinary: int) -> list[bytes]:
    """The words that set toxic documents apart, the commonest last, from the number of documents with each word.

    A word's p-value is the chance that so many of its documents are toxic if it doesn't depend on the class.
    Words pass up to the largest p-value at which the words expected to pass by chance, each by the p-values
    that its number of documents can have, are at most the share FALSE_WORDS of those that do."""
    words = sorted(w for w in in_toxic if len(w) > 2)
    if not words or not ordinary:
        return []
    share = toxic / (toxic + ordinary)
    sizes = Counter(in_toxic.get(w, 0) + in_ordinary.get(w, 0) for w in {*in_toxic, *in_ordinary} if len(w) > 2)
    tails = {n: _tails(n, share) for n in sizes}
    p = np.array([tails[in_toxic[w] + in_ordinary.get(w, 0)][in_toxic[w]] for w in words])
    at = np.unique(p)
    chance = np.zeros(len(at))
    for n, m in sizes.items():
        up = tails[n][::-1]
        k = np.searchsorted(up, at, "right")
        chance += m * np.where(k > 0, up[np.maximum(k, 1) - 1], 0)
    fits = np.flatnonzero(chance <= FALSE_WORDS * np.searchsorted(np.sort(p), at, "right"))
    found = [w for w, x in zip(words, p) if len(fits) and x <= at[fits[-1]]
             and in_toxic[w] * ordinary > MIN_RATIO * (in_ordinary.get(w, 0) + 0.1) * toxic]
    return sorted(found, key=lambda w: (in_toxic[w], w))


def dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    """The two dictionaries; equal texts count once."""
    toxic, ordinary = [normal(t) for t in dict.fromkeys(toxic)], [normal(t) for t in dict.fromkeys(ordinary)]
    in_ordinary = Counter(w for t in ordinary for w in set(_WORD.findall(t)))
    seen, after = Counter(), defaultdict(set)
    for t in toxic:
        words = _WORD.findall(t)
        seen.update(set(words))
        for before, w in zip([b"", *words], words):
            after[w].add(before)
    in_toxic = {w: min(n, len(after[w])) for w, n in seen.items()}
    toxic_words = apart(in_toxic, in_ordinary, len(toxic), len(ordinary))
    windows = [w for t in ordinary for w in _CUT.findall(t)]
    return Model(_train(windows, ORDINARY_BYTES, 64, 8), b" " + b" ".join(toxic_words) + b" " if toxic_words else b"")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        folds: int = 4, fold: int = 2) -> Model | None:
    """Train on a bounded sample of the labelled rows outside the held-out fold; None if a class has too few.

    The sampled ids are few (SAMPLE_DOCS per class in expectation), so they are broadcast and no text is
    shuffled; SAMPLE_BYTES bounds what the driver reads of them, whole documents only."""
    ids = materialize(sample_labels(labels, id_col, label_col, folds, fold, SAMPLE_DOCS, per_class=True), "ids")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(src.join(F.broadcast(ids), "id"), "sample")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        rows = rows.where(uniform("bytes", F.col("id")) < SAMPLE_BYTES / size)
    got = sorted((r["id"], r["label"], r["text"] or "", r["u"]) for r in rows.withColumn("u", uniform("part", F.col("id"))).collect())
    half = {(h, k): [t for _, label, t, u in got if label == k and (u < 0.5) == h] for h in (True, False) for k in (0, 1)}
    if not all(half.values()):
        return None
    x, y = [], []
    for h in (True, False):
        other = dictionaries(half[not h, 1], half[not h, 0])
        for k in (0, 1):
            x += [other.features(t) for t in half[h, k]]
            y += [float(k)] * len(half[h, k])
    model, x, y = dictionaries(half[True, 1] + half[False, 1], half[True, 0] + half[False, 0]), np.array(x), np.array(y)
    model.calibrate(x, y)
    # Classes were sampled at different rates: move the intercept to their odds among all rows that may be learned from.
    true = {r["label"]: r["count"] for r in learnable(labels, id_col, label_col, folds, fold).groupBy("label").count().collect()}
    model.w[0] += np.log(true[1] / true[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             folds: int = 4, fold: int = 2, cut: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Null and empty texts have one blank window and are scored like any other.  A null id is never learned
    from and not held out; rows that repeat an id are scored each by its text.  Without labelled rows of both
    classes the score is 0.  Labels and all columns but the text stay out of the score."""
    model = fit(df, labels, id_col, text_col, label_col, folds, fold)

    def run(batches):
        for b in batches:
            s = [model.score(t) if model else 0.0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "score"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return (src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double")
            .select("id", held_out(F.col("id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")))
