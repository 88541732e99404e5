"""Language identification in two steps: the family first, then linear SVMs between the languages of it.

A text is the mean of its hashed byte n-grams (lower-cased ASCII, everything but letters blank).  A linear
SVM per family against the rest picks the family; inside it one SVM for each pair of languages votes.  All
weight vectors are applied at once by gathering their columns for every n-gram of a batch, so a batch costs a
few NumPy passes.  Training reads a bounded hash sample of the labelled rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import LOWER, crc_fold, hand_back, held_out, lean, text_buffers, uniform

CELLS = 4096
ORDERS = (1, 2, 3)
#: Labelled documents that train, over all languages (expected size of a hash sample).
SAMPLE_DOCS = 2_400
STEPS = 100
PENALTY = 1e-4
UNKNOWN = "und"
#: Below this the chosen classifier votes against its own choice.
MIN_SCORE = 0.5
# Language codes by family; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "da", "sv", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "ur", "bn", "mr", "ne", "pa"],
}

_FOLD = LOWER.copy()
_FOLD[:128] = [b if 97 <= b <= 122 else 32 for b in LOWER[:128]]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def ngram_cells(buf: np.ndarray, off: np.ndarray):
    """(cells, text index) of all n-grams inside the texts, order by order; blank-only n-grams are left out."""
    b = _FOLD[buf].astype(np.uint32)
    last = np.repeat(off[1:], np.diff(off))  # the end of each byte's text
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(len(b))
    for n in ORDERS:
        code, blank = np.zeros(len(b), np.uint32), np.ones(len(b), bool)
        for k in range(n):
            shifted = np.zeros(len(b), np.uint32)
            shifted[: len(b) - k] = b[k:]
            code = code * np.uint32(0x01000193) + shifted + np.uint32(n)
            blank &= shifted == 32
        ok = (at + n <= last) & ~blank
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        code ^= code >> np.uint32(12)
        yield (code[ok] & np.uint32(CELLS - 1)).astype(np.int64), doc[ok]


def profile(text: str) -> np.ndarray:
    """Shares of the hashed n-grams of one whole text."""
    total, n = np.zeros(CELLS), 0
    for _, buf, off in text_buffers(pa.array([text], pa.large_string())):
        for cells, _ in ngram_cells(buf, off):
            total += np.bincount(cells, minlength=CELLS)
            n += len(cells)
    return total / max(n, 1)


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Linear SVM (squared hinge, L2) by accelerated gradient steps; the last column of ``x`` is 1.  y is ±1."""
    y = y.astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (2 * np.linalg.norm(x @ v) ** 2 / len(x) + PENALTY)
    share = (np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2).astype(np.float32)  # classes weigh the same
    step = np.float32(step)
    w = z = np.zeros(x.shape[1], np.float32)
    for t in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ z)) * share
        new = z - step * (np.float32(PENALTY) * z - 2 * x.T @ (y * slack) / np.float32(len(x)))
        z, w = new + np.float32(t / (t + 3)) * (new - w), new
    return w


class Model:
    """langs, families; columns of ``weights``: a classifier per family, then one per pair of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(c) for c in self.langs})
        y = np.array(langs)
        fam = np.array([family_of(c) for c in langs])
        self.mean = x.mean(axis=0, dtype=float)
        # Some rows or columns at a time, so that the driver holds the profiles once more in single precision only.
        self.scale = 1 / (np.concatenate([x[:, i : i + 512].std(axis=0, dtype=float) for i in range(0, CELLS, 512)]) + 1e-4)
        z = np.ones((len(x), CELLS + 1), np.float32)
        for i in range(0, len(x), 64):
            z[i : i + 64, :-1] = (x[i : i + 64] - self.mean) * self.scale / np.sqrt(CELLS)
        self.pairs = [(a, b) for a, b in combinations(self.langs, 2) if family_of(a) == family_of(b)]
        cols = [svm(z, np.where(fam == f, 1.0, -1.0)) for f in self.families if len(self.families) > 1]
        for a, b in self.pairs:
            of = (y == a) | (y == b)
            cols.append(svm(z[of], np.where(y[of] == a, 1.0, -1.0)))
        w = np.array(cols).reshape(len(cols), CELLS + 1)
        # Folded into weights on the plain shares, so that a text's margin is a mean over its n-grams.
        self.bias = w[:, -1] - (w[:, :-1] * (self.mean * self.scale / np.sqrt(CELLS))).sum(axis=1)
        self.weights = np.ascontiguousarray((w[:, :-1] * self.scale / np.sqrt(CELLS)).T.astype(np.float32))

    def margins(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        total, count = np.zeros((n, len(self.bias))), np.zeros(n)
        for cells, doc in ngram_cells(buf, off):
            if len(cells):
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                total[doc[first]] += np.add.reduceat(self.weights[cells], first, axis=0)
                count += np.bincount(doc, minlength=n)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predicted language and a score in [0, 1] for rows of margins."""
        n, nf = len(m), len(self.families) if len(self.families) > 1 else 0
        fam = np.argmax(m[:, :nf], axis=1) if nf else np.zeros(n, int)
        sure = np.max(m[:, :nf], axis=1) if nf else np.full(n, 5.0)
        votes, sums = np.zeros((n, len(self.langs))), np.zeros((n, len(self.langs)))
        low = np.full((n, len(self.langs)), 5.0)
        for k, (a, b) in enumerate(self.pairs):
            v = m[:, nf + k]
            for lang, s in ((a, v), (b, -v)):
                i = self.langs.index(lang)
                votes[:, i] += s > 0
                sums[:, i] += np.tanh(s)
                low[:, i] = np.minimum(low[:, i], s)
        inside = np.array([[family_of(c) == f for c in self.langs] for f in self.families])[fam]
        rank = np.where(inside, votes + 1e-3 * sums, -np.inf)
        best = np.argmax(rank, axis=1)
        margin = np.minimum(sure, low[np.arange(n), best])
        return np.array(self.langs, object)[best], 1 / (1 + np.exp(-2 * np.clip(margin, -15, 15)))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> Model | None:
    """Fit on a sample of rows with a language outside the held-out fold; None if there is none.

    Each language gets an equal part of SAMPLE_DOCS (all its rows if it has fewer).  Tasks turn the sampled
    texts into profiles of CELLS shares; only those reach the driver."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    src = src.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("id"), folds) != fold))
    counts = {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE_DOCS / len(counts) / n))).otherwise(share)

    def profiles(batches):
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = [(t, c) for t, c in zip(texts, langs) if any(map(str.isalpha, t))]
            yield pa.RecordBatch.from_arrays([pa.array([profile(t).astype(np.float32).tobytes() for t, _ in keep], pa.binary()),
                                              pa.array([c for _, c in keep], pa.string())], ["x", "lang"])

    sample = src.where(uniform("lang", F.col("id")) < share).select("text", "lang").mapInArrow(lean(profiles), "x binary, lang string")
    rows = sorted((r["lang"], bytes(r["x"])) for r in sample.collect())
    if not rows:
        return None
    return Model(np.frombuffer(b"".join(x for _, x in rows), np.float32).reshape(len(rows), CELLS), [c for c, _ in rows])


def predictor(model: Model | None):
    """A column function from text to struct(lang_pred, score)."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(col: pa.Array) -> pa.Array:
        lang, score = np.full(len(col), UNKNOWN, object), np.zeros(len(col))
        for row, buf, off in text_buffers(col) if model else ():
            n = len(off) - 1
            letters = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(_LETTER[buf], out=letters[1:])
            known = letters[off[1:]] > letters[off[:-1]]
            for i in np.flatnonzero(~known):
                known[i] = any(map(str.isalpha, bytes(buf[off[i] : off[i + 1]]).decode("utf-8", "replace")))
            pred, s = model.predict(model.margins(buf, off))
            lang[row : row + n] = np.where(known, pred, UNKNOWN)
            score[row : row + n] = np.where(known, s, 0.0)
        hand_back()  # this worker may be idle from here on
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return predict


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row's whole text.

    A null text, one without a letter, and any text when nothing could be learned, is UNKNOWN with score 0.
    A null id is never learned from and not held out; rows that repeat an id are predicted each by its text.
    Language, source and id stay out of the prediction."""
    predict = predictor(fit(df, id_col, text_col, lang_col, folds, fold))
    src = df.select(F.col(id_col).alias("id"), predict(F.col(text_col).cast("string")).alias("p"))
    return src.select("id", held_out(F.col("id"), folds, fold).alias("held_out"), "p.lang_pred", "p.score")


def keep_known(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2,
               min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``df`` whose language is predicted with a score of at least ``min_score``; columns unchanged."""
    predict = predictor(fit(df, id_col, text_col, lang_col, folds, fold))
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    out = wide.withColumn("_p", predict(F.col(f"_row.`{text_col}`").cast("string")))
    return out.where((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= min_score)).select("_row.*")
