"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

1. One pass over the texts computes STATS for every document, vectorised over whole Arrow batches.
2. Labelled rows are standardised and mapped to RFF cosines, which approximate a Gaussian kernel; each
   partition sums its normal equations (ΦᵀΦ, Φᵀy), blocks of rows are added up by key, and the driver solves
   one (FEATURES+1)² ridge system, whatever the number of rows.
3. Ridge scores of rows that the fit has not seen are calibrated by isotonic regression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import LOWER, SPACE, SpanHash, held_out, materialize, sample_labels, text_buffers, word_spans

STATS = ["log_bytes", "log_words", "word_len", "upper", "digit", "mark", "comma", "stop", "bang", "pipe", "space", "line", "high",
         "distinct_words", "top_word", "twice", "no_letter", "distinct_lines", "top_line", "line_len", "long_word", "cap_words"]
#: Cosines, ridge weight, width of the kernel in standard deviations, and the seed of the random directions.
FEATURES = 384
RIDGE = 1e-3
WIDTH = 4.0
SEED = 7
#: Labelled rows that fit and calibrate, at most (expected size of a hash sample; all below that).
FIT_ROWS = 200_000
CALIBRATE_ROWS = 20_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS = {
    "upper": np.isin(np.arange(256), range(65, 91)), "digit": np.isin(np.arange(256), range(48, 58)),
    "mark": np.isin(np.arange(256), [*b"\"'#$%&*+/<=>@[]\\^_`{}~();:-"]), "comma": np.arange(256) == 44, "stop": np.arange(256) == 46,
    "bang": np.isin(np.arange(256), [33, 63]), "pipe": np.arange(256) == 124, "space": SPACE, "line": np.arange(256) == 10,
    "high": np.arange(256) >= 128,
}


def _runs(group: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes and the largest count of one hash, for each of n groups."""
    key = np.sort((group.astype(np.uint64) << np.uint64(43)) | (h >> np.uint64(21)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    of = (key[first] >> np.uint64(43)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.r_[first, len(key)]))
    return np.bincount(of, minlength=n).astype(float), most


def stats(col: pa.Array) -> np.ndarray:
    """STATS of each text (null: as empty; an empty text has zeros)."""
    out = np.zeros((len(col), len(STATS)))
    at = {s: i for i, s in enumerate(STATS)}
    for row, buf, off in text_buffers(col):
        n = len(off) - 1
        if not len(buf):
            continue
        x = out[row : row + n]
        size = np.diff(off).astype(float)
        per = np.maximum(size, 1)

        def share(flags):
            c = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(flags, out=c[1:])
            return c, (c[off[1:]] - c[off[:-1]]) / per

        for name, table in _CLASS.items():
            x[:, at[name]] = share(table[buf])[1]
        letters, _ = share(_LETTER[buf])
        uppers, _ = share(_CLASS["upper"][buf])
        start, end, doc = word_spans(buf, off)
        spans = SpanHash(LOWER[buf])
        words = np.bincount(doc, minlength=n).astype(float)
        some = np.maximum(words, 1)
        h, length = spans(start, end), end - start
        distinct, most = _runs(doc, h, n)
        long = np.zeros(n)
        np.maximum.at(long, doc, length)
        twice = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(h) > 1 else 0
        no_letter = np.bincount(doc[letters[end] == letters[start]], minlength=n)
        caps = np.bincount(doc[(uppers[end] - uppers[start]) * 2 > length], minlength=n)
        cuts = np.unique(np.r_[off[:-1], np.flatnonzero(buf == 10) + 1, off[-1]])
        ls, le = cuts[:-1], cuts[1:]
        of = np.searchsorted(off, ls, "right") - 1
        lines = np.bincount(of, minlength=n).astype(float)
        d_lines, m_lines = _runs(of, spans(ls, le), n)
        per_line = np.maximum(lines, 1)
        for name, v in (("log_bytes", np.log1p(size)), ("log_words", np.log1p(words)), ("word_len", (size - x[:, at["space"]] * size) / some),
                        ("distinct_words", distinct / some), ("top_word", most / some), ("twice", twice / some), ("no_letter", no_letter / some),
                        ("distinct_lines", d_lines / per_line), ("top_line", m_lines / per_line), ("line_len", np.log1p(size / per_line)),
                        ("long_word", np.log1p(long)), ("cap_words", caps / some)):
            x[:, at[name]] = v
    return out


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>): STATS of every row's whole text."""

    def run(batches):
        for b in batches:
            x = stats(b.column(1))
            ends = pa.array(np.arange(0, x.size + 1, len(STATS), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], ["id", "x"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, x array<double>")


def _matrix(col) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False)).reshape(len(col), -1)


class Model:
    """Standardised statistics → cosines → ridge score → calibrated share of label 1."""

    def __init__(self, mean, sd):
        rng = np.random.default_rng(SEED)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.xs, self.ys = np.zeros(1), np.zeros(1)

    def phi(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.c_[np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.phi(x[i : i + 4096]) @ self.beta for i in range(0, len(x), 4096)] or [np.zeros(0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)  # a trace of it orders rows inside a block
        return 0.998 * np.clip(np.interp(raw, self.xs, self.ys), 0, 1) + 0.002 * np.clip(raw, 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the knots of its blocks (first and last raw score, mean label)."""
    order = np.argsort(raw, kind="stable")
    blocks: list[tuple] = []  # sum of labels, count, first and last raw score
    for r, t in zip(raw[order], y[order]):
        blocks.append((float(t), 1, float(r), float(r)))
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top, low = blocks.pop(), blocks.pop()
            blocks.append((low[0] + top[0], low[1] + top[1], low[2], top[3]))
    b = np.array(blocks)
    ys = np.maximum.accumulate((b[:, 0] + 0.5) / (b[:, 1] + 1))  # half a case each way keeps the ends off 0 and 1
    return b[:, 2:].reshape(-1), np.repeat(ys, 2)


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = 5, fold: int = 0) -> Model | None:
    """Fit on the labelled rows of ``table`` (id, x) outside the held-out fold; None if a class has no row.

    ``labels`` joins by id: the sampled ids (FIT_ROWS + CALIBRATE_ROWS at most) are few numbers, and the
    statistics are small rows, so this join never moves a text."""
    got = sample_labels(labels, id_col, label_col, folds, fold, FIT_ROWS + CALIBRATE_ROWS)
    rows = table.join(got.withColumnRenamed("id", "id"), "id").select("id", "x", F.col("label").cast("double").alias("y"))
    rows = materialize(rows, "labelled")
    u = F.pmod(F.xxhash64(F.lit("fit"), F.col("id").cast("string")), F.lit(1_000_000)) / 1_000_000
    total = rows.count()
    part = max(0.2, 1 - FIT_ROWS / total) if total else 0.2  # share that calibrates
    fit_rows, cal = rows.where(u >= part), rows.where(u < part)
    xs = [F.col("x")[i] for i in range(len(STATS))]
    m = fit_rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(xs)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(xs)]).first()
    if not m["n"] or not 0 < m["y"] < m["n"]:
        return None
    model = Model(np.array([m[f"m{i}"] for i in range(len(STATS))]), np.array([m[f"s{i}"] for i in range(len(STATS))]))
    d = FEATURES + 1

    def normal(batches):
        a = np.zeros((d, d + 1))
        for b in batches:
            phi = model.phi(_matrix(b.column(0)))
            a[:, :d] += phi.T @ phi
            a[:, d] += phi.T @ b.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([r.tobytes() for r in a], pa.binary())], ["i", "row"])

    def add(key, pdf):
        import pandas as pd

        total = np.sum([np.frombuffer(r) for r in pdf["row"]], axis=0)
        return pd.DataFrame({"i": [int(key[0])], "row": [total.tobytes()]})

    parts = fit_rows.select("x", "y").mapInArrow(normal, "i int, row binary")
    a = np.zeros((d, d + 1))
    for r in parts.groupBy("i").applyInPandas(add, "i int, row binary").collect():  # d rows, whatever the input
        a[r["i"]] = np.frombuffer(r["row"])
    reg = RIDGE * m["n"] / FEATURES * np.eye(d)
    reg[-1, -1] = 0
    model.beta = np.linalg.solve(a[:, :d] + reg, a[:, d])

    cal_x, cal_y = [], []
    for r in cal.select("x", "y").collect():  # CALIBRATE_ROWS at most, in expectation
        cal_x.append(r["x"])
        cal_y.append(r["y"])
    if not cal_y:
        cal_x, cal_y = [list(model.mean)], [m["y"] / m["n"]]
    model.xs, model.ys = isotonic(model.raw(np.array(cal_x)), np.array(cal_y))
    return model


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             folds: int = 5, fold: int = 0, cut: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Null and empty texts are scored by their statistics (zeros).  A null id is never learned from and not
    held out; rows that repeat an id are scored each by its text.  Without labelled rows of both classes the
    score is 0.5.  Labels and all columns but the text stay out of the score."""
    table = materialize(statistics(df, id_col, text_col), "stats")
    model = fit(table, labels, id_col, label_col, folds, fold)

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column(1))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["id", "score"])

    kind = table.schema["id"].dataType.simpleString()
    return (table.mapInArrow(run, f"id {kind}, score double")
            .select("id", held_out(F.col("id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")))
