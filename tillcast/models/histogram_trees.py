"""Growing of tree ensembles on binned rows, a level of many trees a pass; the result is a Spark ML model.

The rows are binned once (at most 32 bins a feature) and written: a byte a feature, the label and the weight.  A pass
streams them in chunks; a task walks each chunk down the trees so far and adds it to the histograms (weight, weighted
label, rows) of the nodes it opens, each over its own draw of features.  The tasks' histograms are merged and the best
splits taken per block of nodes, so the driver only sees one row a node.  A pass opens as many trees as fit
``PASS_BYTES`` of histograms in a task: memory grows neither with the rows nor with the trees.

It follows Spark ML's rules: Poisson(1) bootstrap, a draw of features a node, variance gain, least rows a child, bins cut
at the quantiles of the distinct values.  A row's draws come from a hash of its key, so the trees depend on
neither its partition nor its place in it.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.session import shared_folder, written

BINS = 32
#: Rows that a pass takes at once (its arrays stay in the cache), rows a written record, rows a summary of the bins.
CHUNK = 65_536
PACK = 64
SUMMARY_ROWS = 262_144
#: Bytes of a task's histograms in a pass.
PASS_BYTES = 128 << 20
#: Nodes whose histograms travel together.
BLOCK = 16
#: Distinct values (or quantiles, if there are more) of a feature that a summary holds, and summaries merged at once.
SUMMARY = 4096
MERGE = 64


# ---- bins ------------------------------------------------------------------------------------------------
def _summary(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts; with more than SUMMARY, neighbours of about equal count are merged into their last."""
    if counts is None:
        v = np.sort(values)
        last = np.append(np.flatnonzero(v[1:] != v[:-1]), len(v) - 1) if len(v) else np.zeros(0, np.int64)
        v, n = v[last], np.diff(last, prepend=-1).astype(np.float64)
    else:
        v, at = np.unique(values, return_inverse=True)
        n = np.bincount(at, counts, len(v))
    if len(v) > SUMMARY:
        upto = np.cumsum(n)
        cell = np.minimum((upto - n / 2) * (SUMMARY / upto[-1]), SUMMARY - 1).astype(np.int64)
        last = np.append(np.flatnonzero(np.diff(cell)), len(v) - 1)
        v, n = v[last], np.diff(upto[last], prepend=0.0)
    return v, n


def _thresholds(v: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """Spark's candidates: between all neighbours if there are few values, else where the rows pass each 1 / bins."""
    if len(v) <= bins:
        return (v[:-1] + v[1:]) / 2
    upto, stride = np.cumsum(n), n.sum() / bins
    out, target = [], stride
    for i in range(1, len(v)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append((v[i - 1] + v[i]) / 2)
            target += stride
    return np.array(out[: bins - 1])


def cut_points(df: DataFrame, features, bins: int = BINS) -> list[np.ndarray]:
    """Ascending split candidates of every feature, from summaries of all rows (NaN counts as the largest)."""
    k = len(features)
    rows = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])

    def merged(parts):
        return [_summary(np.concatenate([p[i][0] for p in parts]), np.concatenate([p[i][1] for p in parts])) for i in range(k)]

    def run(batches):
        done = []
        for table in _chunks(batches):
            columns = [table.column(i).to_numpy() for i in range(k)]
            part = [_summary(x[np.isfinite(x)]) for x in columns]
            done.append(part)
            if len(done) == MERGE:
                done = [merged(done)]
        if done:
            for i, (v, n) in enumerate(merged(done)):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([i]), pa.array([v]), pa.array([n])], ["part", "feature", "v", "n"])

    def cut(key, table):
        parts = sorted(zip(table.column("part").to_pylist(), table.column("v"), table.column("n")), key=lambda p: p[0])
        v, c = _summary(*(np.concatenate([p[i].values.to_numpy() for p in parts]) for i in (1, 2)))
        return pa.table({"feature": [key[0].as_py()], "cuts": [_thresholds(v, c, bins)]})

    parts = rows.mapInArrow(run, "part bigint, feature bigint, v array<double>, n array<double>")
    got = parts.groupBy("feature").applyInArrow(cut, "feature bigint, cuts array<double>").collect()  # one row a feature
    of = {r["feature"]: np.array(r["cuts"], np.float64) for r in got}
    return [of.get(i, np.zeros(0)) for i in range(k)]


def _chunks(batches, rows: int = SUMMARY_ROWS):
    """Arrow batches joined to tables of about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def binned(df: DataFrame, features, label: str, weight: str | None, cuts: list[np.ndarray], deal) -> DataFrame:
    """The rows as the passes read them, written: id (a hash of the key), x (a byte a feature), y, w, PACK rows a record.

    A record's values are bytes next to each other, so that reading costs no work a row in the JVM; 10,000 records,
    Arrow's batch, stay small."""
    k = len(features)
    keys = [c for c in ("store", "date") if c in df.columns] or [*features, label]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(keys[0]).cast("string").alias("store"),
                     F.xxhash64(*keys).alias("id"), F.col(label).cast("double").alias("y"), w.alias("w"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.empty((b.num_rows, k), np.uint8)
            for i in range(k):
                x[:, i] = np.searchsorted(cuts[i], b.column(i).to_numpy(zero_copy_only=False), "left")  # NaN: the last bin
            y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            if not (np.isfinite(y).all() and np.isfinite(w).all() and (w >= 0).all()):
                raise ValueError("labels and weights must be finite, weights not negative")
            at = np.arange(b.num_rows + 1, dtype=np.int32) * k
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([b.column("store"), b.column("id"), packed, b.column("y"), b.column("w")], ["store", "id", "x", "y", "w"])

    def pack(batches):
        for table in _chunks(batches, CHUNK):
            n, out = table.num_rows, []
            ends = np.append(np.arange(0, n, PACK), n)
            for name, data, size in zip(("id", "x", "y", "w"), _arrays(table), (8, k, 8, 8)):
                out.append(pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]))
            yield from pa.Table.from_arrays(out, ["id", "x", "y", "w"]).to_batches()

    dealt = deal(rows.mapInArrow(run, "store string, id bigint, x binary, y double, w double"), ("id", "y")).drop("store")
    return written(dealt.mapInArrow(pack, "id binary, x binary, y binary, w binary"), "binned")


def _bytes(column) -> np.ndarray:
    """The values of a binary column without nulls, one after the other."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def _arrays(table: pa.Table):
    return table.column("id").to_numpy(), _bytes(table.column("x")), table.column("y").to_numpy(), table.column("w").to_numpy()


def _packed_chunks(batches, k: int):
    """id, x (flat), y, w of CHUNK rows after another."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, x, y, w = (_bytes(b.column(c)) for c in ("id", "x", "y", "w"))
        ids, y, w = (np.frombuffer(v.tobytes(), t) for v, t in ((ids, np.uint64), (y, np.float64), (w, np.float64)))
        for a in range(0, len(ids), CHUNK):
            at = slice(a, a + CHUNK)
            yield ids[at], x[a * k : (a + CHUNK) * k], y[at], w[at]


# ---- trees -----------------------------------------------------------------------------------------------
class Tree:
    """Nodes in order of their level: ids grow from parent to child.  A leaf leads to itself."""

    def __init__(self):
        self.feature, self.bin, self.left = [0], [255], [0]
        self.gain = [-1.0]

    def split(self, node: int, feature: int, bin_: int, gain: float) -> tuple[int, int]:
        a = len(self.left)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, bin_, a, gain
        self.feature += [0, 0]
        self.bin += [255, 255]
        self.left += [a, a + 1]
        self.gain += [-1.0, -1.0]
        return a, a + 1

    def arrays(self):
        return np.array(self.feature, np.int64), np.array(self.bin, np.uint8), np.array(self.left, np.int64)


def _walk(flat, base, arrays, steps: int) -> np.ndarray:
    feature, cut, left = arrays
    node = np.zeros(len(base), np.int64)
    for _ in range(steps):
        went = flat.take(base + feature.take(node)) > cut.take(node)
        node = left.take(node)
        node += went
    return node


def _poisson_table() -> np.ndarray:
    upto = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


POISSON = _poisson_table()


def _times(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree's bootstrap draws each row: Poisson(1) by the upper bits of a multiplicative hash of its id."""
    odd = np.random.default_rng([seed, tree]).integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return POISSON.take((ids * odd >> np.uint64(48)).astype(np.int64))


def drawn_features(seed: int, tree: int, level: int, nodes: int, k: int, n: int) -> np.ndarray:
    """(n × nodes) features in ascending order that the nodes of a level look at."""
    if n >= k:
        return np.repeat(np.arange(k)[:, None], nodes, axis=1)
    order = np.random.default_rng([seed, tree, level]).random((nodes, k)).argpartition(n - 1, axis=1)[:, :n]
    return np.sort(order, axis=1).T.copy()


@dataclass
class Setting:
    features: int
    depth: int
    least: int
    draw: int
    seed: int
    bootstrap: bool = True


def _target(flat, base, y, before):
    """The label, or (for a boosted absolute loss) on which side of the ensemble so far it is."""
    if before is None:
        return y
    f = np.zeros(len(y))
    for arrays, value, scale, depth in before:
        f += scale * value.take(_walk(flat, base, arrays, depth))
    return np.where(y - f < 0, -1.0, 1.0)


def _sampled(flat, ids, y, w, s: Setting, before):
    """Per tree number: rows drawn, their place in ``flat``, counts, weights and labels."""
    base = np.arange(len(ids)) * s.features
    y = _target(flat, base, y, before)

    def of(tree):
        if not s.bootstrap:
            return base, np.ones(len(ids)), w, y
        n = _times(ids, s.seed, tree)
        rows = np.flatnonzero(n)
        n = n.take(rows).astype(np.float64)
        return base.take(rows), n, w.take(rows) * n, y.take(rows)
    return of


def _level(rows: DataFrame, tasks: int, group: dict, level: int, s: Setting, before=None) -> pa.Table:
    """Best split of the nodes ``group[tree]`` = (arrays, node ids): one row a node that has one."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((group, before))  # bounded by the ensemble's settings

    def count(batches):
        opened, before = shared.value
        sums = {}
        for ids, flat, y, w in _packed_chunks(batches, s.features):
            of = _sampled(flat, ids, y, w, s, before)
            for tree, (arrays, nodes) in opened.items():
                if tree not in sums:
                    place = np.full(len(arrays[2]), -1, np.int64)
                    place[nodes] = np.arange(len(nodes)) * BINS
                    sums[tree] = (place, drawn_features(s.seed, tree, level, len(nodes), s.features, s.draw),
                                  np.zeros((s.draw, len(nodes) * BINS), np.complex128), np.zeros((s.draw, len(nodes) * BINS)))
                place, drawn, both, n = sums[tree]
                base, c, wt, yt = of(tree)
                cell = place.take(_walk(flat, base, arrays, level))
                if len(nodes) < len(arrays[2]):
                    keep = np.flatnonzero(cell >= 0)
                    cell, base, c, wt, yt = (a.take(keep) for a in (cell, base, c, wt, yt))
                node, z = cell // BINS, wt + 1j * (wt * yt)
                for j in range(s.draw):
                    i = flat.take(base + drawn[j].take(node)) + cell
                    np.add.at(both[j], i, z)
                    np.add.at(n[j], i, c)
        if tasks == 1:  # nothing to merge
            for tree, (_, drawn, both, n) in sums.items():
                yield from pa.Table.from_pydict(_best_splits(tree, opened[tree][1], drawn, both, n, s.least), schema=SPLITS).to_batches()
            return
        part, out = TaskContext.get().partitionId(), []
        for tree, (_, drawn, both, n) in sums.items():
            for b in range(-(-drawn.shape[1] // BLOCK)):
                at = slice(b * BLOCK * BINS, (b + 1) * BLOCK * BINS)
                out.append((tree, b, part, both[:, at].tobytes(), n[:, at].tobytes()))
                if len(out) == 16:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def best(key, table):
        tree, block = (v.as_py() for v in key)
        order = np.argsort(table.column("part").to_numpy())  # the same sums in every run
        both = n = 0.0
        for i in order:
            both = both + np.frombuffer(table.column("both")[int(i)].as_buffer(), np.complex128)
            n = n + np.frombuffer(table.column("n")[int(i)].as_buffer(), np.float64)
        at = shared.value[0][tree][1]
        drawn = drawn_features(s.seed, tree, level, len(at), s.features, s.draw)[:, block * BLOCK : (block + 1) * BLOCK]
        return pa.Table.from_pydict(_best_splits(tree, at[block * BLOCK : (block + 1) * BLOCK], drawn, both, n, s.least), schema=SPLITS)

    splits = "tree int, node int, feature int, bin int, gain double, left_n bigint, right_n bigint"
    if tasks == 1:
        out = rows.coalesce(1).mapInArrow(count, splits).toArrow()
    else:
        parts = rows.coalesce(tasks).mapInArrow(count, "tree int, block int, part int, both binary, n binary")
        out = parts.groupBy("tree", "block").applyInArrow(best, splits).toArrow()
    shared.destroy()
    return out


SPLITS = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()),
                    ("left_n", pa.int64()), ("right_n", pa.int64())])


def _batch(rows) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["tree", "block", "part", "both", "n"])


def _best_splits(tree, nodes, drawn, both, n, least: int) -> dict:
    both, n = both.reshape(*drawn.shape, BINS), n.reshape(*drawn.shape, BINS)
    lw, ly, ln = (np.cumsum(a, axis=2)[:, :, :-1] for a in (both.real, both.imag, n))
    tw, ty, tn = (a.sum(axis=2, keepdims=True) for a in (both.real, both.imag, n))
    rw, ry, rn = tw - lw, ty - ly, tn - ln
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = ty * ty / tw
        gain = (ly * ly / lw + ry * ry / rw - whole) / tw
        sure = gain * tw > 1e-13 * whole  # more than rounding
    gain = np.where((ln >= max(least, 1)) & (rn >= max(least, 1)) & (lw > 0) & (rw > 0) & sure, gain, -1.0)
    flat = gain.transpose(1, 0, 2).reshape(len(nodes), -1)
    top = flat.argmax(axis=1)  # the first of equal ones
    at = np.flatnonzero(flat[np.arange(len(nodes)), top] > 0)
    j, b = top[at] // (BINS - 1), top[at] % (BINS - 1)
    return {"tree": np.full(len(at), tree, np.int32), "node": np.asarray(nodes)[at].astype(np.int32), "feature": drawn[j, at].astype(np.int32), "bin": b.astype(np.int32),
            "gain": flat[at, top[at]], "left_n": np.rint(ln[j, at, b]).astype(np.int64), "right_n": np.rint(rn[j, at, b]).astype(np.int64)}


def grow(rows: DataFrame, tasks: int, numbers, s: Setting, before=None) -> list[Tree]:
    """The trees with these numbers, grown together on the ``binned`` rows."""
    trees = {t: Tree() for t in numbers}
    opened = {t: np.zeros(1, np.int64) for t in numbers}
    for level in range(s.depth):
        most = max(1, PASS_BYTES // (s.draw * BINS * 24))
        todo, after = list(opened), {}
        while todo:
            group, n = {}, 0
            while todo and (not group or n + len(opened[todo[0]]) <= most):
                t = todo.pop(0)
                group[t] = (trees[t].arrays(), opened[t])
                n += len(opened[t])
            found = _level(rows, tasks, group, level, s, before).to_pydict()
            for i in sorted(range(len(found["tree"])), key=lambda i: (found["tree"][i], found["node"][i])):
                t = found["tree"][i]
                ends = trees[t].split(found["node"][i], found["feature"][i], found["bin"][i], found["gain"][i])
                after.setdefault(t, []).extend(e for e, m in zip(ends, (found["left_n"][i], found["right_n"][i])) if m >= 2 * max(s.least, 1))
        opened = {t: np.array(nodes, np.int64) for t, nodes in sorted(after.items()) if nodes}
        if not opened:
            break
    return [trees[t] for t in numbers]


def node_sums(rows: DataFrame, tasks: int, trees: dict, s: Setting, before=None) -> dict:
    """{tree: (nodes × [weight, weighted label, its square, rows])}: leaves by one pass, inner nodes from their children."""
    shared = rows.sparkSession.sparkContext.broadcast(({t: tree.arrays() for t, tree in trees.items()}, before))

    def count(batches):
        arrays, before = shared.value
        sums = {}
        for ids, flat, y, w in _packed_chunks(batches, s.features):
            of = _sampled(flat, ids, y, w, s, before)
            for t, a in arrays.items():
                base, c, wt, yt = of(t)
                node, n = _walk(flat, base, a, s.depth), len(a[2])
                sums[t] = sums.get(t, 0.0) + np.stack([np.bincount(node, v, n) for v in (wt, wt * yt, wt * yt * yt, c)], axis=1)
        for t, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([v.tobytes()])], ["tree", "part", "sums"])

    def total(key, table):
        order = np.argsort(table.column("part").to_numpy())
        v = sum(np.frombuffer(table.column("sums")[int(i)].as_buffer(), np.float64) for i in order)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([v.tobytes()])})

    parts = rows.coalesce(tasks).mapInArrow(count, "tree int, part int, sums binary")
    got = (parts.groupBy("tree").applyInArrow(total, "tree int, sums binary") if tasks > 1 else parts).toArrow().to_pydict()
    shared.destroy()
    out = {}
    for t, v in zip(got["tree"], got["sums"]):
        v, left = np.frombuffer(v, np.float64).reshape(-1, 4).copy(), trees[t].left
        for j in range(len(left) - 1, -1, -1):
            if left[j] > j:
                v[j] = v[left[j]] + v[left[j] + 1]
        out[t] = v
    return out


# ---- models ----------------------------------------------------------------------------------------------
def spark_model(spark: SparkSession, estimator, kind: str, trees: list[Tree], sums: list[np.ndarray], scales, cuts, n_features: int):
    """A Spark ML ensemble of the trees: written in the format of Spark's own models and loaded."""
    from pyspark.ml import regression

    path = f"{shared_folder(spark)}/grown-{uuid.uuid4().hex}"
    params = {p.name: estimator.getOrDefault(p) for p in estimator.params if estimator.isSet(p)}
    defaults = {p.name: estimator._defaultParamMap[p] for p in estimator.params if estimator.hasDefault(p)}
    meta = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "paramMap": params, "defaultParamMap": defaults}
    own = {k: v for k, v in params.items() if k in ("featuresCol", "labelCol", "predictionCol", "maxDepth", "seed", "minInstancesPerNode")}
    each = [json.dumps({"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **meta, "uid": f"dtr_{uuid.uuid4().hex[:12]}", "paramMap": own,
                        "defaultParamMap": {"leafCol": "", "impurity": "variance", "featuresCol": "features", "labelCol": "label", "predictionCol": "prediction"}}) for _ in trees]
    whole = json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", **meta, "uid": estimator.uid, "numFeatures": n_features, "numTrees": len(trees)})
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, m, float(c)) for i, (m, c) in enumerate(zip(each, scales))], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    tables = []
    for i, (t, v) in enumerate(zip(trees, sums)):
        feature, cut, left = t.arrays()
        inner = left > np.arange(len(left))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(v[:, 0] > 0, v[:, 1] / v[:, 0], 0.0)
            impurity = np.where(v[:, 0] > 0, np.maximum(v[:, 2] / v[:, 0] - mean * mean, 0.0), 0.0)
        at = [float(cuts[f][b]) if e else 0.0 for f, b, e in zip(feature, cut, inner)]
        tables.append(pa.table({"tree": pa.array(np.full(len(left), i, np.int32)), "id": pa.array(np.arange(len(left), dtype=np.int32)), "prediction": mean, "impurity": impurity,
                                "a": v[:, 0], "b": v[:, 1], "c": v[:, 2], "n": np.rint(v[:, 3]).astype(np.int64), "gain": np.array(t.gain),
                                "l": np.where(inner, left, -1).astype(np.int32), "r": np.where(inner, left + 1, -1).astype(np.int32),
                                "feature": np.where(inner, feature, -1).astype(np.int32), "cut": at}))
    nodes = spark.createDataFrame(pa.concat_tables(tables))
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") >= 0, F.array("cut")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                     F.lit(-1).alias("numCategories"))
    data = F.struct("id", "prediction", "impurity", F.array("a", "b", "c").alias("impurityStats"), F.col("n").alias("rawCount"), "gain",
                    F.col("l").alias("leftChild"), F.col("r").alias("rightChild"), split.alias("split"))
    nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.parquet(f"{path}/data")
    return getattr(regression, kind).load(path)


def tasks_of(rows: DataFrame) -> int:
    """Tasks of a pass: the cluster's cores, and no more than have a chunk of rows each."""
    return max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * PACK // CHUNK)))


def fit_forest(df: DataFrame, features, label: str, weight: str | None, rf, deal, cuts_from: DataFrame | None = None):
    """The random forest that the estimator ``rf`` describes.  ``deal`` deals the binned rows into partitions."""
    features, spark = list(features), df.sparkSession
    cuts = cut_points(df if cuts_from is None else cuts_from, features, rf.getMaxBins())
    rows = binned(df, features, label, weight, cuts, deal)
    k, tasks = len(features), tasks_of(rows)
    s = Setting(k, rf.getMaxDepth(), rf.getMinInstancesPerNode(), max(1, math.ceil(float(rf.getFeatureSubsetStrategy()) * k)), rf.getSeed())
    numbers = list(range(rf.getNumTrees()))
    trees = grow(rows, tasks, numbers, s)
    sums = node_sums(rows, tasks, dict(zip(numbers, trees)), s)
    return spark_model(spark, rf, "RandomForestRegressionModel", trees, [sums[t] for t in numbers], [1.0] * len(trees), cuts, k)


def fit_boosted(df: DataFrame, features, label: str, gbt, deal):
    """The boosted trees of absolute loss that the estimator ``gbt`` describes: the first fits the label, each next one
    the side of the label on which the ensemble so far is."""
    features, spark = list(features), df.sparkSession
    cuts = cut_points(df, features, gbt.getMaxBins())
    rows = binned(df, features, label, None, cuts, deal)
    k, tasks = len(features), tasks_of(rows)
    s = Setting(k, gbt.getMaxDepth(), gbt.getMinInstancesPerNode(), k, gbt.getSeed(), bootstrap=False)
    trees, sums, before = [], [], []
    for i in range(gbt.getMaxIter()):
        (tree,) = grow(rows, tasks, [i], s, before or None)
        v = node_sums(rows, tasks, {i: tree}, s, before or None)[i]
        scale = 1.0 if i == 0 else gbt.getStepSize()
        trees.append(tree)
        sums.append(v)
        before.append((tree.arrays(), v[:, 1] / np.maximum(v[:, 0], 1e-300), scale, s.depth))
    return spark_model(spark, gbt, "GBTRegressionModel", trees, sums, [1.0] + [gbt.getStepSize()] * (len(trees) - 1), cuts, k)
