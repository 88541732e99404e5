"""Trees grown on binned rows: the best splits by brute force, sums by hand, the same trees however the rows lie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.models import forest as FO
from tillcast.models import histogram_trees as HT
from tillcast.models import trees as TR
from tillcast.session import written

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 3000
    a, b, c, d = rng.normal(size=n), rng.integers(0, 5, n) * 1.0, rng.exponential(size=n), (rng.random(n) < 0.02) * 1.0
    y = 2 * (a > 0.3) + b * (c > 1) + 3 * d + 0.1 * rng.normal(size=n)
    c[7] = np.nan
    rows = [(f"s{i % 20}", i, *map(float, r)) for i, r in enumerate(zip(a, b, c, d, y, rng.random(n) + 0.1))]
    return written(spark.createDataFrame(rows, "store string, date int, a double, b double, c double, d double, y double, w double"), "trees-test")


def nodes(spark, model):
    return TR.node_table(spark, model.stages[-1]).sort_values(["tree", "id"]).reset_index(drop=True)


def test_trees_do_not_depend_on_the_partitions(spark, table):
    """A row's bootstrap goes by its key: Spark's own forest draws it by partition and place, and differed here."""
    one = nodes(spark, FO.forest(FEATS, "y", "w", 5, 4).fit(table.repartition(1)))
    seven = nodes(spark, FO.forest(FEATS, "y", "w", 5, 4).fit(table.repartition(7, "date")))
    assert one[["tree", "id", "left", "right", "feature"]].equals(seven[["tree", "id", "left", "right", "feature"]])
    assert np.allclose(one[["threshold", "value", "cover"]].to_numpy(float), seven[["threshold", "value", "cover"]].to_numpy(float), equal_nan=True)


def test_passes_in_groups_grow_the_same_trees(spark, table, monkeypatch):
    whole = nodes(spark, FO.forest(FEATS, "y", "w", 6, 5).fit(table))
    monkeypatch.setattr(HT, "PASS_BYTES", 50_000)  # some ten nodes a pass
    assert whole.equals(nodes(spark, FO.forest(FEATS, "y", "w", 6, 5).fit(table)))


def test_splits_by_brute_force(spark, table):
    """Without a bootstrap, and over all features, every node takes the split of the largest weighted variance gain."""
    pdf = table.toPandas()
    x, y, w = pdf[FEATS].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy()
    cuts = HT.cut_points(table, FEATS)
    s = HT.Setting(4, 3, 40, 4, 42, bootstrap=False)
    rows = HT.binned(table, FEATS, "y", "w", cuts, FO.training_rows)
    (tree,) = HT.grow(rows, 4, [0], s)
    sums = HT.node_sums(rows, 4, {0: tree}, s)[0]

    def check(j, at):
        assert np.allclose(sums[j], [w[at].sum(), (w * y)[at].sum(), (w * y * y)[at].sum(), at.sum()])
        best = (0.0, None)
        for f in range(4):
            for t in cuts[f]:
                left = at & (x[:, f] <= t)
                right = at & ~left  # NaN goes right
                if left.sum() >= 40 and right.sum() >= 40:
                    part = [(w[m].sum(), (w * y)[m].sum()) for m in (left, right, at)]
                    gain = (part[0][1] ** 2 / part[0][0] + part[1][1] ** 2 / part[1][0] - part[2][1] ** 2 / part[2][0]) / part[2][0]
                    best = max(best, (gain, (f, t)), key=lambda p: p[0])
        if tree.left[j] == j:
            return 1
        f, t = tree.feature[j], cuts[tree.feature[j]][tree.bin[j]]
        assert tree.gain[j] == pytest.approx(best[0], rel=1e-9)
        left = at & (x[:, f] <= t)
        return check(tree.left[j], left) + check(tree.left[j] + 1, at & ~left)

    assert check(0, np.ones(len(y), bool)) == 8


def test_spark_reads_the_model(spark, table):
    """Predictions, leaves and importances of the loaded model are those of the node table."""
    model = FO.forest(FEATS, "y", "w", 4, 6, leaf_col="leaf").fit(table)
    trees = TR._tree_arrays(TR.node_table(spark, model.stages[-1]))
    got = model.transform(table.where("not isnan(c)")).select(*FEATS, "prediction", "leaf").toPandas()
    assert np.allclose(got["prediction"], TR.forest_predict_np(got[FEATS].to_numpy(), trees))
    assert len(got["leaf"][0]) == 6 and model.stages[-1].featureImportances.toArray().sum() == pytest.approx(1.0)
    assert [p for p in (model.stages[-1].getNumTrees, model.stages[-1].getMaxDepth())] == [6, 4]


def test_boosting_follows_the_absolute_loss(spark, table):
    """The ensemble is the first tree on the label, then 0.1 times trees on the sign of what is left: as Spark's own."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    fit = FO.median_gbt(FEATS, "y", 5)
    data = table.where("not isnan(c)")
    other = Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol="features"), fit.trees]).fit(data)

    def loss(m):
        return m.transform(data).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    mine = fit.fit(data)
    assert list(mine.stages[-1].treeWeights) == list(other.stages[-1].treeWeights)
    assert loss(mine) == pytest.approx(loss(other), rel=0.05)


def test_summaries_are_bounded():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=400_000), np.zeros(100_000)])
    parts = [HT._summary(p) for p in np.array_split(rng.permutation(x), 20)]
    v, n = HT._summary(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    assert len(v) <= HT.SUMMARY and n.sum() == len(x)
    upto, x = np.cumsum(n), np.sort(x)
    assert np.abs(upto - np.searchsorted(x, v, "right")).max() <= 21 * len(x) / 20 / HT.SUMMARY * 2
    cuts = HT._thresholds(v, n, 32)
    assert len(cuts) <= 31 and (np.diff(cuts) > 0).all()
    assert HT._thresholds(np.array([0.0, 1.0, 4.0]), np.array([98.0, 1.0, 1.0]), 32).tolist() == [0.5, 2.5]


def test_draws():
    ids = np.random.default_rng(2).integers(0, 1 << 63, 200_000, dtype=np.uint64)
    a, b = HT._times(ids, 42, 0).astype(float), HT._times(ids, 42, 1).astype(float)
    assert abs(a.mean() - 1) < 0.01 and abs(a.var() - 1) < 0.02 and abs(np.corrcoef(a, b)[0, 1]) < 0.01
    drawn = HT.drawn_features(42, 3, 2, 4, 10, 3)
    assert drawn.shape == (3, 4) and (np.diff(drawn, axis=0) > 0).all()
