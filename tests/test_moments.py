"""Means and covariances in one pass over the rows."""

import numpy as np

from tillcast.operators import selection as SEL


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(1e6, 1, 5000), rng.exponential(size=5000), np.full(5000, 0.1), rng.integers(0, 2, 5000)])
    x[::7, 1] = np.nan
    rows = [tuple(None if i % 14 == 0 and np.isnan(v) else float(v) for v in r) for i, r in enumerate(x)]
    want = np.nan_to_num(x)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(parts)
        mean, cov, n = SEL.moments(df, ["a", "b", "c", "d"])
        assert n == 5000 and np.allclose(mean, want.mean(axis=0), rtol=1e-12)
        assert np.allclose(cov, np.cov(want, rowvar=False, bias=True), rtol=1e-9, atol=1e-12)
        assert (cov[2] == 0).all() and (SEL.correlation(cov)[2] == [0, 0, 1, 0]).all()
    empty = SEL.moments(df.limit(0), ["a", "b"])
    assert empty[2] == 0 and not empty[1].any()


def test_moments_read_the_rows_once(spark):
    df = spark.range(1000).selectExpr("cast(id as double) a", "cast(id % 7 as double) b")
    seen = spark.sparkContext.accumulator(0)
    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    SEL.moments(df.mapInArrow(count, df.schema), ["a", "b"])
    assert seen.value == 1000


def test_mean_filled_by_arrow(spark):
    """Missing and infinite values become the column's mean, without a wide aggregate of guarded columns."""
    inf = float("inf")
    rows = [(1.0, None, None), (3.0, 2.0, None), (float("nan"), inf, float("nan")), (inf, -inf, None), (None, 4.0, -inf)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    filled = SEL.mean_filled(df, ["a", "b", "c"])
    assert sorted(map(tuple, filled.collect())) == sorted([(1.0, 3.0, 0.0), (3.0, 2.0, 0.0), (2.0, 3.0, 0.0), (2.0, 3.0, 0.0), (2.0, 4.0, 0.0)])
    assert SEL.mean_filled(df.limit(0), ["a", "b"]).count() == 0
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CASE WHEN" not in plan
