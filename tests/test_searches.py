"""Isotonic step tables, the Box-Cox search and the decay search against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.models import calibration as CAL
from tillcast.operators import splits as S
from tillcast.operators import transforms as T


def isotonic(ys):
    """Min-max formula with equal weights."""
    n = len(ys)
    return [max(min(np.mean(ys[a:b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_tables(spark):
    rng = random.Random(2)
    data = {c: [(i + 0.5) / 99 + rng.uniform(-0.3, 0.3) for i in range(99)] for c in ("a", "b")}
    data["c"] = [1.0 - i / 99 for i in range(99)]
    rows = [(c, (i + 0.5) / 99, y) for c, ys in data.items() for i, y in enumerate(ys)] + [(None, 0.5, 0.5), ("a", None, 1.0)]
    models = CAL.fit(spark.createDataFrame(rows, "store_cluster string, bin_center double, binned_position double").repartition(5))
    got = {r["store_cluster"]: r for r in models.collect()}
    assert set(got) == {"a", "b", "c"}
    for c, ys in data.items():
        assert np.allclose(got[c]["fitted"], isotonic(ys)) and got[c]["centers"] == sorted(got[c]["centers"])
    xs = [0.0, 0.5 / 99, 0.3, 0.7777, 98.5 / 99, 1.0, None]
    probe = spark.createDataFrame([(c, x) for c in "abcz" for x in xs], "store_cluster string, x double").join(models, "store_cluster", "left")
    for r in probe.withColumn("y", CAL.interpolate(F.col("centers"), F.col("fitted"), F.col("x"))).collect():
        want = None if r["x"] is None or r["store_cluster"] == "z" else np.interp(r["x"], r["centers"], r["fitted"])
        assert r["y"] == (want if want is None else pytest.approx(want, abs=1e-12))


def test_pooling_is_mergeable():
    rng = random.Random(4)
    blocks = [(1.0, rng.gauss(0, 1)) for _ in range(60)]
    cut = rng.randrange(60)
    assert np.allclose(CAL.pool(blocks), CAL.pool(CAL.pool(blocks[:cut]) + CAL.pool(blocks[cut:])))


def llf(lam, x):
    y = np.log(x) if lam == 0 else np.expm1(lam * np.log(x)) / lam
    return (lam - 1) * np.log(x).sum() - len(x) / 2 * math.log(y.var())


def test_boxcox(spark):
    rng = np.random.default_rng(5)
    groups = {"p": (1.0 + 0.3 * rng.normal(3, 0.5, 900)) ** (1 / 0.3), "l": np.exp(rng.normal(2, 0.7, 900)), "m": 1e4 + 1e3 * rng.normal(0, 1, 900),
              "edge": 10.0 ** (1 - rng.exponential(1, 500) / 900), "flat": np.full(20, 3.0)}
    df = spark.createDataFrame([(g, float(v) - 1.0) for g, xs in groups.items() for v in xs] + [("p", None), ("p", -5.0), ("other", 1.0)], "store_cluster string, revenue double")
    got = {r["store_cluster"]: r for r in T.boxcox_lambda(df, clusters=tuple(groups)).collect()}
    assert set(got) == set(groups) and got["flat"]["boxcox_lambda"] == 1.0 and got["edge"]["boxcox_lambda"] == 2.0
    for g in ("p", "l", "m"):
        lam, x = got[g]["boxcox_lambda"], groups[g]
        a, b = max(-2.0, lam - 0.01), min(2.0, lam + 0.01)
        for _ in range(80):  # golden section on the likelihood's slope
            m = (a + b) / 2
            a, b = (m, b) if llf(m + 1e-5, x) > llf(m - 1e-5, x) else (a, m)
        assert lam == pytest.approx((a + b) / 2, abs=1e-6), g
        assert got[g]["llf"] == pytest.approx(llf(lam, x), rel=1e-9)


def test_decay_search(spark):
    """The whole grid by brute force; no row is expanded over the grid."""
    rng = random.Random(6)
    rows, day = [], dt.date(2024, 1, 1)
    for s in range(20):
        for i in range(60):
            c = ("near", "far", None)[s % 3]
            rows.append((f"s{s:02d}", day + dt.timedelta(days=i), c, (100.0 + (i * 3 if c == "near" else 0) + rng.gauss(0, 5 + s)) * (1 + i % 7)))
    df = spark.createDataFrame(rows, "store string, date date, store_cluster string, revenue double")
    grid = [round(0.02 * i, 2) for i in range(1, 41)]
    got = {r["store_cluster"]: (r["best_decay"], r["mean_rmse"]) for r in S.decay_search(df, grid).collect()}
    stores = sorted({r[0] for r in rows})
    want = {}
    for c in ("near", "far", None):
        errors = []
        for d in grid:
            folds = []
            for k in range(5):
                test = set(stores[k * 4:(k + 1) * 4])
                sse = w0 = 0.0
                for dow in range(7):
                    part = [(r, math.exp(-d * math.log1p(59 - (r[1] - day).days))) for r in rows if r[2] == c and r[1].weekday() == dow]
                    train, held = [x for x in part if x[0][0] not in test], [x for x in part if x[0][0] in test]
                    if train and held:
                        p = sum(w * r[3] for r, w in train) / sum(w for _, w in train)
                        sse, w0 = sse + sum(w * (r[3] - p) ** 2 for r, w in held), w0 + sum(w for _, w in held)
                folds.append(math.sqrt(sse / w0))
            errors.append(np.mean(folds))
        want[c] = (grid[int(np.argmin(errors))], min(errors))
    assert set(got) == set(want)
    for c in want:
        assert got[c][0] == want[c][0] and got[c][1] == pytest.approx(want[c][1], rel=1e-9)
