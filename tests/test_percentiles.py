"""Radix descent: the codes are the bits of the doubles, and nothing grows with the number of rows."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.functions import percentiles as P


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_codes_are_the_bits(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, float("inf"), -float("inf"), 1.7976931348623157e308, 1.0, 0.1, -3.75]
    for e in range(-1074, 1024):
        xs += [2.0**e, float(np.nextafter(2.0**e, 0)), float(np.nextafter(2.0**e, np.inf))]
    xs += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(20_000)]
    xs = [x for x in xs if x == x]
    df = spark.createDataFrame([(x,) for x in xs], "v double").repartition(4)
    got = df.select("v", P.double_code(F.col("v")).alias("c")).collect()
    assert all(r["c"] == bits(r["v"]) for r in got) and len(got) == len(xs)


@pytest.mark.parametrize("kind", ["wide", "ties at the edges", "two values", "constant", "tiny", "infinite"])
def test_hard_distributions(spark, kind):
    rng = random.Random(kind)
    make = {"wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), "ties at the edges": lambda: rng.choice([1.0, 2.0, rng.uniform(1, 2)]),
            "two values": lambda: rng.choice([0.0, 1e-300]), "constant": lambda: 7.25, "tiny": lambda: 1 + rng.randrange(8) * 2.0**-52,
            "infinite": lambda: rng.choice([float("inf"), rng.gauss(0, 1), rng.gauss(0, 1)])}[kind]
    values = [make() for _ in range(3000)] + [make()]
    probs = [0.0, 0.001, 0.25, 0.5, 0.5005, 0.9, 1.0]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, v double")
    for by in ((), ("g",)):
        for r in P.exact_percentiles(df.withColumnRenamed("g", "c") if by else df, "v", probs, by=by and ["c"]).collect():
            xs = np.array([v for i, v in enumerate(values) if not by or i % 3 == r["c"]])
            with np.errstate(invalid="ignore"):
                want = np.percentile(xs, [100 * p for p in probs])
            got = np.array([r[f"q{i}"] for i in range(len(probs))])
            same = np.isfinite(want)
            assert r["n"] == len(xs) and np.allclose(got[same], want[same], rtol=1e-12, atol=0)


def test_nothing_grows_with_the_rows(spark, monkeypatch):
    """At a thousand times the rows no pass has more cells a range than allowed, and none collects values."""
    seen = []
    count = P.cell_counts

    def spy(src, ranges, by):
        cells = count(src, ranges, by)
        seen.append((cells.groupBy(*by, "_lo", "_hi").count().agg(F.max("count")).first()[0], cells._jdf.queryExecution().optimizedPlan().toString()))
        return cells

    monkeypatch.setattr(P, "cell_counts", spy)
    passes = []
    for n in (2_000, 2_000_000):
        df = spark.range(n).select((F.xxhash64("id") / 1e10).alias("v"))
        got = P.exact_percentiles(df, "v", [0.1, 0.5]).first()
        want = df.agg(F.percentile("v", [0.1, 0.5])).first()[0]
        assert np.allclose([got["q0"], got["q1"]], want, rtol=1e-14)
        passes.append(len(seen))
    assert passes[1] <= 6
    for cells, plan in seen:
        assert cells <= P.CELLS + 1
        assert "collect_list" not in plan and "percentile" not in plan


def test_many_groups_stay_distributed(spark, monkeypatch):
    monkeypatch.setattr(P, "DRIVER_RANKS", 0)
    monkeypatch.setattr(P, "BROADCAST_RANKS", 0)
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), F.sin("id").alias("v"))
    got = {r["g"]: r["q0"] for r in P.exact_percentiles(df, "v", [0.3], by=["g"]).collect()}
    want = {r["g"]: r["w"] for r in df.groupBy("g").agg(F.percentile("v", 0.3).alias("w")).collect()}
    assert got == pytest.approx(want, rel=1e-14)


def test_empty(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), 2)], "v double, g int")
    assert P.exact_percentiles(df, "v", [0.5], by=["g"]).count() == 0
    assert P.exact_percentiles(df, "v", [0.5]).count() == 0
