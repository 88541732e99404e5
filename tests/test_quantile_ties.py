"""Exact distributed percentiles over columns that are mostly ties."""

import random

import numpy as np
import pytest


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_exact_percentiles_with_ties(spark, share):
    from tillcast.functions.quantiles import exact_percentiles
    rng = random.Random(7)
    rows = [(g, 5.0 if rng.random() < share else round(rng.uniform(-10, 20), 3)) for g in ("a", "b") for _ in range(20_000)]
    df = spark.createDataFrame([*rows, ("a", None), ("b", float("nan"))], "g string, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    for by, groups in (((), {None: [v for _, v in rows]}), (("g",), {g: [v for k, v in rows if k == g] for g in "ab"})):
        got = {r["g"] if by else None: r for r in exact_percentiles(df, "v", probs, by=by, prefix="p").collect()}
        assert set(got) == set(groups)
        for g, values in groups.items():
            assert got[g]["n"] == len(values)
            assert np.allclose([got[g][f"p{i}"] for i in range(len(probs))], np.percentile(values, [100 * p for p in probs]), rtol=0, atol=1e-12)
