"""Running quantiles of many small groups, and of groups that Arrow batches cut."""

import random

import pandas as pd
import pytest

from tillcast.functions.quantiles import running_quantiles


@pytest.mark.parametrize("batch_rows", [7, 10_000])
def test_running_quantiles_equal_expanding_per_group(spark, batch_rows):
    rng = random.Random(5)
    rows = [(s, m, d, rng.choice([None, float("nan"), 1.0, round(rng.uniform(0, 50), 2)]))
            for s in ("a", "b", None, *map(str, range(20))) for m in (1, 2, None) for d in range(rng.choice([1, 2, 31]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "store string, month int, date int, revenue double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        got = running_quantiles(df, ["store", "month"], "date", "revenue", {"m": 0.5, "p9": 0.9}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows)
    groups = {}
    for r in sorted(rows, key=lambda r: r[2]):
        groups.setdefault(r[:2], []).append(r)
    for key, group in groups.items():
        exp = pd.Series([r[3] for r in group], dtype=float).expanding(min_periods=1)
        want = {r[2]: [None if pd.isna(v) else v for v in q] for r, q in zip(group, zip(exp.quantile(0.5), exp.quantile(0.9)))}
        assert {r["date"]: [r["m"], r["p9"]] for r in got if (r["store"], r["month"]) == key} == want


def test_small_groups_share_their_batches(spark):
    """The plan has no pandas call per group, and a frame and its quantiles share one shuffle."""
    from tillcast.operators import windows as W
    df = spark.createDataFrame([("a", 1, 1, 2.0)], "store string, month int, date int, revenue double")
    for op in (W.expanding_store_month, W.seasonal_index, W.expanding_store):
        plan = op(df)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and plan.count("Exchange") == 1
