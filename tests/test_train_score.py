"""Training and scoring as wholes: the contract of a prediction, whatever the requests hold."""

import datetime as dt
import math
import tempfile

import pytest
from pyspark.sql import functions as F

from tillcast.operators.lookups import requests_from
from tillcast.plans import base
from tillcast.plans import train_score as TS
from tillcast.session import written
from tillcast.sources.festivals import festivals
from tillcast.sources.state import read_state

CUT = dt.date(2021, 6, 1)


@pytest.fixture(scope="module")
def world(spark, sf_dir):
    history = written(base.sales(spark, sf_dir).where(F.col("date") < F.lit(CUT)), "test-history")
    root = tempfile.mkdtemp(prefix="tillcast-trained-") + "/state"
    version, metrics = TS.train(history, base.stores(spark, sf_dir), festivals(spark), root, trees=5)
    return history, base.stores(spark, sf_dir), root, version, metrics


def run(spark, world, requests, history=None):
    h, stores, root, version, _ = world
    return TS.score(requests, history if history is not None else h, stores, festivals(spark), root, version)


def test_training_leaves_a_whole_state(spark, world):
    _, _, root, version, metrics = world
    state = read_state(spark, root)
    state.verify()
    assert state.version == version and set(state.models) == {"median", "spread"} and state.settings["train_to"] < str(CUT)
    assert set(TS.T.ANCHORS) <= set(state.settings["features"]) and len(state.settings["features"]) < 46
    got = {(r["side"], r["metric"]): r["value"] for r in metrics.collect()}
    assert {m for s, m in got if s == "test"} == {"coverage", "sharpness", "rmse", "mae", "r2"}
    assert 0 <= got["test", "coverage"] <= 100 and got["train", "r2"] > 0.1


def check(rows):
    for r in rows:
        p = [r["p10"], r["p50"], r["p90"]]
        assert all(x is not None and math.isfinite(x) for x in p) and 0 <= p[0] <= p[1] <= p[2]
        assert len(r["top_features"]) == 5 and r["fallback_triggered"] in (0, 1)


def test_all_later_days(spark, sf_dir, world):
    later = base.daily(spark, sf_dir).where(F.col("date") >= F.lit(CUT))
    rows = run(spark, world, requests_from(later)).collect()
    assert len(rows) == later.count()
    check(rows)
    actual = {(r["store"], r["date"]): r["revenue"] for r in later.collect()}
    inside = sum(r["p10"] <= actual[r["store"], r["date"]] <= r["p90"] for r in rows) / len(rows)
    assert inside > 0.3


def test_odd_requests(spark, world):
    """Unseen stores, repeats, extreme and missing values, no date, extra columns."""
    rows = [("1", CUT, 0.05, "x"), ("1", CUT, 0.05, "x"), ("never", CUT, 0.0, "x"), ("2", dt.date(2035, 1, 1), 5.0, "x"), ("2", CUT, float("nan"), "x"),
            ("3", CUT, None, "x"), ("3", CUT, float("inf"), "x"), ("4", None, 0.1, "x"), (None, CUT, 0.1, "x"), ("5", dt.date(1990, 1, 1), -3.0, "x")]
    got = run(spark, world, spark.createDataFrame(rows, "store string, date date, discount_pct double, revenue string")).collect()
    assert len(got) == len(rows)
    check(got)
    same = [r for r in got if r["store"] == "1"]
    assert same[0] == same[1]
    assert run(spark, world, spark.createDataFrame([], "store string, date date, discount_pct double")).count() == 0


def test_the_future_does_not_matter(spark, sf_dir, world):
    """Lags and tail statistics of a request are the same with later rows in the history."""
    h, stores, root, version, _ = world
    state = read_state(spark, root, version)
    requests = requests_from(base.daily(spark, sf_dir).where(F.col("date") >= F.lit(CUT)).limit(20)).withColumn("request", F.monotonically_increasing_id())
    requests = written(requests, "some-requests")
    safe = ["revenue_rolling_mean_7d", "revenue_rolling_std_30d", "revenue_last_3_days", "revenue_volatility_3d", "days_since_last_promo"]
    feats = [{r["request"]: r[1:] for r in TS.request_features(requests, hist, stores, festivals(spark), state).select("request", *safe).collect()}
             for hist in (h, base.sales(spark, sf_dir).where(F.col("date") <= F.lit(CUT)))]
    first = {r["request"] for r in requests.where(F.col("date") <= F.lit(CUT)).collect()}
    assert feats[0].keys() == feats[1].keys() and len(feats[0]) == 20
    for k in first:
        assert feats[0][k] == feats[1][k]
