"""Tiny literal frames for the edge cases of the reference's test list:
empty sales, store without a dimension row, one-row store, repeated
(store, date) before rollup, zero revenue with zero discount, NULL / NaN /
inf revenue, ties at a quantile edge, 29 February, date after the last festival."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tillcast.functions.quantiles import exact_percentiles, running_quantiles
from tillcast.operators import windows as W
from tillcast.operators.calendar import calendar_parts
from tillcast.operators.joins import join_store
from tillcast.operators.lookups import days_to_festival, is_festival
from tillcast.operators.rollup import SALES_SCHEMA, daily_rollup, disc_perc
from tillcast.sources.festivals import festival_rows, festivals

D = dt.date


def _sales(spark, rows):
    return spark.createDataFrame(rows, SALES_SCHEMA)


def test_rollup_sums_repeated_store_days_and_all_nan_is_zero(spark):
    rows = [("1", D(2020, 1, 1), 1.0, 10.0, 1.0), ("1", D(2020, 1, 1), 2.0, 20.0, 2.0),
            ("2", D(2020, 1, 1), float("nan"), float("nan"), None)]
    out = {r["store"]: r for r in daily_rollup(_sales(spark, rows)).collect()}
    assert out["1"]["revenue"] == 30.0 and out["1"]["qty_sold"] == 3.0
    assert out["2"]["revenue"] == 0.0 and out["2"]["disc_value"] == 0.0


def test_empty_sales_gives_empty_result(spark):
    df = _sales(spark, [])
    assert daily_rollup(df).count() == 0
    assert W.rolling_lagged(calendar_parts(daily_rollup(df))).count() == 0


def test_disc_perc_zero_denominators(spark):
    rows = [("1", D(2020, 1, 1), 1.0, 0.0, 0.0), ("1", D(2020, 1, 2), 1.0, 0.0, 5.0),
            ("1", D(2020, 1, 3), 1.0, -10.0, 10.0), ("1", D(2020, 1, 4), 1.0, 90.0, 10.0)]
    g = {r["date"].day: r for r in disc_perc(_sales(spark, rows), guarded=True).collect()}
    u = {r["date"].day: r for r in disc_perc(_sales(spark, rows), guarded=False).collect()}
    assert g[1]["disc_perc"] == 0.0 and u[1]["disc_perc"] == 0.0
    assert g[2]["disc_perc"] == 100.0 and u[2]["disc_perc"] == 100.0
    assert g[3]["disc_perc"] == 0.0 and u[3]["disc_perc"] == 100.0
    assert math.isclose(g[4]["disc_perc"], 10.0)


def test_store_without_dimension_row_keeps_nulls(spark):
    s = _sales(spark, [("9", D(2020, 1, 1), 1.0, 10.0, 0.0)])
    stores = spark.createDataFrame([("1", "ONLINE", "X", "R", 1, 1000.0, "ONLINE")],
                                   "id string, channel string, city string, region string, is_online int, store_area double, store_cluster string")
    r = join_store(s, stores).collect()[0]
    assert r["city"] is None and r["revenue"] == 10.0


def test_one_row_store_windows_are_null(spark):
    d = calendar_parts(_sales(spark, [("1", D(2020, 2, 29), 1.0, 10.0, 0.0)]))
    r = d.transform(W.lags).transform(W.rolling_lagged).transform(W.expanding_store).collect()[0]
    assert r["revenue_lag_1"] is None and r["revenue_rolling_mean_7d"] is None
    assert r["revenue_median"] == 10.0 and r["revenue_std"] is None
    assert r["day_of_week"] == 5 and r["day"] == 29  # 2020-02-29 is a Saturday


def test_running_quantiles_match_builtin_with_ties_and_nulls(spark):
    vals = [5.0, 1.0, None, 5.0, 5.0, 2.0, float("nan"), 9.0, 5.0]
    rows = [("a", D(2020, 1, i + 1), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "store string, date date, revenue double")
    got = running_quantiles(df, ["store"], "date", "revenue", {"m": 0.5, "p9": 0.9}).orderBy("date").collect()
    clean = df.withColumn("revenue", F.nanvl("revenue", F.lit(None).cast("double")))
    w = W.wsd().rowsBetween(W.Window.unboundedPreceding, 0)
    ref = clean.select("date", F.percentile("revenue", 0.5).over(w).alias("m"),
                       F.percentile("revenue", 0.9).over(w).alias("p9")).orderBy("date").collect()
    for a, b in zip(got, ref):
        assert math.isclose(a["m"], b["m"], rel_tol=1e-12) and math.isclose(a["p9"], b["p9"], rel_tol=1e-12)


def test_exact_percentiles_ties_at_edge(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 2, 2, 3]], "v double")
    r = exact_percentiles(df, "v", [0.0, 0.2, 0.5, 0.99, 1.0]).collect()[0]
    assert [r[f"q{i}"] for i in range(5)] == [1.0, 2.0, 2.0, 2.95, 3.0]


def test_festivals_and_after_last_festival(spark):
    assert len(festival_rows()) == 112
    df = spark.createDataFrame([(D(2020, 12, 25),), (D(2030, 12, 26),), (D(2030, 12, 24),)], "date date")
    out = {r["date"]: r for r in days_to_festival(is_festival(df, festivals(spark)), festivals(spark)).collect()}
    assert out[D(2020, 12, 25)]["is_festival"] == 1 and out[D(2020, 12, 25)]["days_to_festival"] == 0
    assert out[D(2030, 12, 26)]["days_to_festival"] == 365
    assert out[D(2030, 12, 24)]["days_to_festival"] == 1


def test_region_weekday_std_chunked_equals_plain(spark, sf_dir):
    from tillcast.plans import base
    d = base.daily(spark, sf_dir)
    plain = W.region_weekday_std(d).select("store", "date", F.col("region_weekday_std").alias("a"))
    chunked = W.region_weekday_std(d, chunk_rows=50).select("store", "date", F.col("region_weekday_std").alias("b"))
    j = plain.join(chunked, ["store", "date"], "full_outer")
    assert j.count() == d.count()
    bad = j.where(~(F.col("a").eqNullSafe(F.col("b")) | (F.abs(F.col("a") - F.col("b")) < 1e-6))).count()
    assert bad == 0


def test_clean_matrix_inf_nan_null(spark):
    from tillcast.operators.transforms import clean_matrix
    df = spark.createDataFrame([(1, float("inf")), (2, float("-inf")), (3, float("nan")), (4, None), (5, 2.5)],
                               "i int, x double")
    got = {r["i"]: r["x"] for r in clean_matrix(df, ["x"]).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 2.5}


def test_empty_stores_dimension(spark):
    s = _sales(spark, [("1", D(2020, 1, 1), 1.0, 10.0, 0.0)])
    empty = spark.createDataFrame([], "id string, channel string, city string, region string, is_online int, "
                                      "store_area double, store_cluster string")
    r = join_store(s, empty).collect()
    assert len(r) == 1 and r[0]["store_area"] is None


def test_align_features_missing_extra_and_critical(spark):
    import pytest
    from tillcast.operators.transforms import align_features
    rows = [("1", D(2020, 1, 1), 10.0, 0.1, 5.0), ("1", D(2020, 1, 2), None, 0.2, 6.0)]
    df = spark.createDataFrame(rows, "store string, date date, revenue_lag_7 double, discount_pct double, extra double")
    out = align_features(df, ["revenue_lag_7", "discount_pct", "new_feature"]).orderBy("date").collect()
    assert out[0].asDict().keys() == {"store", "date", "revenue_lag_7", "discount_pct", "new_feature"}
    assert out[1]["revenue_lag_7"] == 10.0 and out[1]["new_feature"] == 0.0  # forward-filled, missing → 0
    nulls = spark.createDataFrame([("1", D(2020, 1, 1), None)], "store string, date date, revenue_lag_7 double")
    with pytest.raises(ValueError):
        align_features(nulls, ["revenue_lag_7"])


def test_no_history_request_uses_store_median(spark):
    from tillcast.operators.lookups import no_history
    hist = spark.createDataFrame([("1", D(2020, 1, 5), 10.0), ("1", D(2020, 1, 6), 30.0)],
                                 "store string, date date, revenue double")
    req = spark.createDataFrame([("1", D(2020, 1, 1), None), ("1", D(2020, 1, 7), 3.0), ("2", D(2020, 1, 7), None)],
                                "store string, date date, revenue_lag_1 double")
    got = {(r["store"], r["date"].day): r for r in no_history(req, hist, ["revenue_lag_1"]).collect()}
    assert got[("1", 1)]["revenue_lag_1"] == 20.0 and got[("1", 1)]["has_history"] == 0
    assert got[("1", 7)]["revenue_lag_1"] == 3.0 and got[("1", 7)]["has_history"] == 1
    assert got[("2", 7)]["revenue_lag_1"] == 0.0
