"""The feature table's windows sort narrow rows that whole stores were dealt with, and it keeps what is read."""

import re

import numpy as np
from pyspark.sql import functions as F

from tillcast.operators import lookups as L
from tillcast.operators import transforms as T
from tillcast.plans import base
from tillcast.plans import features as FT
from tillcast.plans import q_models as M
from tillcast.session import written
from tillcast.sources.festivals import festivals


def test_windows_sort_narrow_rows(spark, sf_dir):
    sales = written(base.sales(spark, sf_dir), "sales")
    ft = FT.build_feature_table(sales, base.stores(spark, sf_dir), festivals(spark), sales.count())
    plan = ft._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(store#", plan)) == 1
    exchange = next(line for line in ft._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in line)
    assert exchange  # the dealt rows are the sales themselves
    below = ft._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "Window" not in below and "sin" not in below.lower().split("relation")[0]
    plain = FT.build_feature_table(sales, base.stores(spark, sf_dir), festivals(spark))
    assert sorted(map(str, ft.select(*FT.FEATURES[:40]).collect())) == sorted(map(str, plain.select(*FT.FEATURES[:40]).collect()))


def test_written_table_has_the_columns_read(spark, sf_dir):
    ft = M.feature_table(spark, sf_dir)
    assert set(ft.columns) == {*FT.KEPT, *FT.FEATURES, "weight_x_n", "is_test"}


def test_wide_projection_is_not_fused(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (None, float("inf")), (-2.0, 3.0)], "a double, b double")
    wide = df.select(*[F.col("a" if i % 2 else "b").alias(f"x{i}") for i in range(T.WIDE)])
    out = T.clean_matrix(wide, wide.columns)
    assert "transform(" in out._jdf.queryExecution().executedPlan().toString()
    got = np.array([list(r) for r in out.collect()])
    assert np.array_equal(got[:, 1], [1.0, 0.0, -2.0]) and np.array_equal(got[:, 0], [0.0, 0.0, 3.0])


def test_days_to_festival_at_the_calendars_ends(spark):
    cal = spark.sql("SELECT * FROM VALUES (DATE'2020-01-10'), (DATE'2020-01-01'), (DATE'2020-01-10'), (NULL) AS t(date)")
    df = spark.sql("SELECT * FROM VALUES (DATE'2019-12-25'), (DATE'2020-01-01'), (DATE'2020-01-02'), (DATE'2020-01-10'), (DATE'2020-01-11'), (NULL) AS t(date)")
    got = {str(r["date"]): r["days_to_festival"] for r in L.days_to_festival(df, cal).collect()}
    assert got == {"2019-12-25": 7, "2020-01-01": 0, "2020-01-02": 8, "2020-01-10": 0, "2020-01-11": 365, "None": 365}
    assert {r["days_to_festival"] for r in L.days_to_festival(df, cal.limit(0)).collect()} == {365}
