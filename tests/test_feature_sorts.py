"""The feature table sorts a store's rows once per order and rolls the sales up once."""

import re

from pyspark.sql import functions as F

from tillcast.operators import transforms as T
from tillcast.plans import base
from tillcast.plans import features as FT
from tillcast.session import written
from tillcast.sources.festivals import festivals


def test_four_sorts(spark, sf_dir):
    ft = FT.build_feature_table(written(base.sales(spark, sf_dir), "sales"), base.stores(spark, sf_dir), festivals(spark))
    plan = ft._jdf.queryExecution().sparkPlan().toString()
    specs = re.findall(r"windowspecdefinition\((store#\d+(?:, \w+#\d+)?(?:, date#\d+ ASC)?)", plan)
    runs = [s for i, s in enumerate(specs) if not i or specs[i - 1] != s]  # specs of one Window stand next to each other
    orders = [re.sub(r"#\d+", "", s) for s in runs]
    assert len(orders) >= 4 and len(orders) == len(set(orders)), orders


def test_qcut_prepares_its_edges_once(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 2, 3, 4, 5, 6, 7, 8)] + [(None,)], "x double")
    out = T.qcut(df, "x", 5, "b")
    assert "array_distinct" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    # numpy's linear quantiles: 1, 1, 2.6, 4.4, 6.2, 8; the double edge counts once
    got = {r["x"]: r["b"] for r in out.orderBy("x").collect()}
    assert got == {None: None, 1.0: 0, 2.0: 0, 3.0: 1, 4.0: 1, 5.0: 2, 6.0: 2, 7.0: 3, 8.0: 3}
