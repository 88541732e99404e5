"""Features the catalogue marks as not looking at future rows must not change when the future is cut off."""

from pyspark.sql import functions as F

from tillcast.plans.features import CATALOGUE, FEATURES, build_feature_table
from tillcast.sources import driver
from tillcast.sources.festivals import festivals


def test_past_only_features_ignore_the_future(spark, sf_dir):
    sales = driver.sales(spark, sf_dir)
    stores = driver.stores(spark, sf_dir)
    cutoff = sales.agg(F.percentile(F.unix_date("date"), 0.6)).first()[0]
    cut = F.date_from_unix_date(F.lit(int(cutoff)))
    full = build_feature_table(sales, stores, festivals(spark)).where(F.col("date") < cut)
    past = build_feature_table(sales.where(F.col("date") < cut), stores, festivals(spark))
    safe = [f for f in FEATURES if not CATALOGUE[f][1]]
    a = full.select("store", "date", *[F.col(f).alias(f"a_{f}") for f in safe])
    b = past.select("store", "date", *[F.col(f).alias(f"b_{f}") for f in safe])
    j = a.join(b, ["store", "date"], "full_outer")
    assert j.count() == past.count()
    bad = {}
    for f in safe:
        n = j.where(~(F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))
                      | (F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) <= 1e-9 * (F.abs(F.col(f"a_{f}")) + 1)))).count()
        if n:
            bad[f] = n
    assert not bad, bad
