"""Invariant tests for operators whose driver check is rows-only or whose semantics are properties."""

from pyspark.sql import functions as F

from tillcast.operators import splits as S
from tillcast.operators import weights as WT
from tillcast.plans import base


def test_train_test_split_share_and_determinism(spark, sf_dir):
    d = base.daily(spark, sf_dir)
    a = S.train_test_split(d)
    share = a.agg(F.avg("is_test")).first()[0]
    assert 0.17 < share < 0.23
    b = S.train_test_split(d.repartition(3))
    diff = a.join(b.withColumnRenamed("is_test", "t2"), ["store", "date"]).where("is_test <> t2").count()
    assert diff == 0


def test_group_folds_disjoint_and_covering(spark, sf_dir):
    d = base.daily(spark, sf_dir)
    plan = S.group_split(d)
    n_groups = d.select("store").distinct().count()
    per_fold = plan.groupBy("fold").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()
    assert all(r["n"] == n_groups for r in per_fold)
    # every group is tested at most once over the folds (n_splits · test share ≤ 1)
    assert plan.groupBy("store").agg(F.sum("is_test").alias("k")).where("k > 1").count() == 0


def test_weights_sum_and_mean(spark, sf_dir):
    d = base.daily(spark, sf_dir)
    w = WT.weights_decay(d).agg(F.sum("weight"), F.avg("weight_x_n")).first()
    assert abs(w[0] - 1.0) < 1e-9 and abs(w[1] - 1.0) < 1e-9
    b = WT.weights_blend(d).agg(F.avg("weight")).first()[0]
    assert abs(b - 1.0) < 1e-9
