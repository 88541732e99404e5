"""The anchor query aligns the whole table and brings every anchor back."""

from tillcast.operators.transforms import ANCHORS
from tillcast.plans import catalog
from tillcast.plans.q_transforms import ALIGN_EXPECTED


def test_anchor_query_has_the_aligned_features_and_all_anchors(spark, sf_dir):
    out = catalog.queries()["anchor_features"](spark, sf_dir)
    assert {*ALIGN_EXPECTED, *ANCHORS} <= set(out.columns) and "extra_feature" not in out.columns
    rows = out.where("revenue_lag_7 = 0 AND store_dayofweek_avg > 0 AND store_month_avg > 0").count()
    assert rows == out.count() > 0
