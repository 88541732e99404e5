"""The steps of ``prune`` follow each other: the importances are those of a forest on what variance and VIF left."""

from tillcast.models import forest as FO
from tillcast.plans import q_models as M


def test_importance_is_taken_among_the_features_left(spark, sf_dir, monkeypatch):
    fits, fit = [], FO.fit_median

    def small(train, features, label, weight):
        fits.append((list(features), fit(train, features, label, weight, 4, 3)))
        return fits[-1][1]

    monkeypatch.setattr(FO, "fit_median", small)
    monkeypatch.setattr(M, "_CACHE", {})
    out = {r["feature"]: r["removed_by"] for r in M.q_prune(spark, sf_dir).collect()}
    assert list(out) == M.SEL_FEATURES and {"variance", "vif"} <= set(out.values())
    (features, model), = fits
    assert features == [f for f in M.SEL_FEATURES if out[f] not in ("variance", "vif")] and len(features) < len(M.SEL_FEATURES)
    imp = {r["feature"]: r["importance"] for r in FO.importances(model, features).collect()}
    assert {f for f in features if imp[f] < 0.005} == {f for f in features if out[f] == "importance"}
