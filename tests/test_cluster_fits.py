"""The chosen mixture is the one whose BIC was taken; it isn't fitted a second time."""

import numpy as np

from tillcast.models import clustering as CL
from tillcast.session import written


def test_one_fit_for_each_k(spark, monkeypatch):
    monkeypatch.setattr(CL, "MAX_K", 4)
    fits, fit = [], CL.GaussianMixture.fit
    monkeypatch.setattr(CL.GaussianMixture, "fit", lambda self, data: fits.append(self.getK()) or fit(self, data))
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", *map(float, rng.normal(size=3) + 6 * (i % 3))) for i in range(120)]
    pcs, _, gm, k, bics = CL.fit_clusters(written(spark.createDataFrame(rows, "store string, a double, b double, c double"), "profile"))
    assert fits == [2, 3, 4] and gm.getK() == k
    again = CL.GaussianMixture(featuresCol="pcs", k=k, seed=CL.SEED, probabilityCol="prob")
    assert np.allclose(fit(again, pcs).weights, gm.weights)
