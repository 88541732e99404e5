"""Forests for the median (log revenue ratio) and the spread of revenue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.models import histogram_trees as HT
from tillcast.operators import windows as W

# --- Fixed values: forest settings ---
N_TREES = 50
DEPTH_FIRST = 8
DEPTH_FINAL = 12
MIN_LEAF = 30
FEATURE_FRACTION = "0.3"
GBT_ROUNDS = 20
SEED = 42
# -------------------------------------


@dataclass
class Fitter:
    """An estimator of trees on ``features``; ``fit`` gives the pipeline model of the assembler and the grown ensemble."""

    features: list
    trees: RandomForestRegressor | GBTRegressor
    weight: str | None = None

    def fit(self, df: DataFrame, cuts_from: DataFrame | None = None) -> PipelineModel:
        """``cuts_from``: rows to cut the bins at, where those of ``df`` are dear to compute (default: ``df``)."""
        label = self.trees.getLabelCol()
        if isinstance(self.trees, GBTRegressor):
            model = HT.fit_boosted(df, self.features, label, self.trees, training_rows)
        else:
            model = HT.fit_forest(df, self.features, label, self.weight, self.trees, training_rows, cuts_from)
        return PipelineModel([VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep"), model])


def forest(features, label: str, weight: str | None = "weight_x_n", depth: int = DEPTH_FINAL, n_trees: int = N_TREES,
           leaf_col: str = "", min_leaf: int = MIN_LEAF) -> Fitter:
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="prediction", numTrees=n_trees,
                               maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy=FEATURE_FRACTION,
                               seed=SEED, subsamplingRate=1.0, bootstrap=True, leafCol=leaf_col)
    if weight:
        rf.setWeightCol(weight)
    return Fitter(list(features), rf, weight)


def training_rows(df: DataFrame, keys=("store", "date")) -> DataFrame:
    """``df`` as a fit's passes read it: whole stores in as many partitions as the cluster has cores, ordered by key.

    In every pass each partition sends the histograms of all nodes that the pass opens, so their shuffle is that of the
    partitions and must not grow with the rows.  The number is given, not left to adaptive execution, and the rows are
    ordered, so that the sums (and the trees) don't depend on the sizes or the order of shuffled blocks."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, "store").sortWithinPartitions(*keys)


def fit_median(train: DataFrame, features, label: str = "target_log_ratio", weight: str | None = "weight_x_n",
               depth: int = DEPTH_FINAL, n_trees: int = N_TREES) -> PipelineModel:
    """Weighted forest on log1p(revenue / store×weekday mean).  Its (seeded) bootstrap goes by the rows' keys, not by
    how the input happened to be partitioned."""
    return forest(features, label, weight, depth, n_trees).fit(train.where(F.col(label).isNotNull()))


def importances(model: PipelineModel, features) -> DataFrame:
    imp = model.stages[-1].featureImportances.toArray().tolist()  # one value per feature
    from tillcast.session import active_spark

    s = active_spark()
    return s.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def spread_target(pred: DataFrame, label: str = "target_log_ratio") -> DataFrame:
    """|residual| smoothed by a centred 7-row median per store (the spread model's target)."""
    d = pred.withColumn("residual", F.col(label) - F.col("prediction"))
    return W.smooth_residuals(d, "residual", "spread_target")


def fit_spread(pred: DataFrame, features, weight: str | None = "weight_x_n", depth: int = DEPTH_FIRST) -> PipelineModel:
    """One forest on the smoothed |residual|; it serves both bands (D6: the reference's lower and upper
    models are identical)."""
    st = spread_target(pred).drop("features", "prediction").where(F.col("spread_target").isNotNull())
    return forest(features, "spread_target", weight, depth).fit(st, cuts_from=pred)


def median_gbt(features, label: str = "target_log_ratio", rounds: int = GBT_ROUNDS) -> Fitter:
    """Gradient-boosted median (absolute loss) for the quantile stack."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, lossType="absolute", maxDepth=5, maxIter=rounds, seed=SEED)
    return Fitter(list(features), gbt)
