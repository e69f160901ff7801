"""Boosted trees stopped by their validation loss, and their nodes as rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession, functions as F

from candlemill.session import scratch_path


@dataclass(frozen=True)
class Boosted:
    """The model cut to its best round, and the validation loss after each round that was fitted."""

    model: GBTClassificationModel
    losses: tuple[float, ...]

    @property
    def rounds(self) -> int:
        return self.model.getNumTrees

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """Number of rounds up to the least loss, and whether ``patience`` rounds without a lower one follow it.

    Later rounds do not count once patience has run out; the first of equal losses is the least.
    """
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def cut(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` trees."""
    gateway, java = SparkSession.getActiveSession().sparkContext._gateway, model._java_obj
    trees, weights = java.trees(), java.treeWeights()
    kept = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    shares = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        kept[i], shares[i] = trees[i], weights[i]
    short = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), kept, shares, java.numFeatures(), java.numClasses())
    return GBTClassificationModel(short).setFeaturesCol(model.getFeaturesCol())


def fit_boosted(
    train: DataFrame, validation: DataFrame, label: str, *, seed: int = 42, rounds: int = 800, patience: int = 40, depth: int = 4,
    step: float = 0.03, share: float = 0.8, first: int = 64,
) -> Boosted:
    """Trees until the validation loss has not fallen for ``patience`` rounds, cut to the best round.

    A fit cannot be continued, but its first trees do not depend on how many follow: the number of rounds is doubled until
    patience runs out inside it, which costs at most twice the work of the last fit. All losses of a fit come from one pass over
    the validation rows.
    """
    size = min(rounds, max(first, patience + 1))
    while True:
        model = GBTClassifier(featuresCol="features", labelCol=label, maxDepth=depth, stepSize=step, subsamplingRate=share, maxIter=size, seed=seed).fit(train)
        losses = model.evaluateEachIteration(validation)
        best, stopped = best_round(losses, patience)
        if stopped or size == rounds:
            return Boosted(cut(model, best), tuple(losses))
        size = min(rounds, 2 * size)


def tree_nodes(model: GBTClassificationModel) -> DataFrame:
    """One row a node: tree, its weight, node, children (-1 at a leaf), split feature and threshold, gain a row, rows, prediction."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").drop("metadata")
    n = spark.read.parquet(f"{path}/data").toDF("tree", "n").select("tree", "n.*")
    return n.join(weights, "tree").select(
        "tree", "weight", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.when(F.col("leftChild") >= 0, F.col("split.featureIndex")).alias("feature_index"),
        F.when(F.col("leftChild") >= 0, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(F.col("leftChild") >= 0, F.col("gain")).alias("gain"), F.col("rawCount").alias("rows"), "prediction")


def split_gains(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per feature its number of splits, mean gain (impurity taken away, over all rows of the node) and share of the summed means.

    Features without a split have a gain of 0.
    """
    g = nodes.filter("feature_index IS NOT NULL").groupBy("feature_index").agg(
        F.count(F.lit(1)).alias("splits"), F.avg(F.col("gain") * F.col("rows")).alias("mean_gain"))
    known = nodes.sparkSession.createDataFrame(list(enumerate(names)), "feature_index int, feature string")
    out = known.join(g, "feature_index", "left").na.fill({"splits": 0, "mean_gain": 0.0})
    whole = g.agg(F.sum("mean_gain").alias("_all"))  # one row
    return out.crossJoin(F.broadcast(whole)).select(
        "feature", "splits", "mean_gain", F.coalesce(F.try_divide("mean_gain", "_all"), F.lit(0.0)).alias("importance")).orderBy(F.desc("importance"), "feature")
