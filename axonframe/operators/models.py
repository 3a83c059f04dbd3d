"""Decoding and clustering with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fraction


def forest_scores(df: DataFrame, key: str, features: str, label: str, folds: int = 5, trees: int = 20, seed: int = 0, shuffled: bool = False) -> DataFrame:
    """Accuracy of a random forest per fold; folds are dealt by a hash of the key. With
    ``shuffled`` the labels are those of a hashed order: the chance level."""
    data = df.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    if shuffled:
        from .resample import permuted

        data = permuted(data.withColumn("_g", F.lit(0)), ["_g"], "label", key, seed=seed).drop("_g")
    data = data.withColumn("fold", F.floor(fraction(F.lit(seed), key) * folds).cast("int"))
    score = MulticlassClassificationEvaluator(metricName="accuracy")
    rows = []
    for k in range(folds):
        model = RandomForestClassifier(numTrees=trees, seed=seed).fit(data.filter(F.col("fold") != k))
        rows.append((k, float(score.evaluate(model.transform(data.filter(F.col("fold") == k))))))
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double")


def cluster_sweep(df: DataFrame, features: str, ks: list[int], seed: int = 0) -> DataFrame:
    """Silhouette of KMeans for each number of clusters."""
    data = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    rows = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(data).transform(data)))) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def linear_svm_score(df: DataFrame, key: str, features: str, label: str, test_share: float = 0.33, seed: int = 0) -> DataFrame:
    """Held-out accuracy of a linear support vector machine on standardised features; the
    label is 0/1 and the split is dealt by a hash of the key."""
    data = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("raw"), F.col(label).cast("double").alias("label"), (fraction(F.lit(seed), key) < test_share).alias("test"))
    train, test = data.filter(~F.col("test")), data.filter("test")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = LinearSVC(maxIter=20).fit(scale.transform(train))
    score = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(scale.transform(test)))
    return df.sparkSession.createDataFrame([(float(score),)], "accuracy double")
