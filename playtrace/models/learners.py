"""Learners with one shape: ``fit(train)`` gives a model, ``model.scores(df, name)`` adds class scores.

Training frames have a ``features`` vector, a double ``label`` (0..k-1) and an ``id`` where rows must be told
apart. Scores are an ``array<double>`` with one entry per class; ``predict`` takes the first best.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.runtime import materialize

MAX_DEPTH = 30  # the deepest tree pyspark.ml grows; deeper or unlimited settings are cut to it


def assemble(df: DataFrame, features: list[str], label: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Keep columns, ``features`` vector (nulls as 0) and double ``label``; written once, as fits read it often."""
    filled = df.select(
        *(keep or []),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_f_{i}") for i, f in enumerate(features)],
        *([F.col(label).cast("double").alias("label")] if label else []),
    )
    vectors = VectorAssembler(inputCols=[f"_f_{i}" for i in range(len(features))], outputCol="features")
    columns = [*(keep or []), "features", *(["label"] if label else [])]
    return materialize(vectors.transform(filled).select(*columns), "vectors")


def argmax(scores: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


class Predictor:
    """Base of fitted models: prediction is the first best class score."""

    def scores(self, df: DataFrame, name: str) -> DataFrame:
        raise NotImplementedError

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return self.scores(df, "_scores").withColumn(name, argmax(F.col("_scores"))).drop("_scores")


@dataclass
class SparkModel(Predictor):
    model: Model

    def scores(self, df: DataFrame, name: str) -> DataFrame:
        column = "rawPrediction" if not self.model.hasParam("probabilityCol") else "probability"
        shown = self.model.transform(df)
        extra = [c for c in shown.columns if c not in df.columns and c != column]
        return shown.drop(*extra).withColumn(name, vector_to_array(F.col(column))).drop(column)


@dataclass
class SparkLearner:
    """A ``pyspark.ml`` classifier."""

    estimator: Estimator

    def fit(self, train: DataFrame) -> SparkModel:
        return SparkModel(self.estimator.fit(train))


def forest(trees: int = 100, depth: int | None = None, seed: int = 42, **params) -> SparkLearner:
    return SparkLearner(RandomForestClassifier(
        numTrees=trees, maxDepth=min(depth or MAX_DEPTH, MAX_DEPTH), seed=seed, **params))


def bagged_trees(trees: int = 10, depth: int | None = None, seed: int = 42) -> SparkLearner:
    """Bootstrap-aggregated trees: a forest whose every split may use every feature."""
    return forest(trees, depth, seed, featureSubsetStrategy="all")


def decision_tree(depth: int | None = None, seed: int = 42) -> SparkLearner:
    return SparkLearner(DecisionTreeClassifier(maxDepth=min(depth or MAX_DEPTH, MAX_DEPTH), seed=seed))


def boosted_trees(rounds: int = 100, depth: int = 3, seed: int = 42) -> SparkLearner:
    """Gradient-boosted trees for several classes, one against the rest."""
    return SparkLearner(OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)))


def logistic(iterations: int = 100, one_vs_rest: bool = False) -> SparkLearner:
    plain = LogisticRegression(maxIter=iterations)
    return SparkLearner(OneVsRest(classifier=plain) if one_vs_rest else plain)


def perceptron(inputs: int, classes: int, hidden: int = 100, iterations: int = 200, seed: int = 42) -> SparkLearner:
    return SparkLearner(MultilayerPerceptronClassifier(layers=[inputs, hidden, classes], maxIter=iterations, seed=seed))


def feature_importances(model: SparkModel, features: list[str], spark) -> DataFrame:
    """(feature, importance), most important first; one row per feature."""
    values = model.model.featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def top_features(importances: DataFrame, n: int) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)
