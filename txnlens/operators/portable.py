"""Fitted models as arrays: a task can then score row by row where each score feeds the next row.

Spark ML transforms whole frames only. ``array_model`` reads a fitted pipeline (imputer, assembler and a logistic model, a
tree, a forest or boosted trees) into a few arrays with the same probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel,
)
from pyspark.ml.feature import ImputerModel
from pyspark.sql import SparkSession

from txnlens.sources.scratch import fresh_dir


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


@dataclass(frozen=True)
class LinearModel:
    """``sigmoid(intercept + weights . x)``; missing values take the value in ``fill``."""

    features: tuple[str, ...]
    fill: np.ndarray
    weights: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + np.where(np.isnan(x), self.fill, x) @ self.weights)


@dataclass(frozen=True)
class TreeModel:
    """Trees side by side: node ``i`` sends rows with ``x[feature] <= threshold`` to ``left``; leaves have feature -1."""

    features: tuple[str, ...]
    fill: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    boosted: bool

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.fill, x)
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                break
            goes_left = x[row, np.maximum(feature, 0)] <= self.threshold[node]
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
        total = self.value[node] @ self.weights
        return _sigmoid(2 * total) if self.boosted else total / self.weights.sum()


def _trees(spark: SparkSession, stage, features: tuple[str, ...], fill: np.ndarray) -> TreeModel:
    """Node tables of the saved stage; their size is that of the model."""
    boosted = isinstance(stage, GBTClassificationModel)
    path = fresh_dir(spark, "trees")
    stage.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.selectExpr("treeID AS tree", "nodeData.*")
    else:
        nodes = nodes.selectExpr("0 AS tree", "*")
    table = nodes.selectExpr(
        "tree", "id", "leftChild", "rightChild", "prediction", "split.featureIndex AS feature", "split.numCategories AS categories",
        "split.leftCategoriesOrThreshold AS cut", "impurityStats AS stats").orderBy("tree", "id").collect()
    if any(r["categories"] >= 0 for r in table):
        raise ValueError("only trees over continuous features can be read")
    first: dict[int, int] = {}
    for i, r in enumerate(table):
        first.setdefault(r["tree"], i)
    weights = np.array(stage.treeWeights if boosted else np.ones(len(first)), float)
    values = [r["prediction"] if boosted else r["stats"][1] / sum(r["stats"]) for r in table]
    return TreeModel(
        features, fill, np.array([r["feature"] for r in table]), np.array([r["cut"][0] if r["cut"] else 0.0 for r in table]),
        np.array([first[r["tree"]] + max(r["leftChild"], 0) for r in table]),
        np.array([first[r["tree"]] + max(r["rightChild"], 0) for r in table]),
        np.array(values, float), np.array(list(first.values())), weights, boosted)


def array_model(spark: SparkSession, model: PipelineModel) -> LinearModel | TreeModel:
    """The fitted pipeline as arrays."""
    imputer, stage = model.stages[0], model.stages[-1]
    if not isinstance(imputer, ImputerModel):
        raise ValueError("the pipeline must begin with an imputer")
    features = tuple(imputer.getInputCols())
    medians = imputer.surrogateDF.first()
    fill = np.array([medians[f] for f in features], float)
    if isinstance(stage, LogisticRegressionModel):
        return LinearModel(features, fill, np.array(stage.coefficients.toArray(), float), float(stage.intercept))
    if isinstance(stage, (DecisionTreeClassificationModel, RandomForestClassificationModel, GBTClassificationModel)):
        return _trees(spark, stage, features, fill)
    raise ValueError(f"cannot read a {type(stage).__name__}")
