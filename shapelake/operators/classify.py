"""Classifiers on feature tables: linear SVM one against the rest, over train ratios."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..storage import materialize


def fit_svm(train: DataFrame, key: str, vector: str, label: str, costs: tuple[float, ...] = (1.0, 10.0), folds: int = 4):
    """(indexer, model): the best of ``costs`` by cross-validated accuracy."""
    indexer = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(train)
    rows = materialize(indexer.transform(train.select(key, label, array_to_vector(vector).alias("features"))))
    svm, n = LinearSVC(maxIter=10), max(1, rows.count())
    ovr = OneVsRest(classifier=svm, labelCol="y", featuresCol="features", predictionCol="p")
    if len(costs) == 1:
        return indexer, ovr.copy({svm.regParam: 1 / (costs[0] * n)}).fit(rows)
    grid = ParamGridBuilder().addGrid(ovr.classifier, [LinearSVC(maxIter=10, regParam=1 / (c * n)) for c in costs]).build()
    score = MulticlassClassificationEvaluator(labelCol="y", predictionCol="p", metricName="accuracy")
    return indexer, CrossValidator(estimator=ovr, estimatorParamMaps=grid, evaluator=score, numFolds=folds, seed=7).fit(rows).bestModel


def predict(fitted, items: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, label)"""
    indexer, model = fitted
    rows = model.transform(items.select(key, array_to_vector(vector).alias("features")))
    return rows.select(key, F.element_at(F.lit(indexer.labels).cast("array<string>"), F.col("p").cast("int") + 1).alias("label"))


def train_split(items: DataFrame, key: str, label: str, ratio: float, seed: int = 0) -> DataFrame:
    """Of each class the first floor(n * ratio) + 1 items by a seeded hash."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key))
    n = F.count("*").over(Window.partitionBy(label))
    return items.withColumn("__r", rank).withColumn("__n", n).filter(F.col("__r") <= F.floor(F.col("__n") * ratio) + 1).drop("__r", "__n")


def ratio_sweep(items: DataFrame, key: str, vector: str, label: str, ratios: list[float]) -> DataFrame:
    """(ratio, accuracy) on the rest of the items, one fit a ratio."""
    out = None
    for r in ratios:
        train = train_split(items, key, label, r)
        test = items.join(train.select(key), key, "left_anti")
        hit = predict(fit_svm(train, key, vector, label, costs=(1.0,)), test, key, vector).withColumnRenamed("label", "p").join(test.select(key, label), key)
        row = hit.agg(F.lit(r).alias("ratio"), F.avg((F.col("p") == F.col(label)).cast("double")).alias("accuracy"))
        out = row if out is None else out.union(row)
    return out


def accuracy_trend(curve: DataFrame) -> DataFrame:
    return curve.agg(F.regr_slope("accuracy", "ratio").alias("slope"), F.regr_intercept("accuracy", "ratio").alias("intercept"))


def transfer_accuracy(train: DataFrame, test: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(accuracy) on one table of a classifier fitted on another."""
    hit = predict(fit_svm(train, key, vector, label), test, key, vector).withColumnRenamed("label", "p").join(test.select(key, F.col(label).alias("t")), key)
    return hit.agg(F.avg((F.col("p") == F.col("t")).cast("double")).alias("accuracy"))


def fourier_features(x: Column, length: int, n: int, gamma: float | None = None, kind: str = "rbf", seed: int = 0) -> Column:
    """``n`` random features whose dot products near exp(-gamma d) of the squared Euclidean (rbf) or L1 (laplacian) distance d.

    gamma is 1 / length unless given; a linear classifier on them stands for one with the kernel.
    """
    gamma, r = gamma or 1 / length, np.random.default_rng(seed)
    w = r.normal(size=(n, length)) * math.sqrt(2 * gamma) if kind == "rbf" else r.standard_cauchy(size=(n, length)) * gamma
    shift = r.uniform(0, 2 * math.pi, n)
    rows = F.array(*(F.struct(F.lit(a.tolist()).alias("w"), F.lit(float(b)).alias("b")) for a, b in zip(w, shift, strict=True)))
    return F.transform(rows, lambda e: F.cos(dot(x, e["w"]) + e["b"]) * math.sqrt(2 / n))
