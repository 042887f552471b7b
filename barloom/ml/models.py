"""Models over walk-forward splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barloom.operators.analysis import ic_summary, rank_ic
from barloom.session import stage_table


def ridge(x: np.ndarray, y: np.ndarray, strength: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (intercept first) on standardised features, their means and deviations."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(spread > 1e-12, spread, 1.0)
    a = np.column_stack([np.ones(len(z)), z])
    penalty = strength * len(z) * np.eye(a.shape[1])
    penalty[0, 0] = 0
    return np.linalg.solve(a.T @ a + penalty, a.T @ y), mean, np.where(spread > 1e-12, spread, 1.0)


def predict_linear(dataset: DataFrame, splits: DataFrame, features: Sequence[str], label: str = "label", *, least_train: int = 30, least_test: int = 10, strength: float = 1e-3) -> DataFrame:
    """(split, symbol, date, prediction, label, importance): one linear model per split, fitted from normal equations.

    The normal equations of each split are sums, so training rows are aggregated in the JVM and never gathered; only test rows meet
    the coefficients. Splits with under ``least_train`` train rows or ``least_test`` test rows are left out. ``importance`` is the share of the
    absolute coefficients on standardised features.
    """
    joined = stage_table(dataset.join(splits, "date").select("split", "part", "symbol", "date", *features, label), "learn")  # read by both parts
    train, test = joined.where("part = 'train'"), joined.where("part = 'test'")
    k = len(features)
    names = [*features, label]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s{i}") for i, a in enumerate(names)], *[F.sum(F.col(a) * F.col(b)).alias(f"q{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]]
    moments = train.groupBy("split").agg(*sums)
    counts = test.groupBy(F.col("split").alias("__sp")).agg(F.count(F.lit(1)).alias("__nt"))
    moments = moments.join(counts, F.col("split") == F.col("__sp")).where((F.col("n") >= least_train) & (F.col("__nt") >= least_test))

    def solve(parts):
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                n = r.n
                s = np.array([getattr(r, f"s{i}") for i in range(k + 1)])
                q = np.array([[getattr(r, f"q{min(i, j)}_{max(i, j)}") for j in range(k + 1)] for i in range(k + 1)])
                c = q / n - np.outer(s, s) / n / n
                spread = np.sqrt(np.maximum(np.diag(c)[:k], 0))
                spread = np.where(spread > 1e-12, spread, 1.0)
                b = np.linalg.solve(c[:k, :k] / np.outer(spread, spread) + strength * np.eye(k), c[:k, k] / spread)
                w = b / spread
                total = np.abs(b).sum()
                rows.append([r.split, s[k] / n - float(w @ s[:k]) / n, w.tolist(), (np.abs(b) / total if total > 0 else np.zeros(k)).tolist()])
            yield pd.DataFrame(rows, columns=["split", "intercept", "w", "importance"])

    models = moments.mapInPandas(solve, "split int, intercept double, w array<double>, importance array<double>")
    scored = test.join(models.withColumnRenamed("split", "__m"), F.col("split") == F.col("__m"))
    total = F.col("intercept")
    for i, f in enumerate(features):
        total = total + F.col(f) * F.col("w")[i]
    return scored.select("split", "symbol", "date", total.alias("prediction"), F.col(label).alias("label"), "importance")


def predict_with(estimator, dataset: DataFrame, splits: DataFrame, features: Sequence[str], label: str = "label", *, least_train: int = 30, least_test: int = 10) -> DataFrame:
    """As predict_linear with any estimator of the session's machine learning that reads ``__x`` and the label and gives ``prediction``.

    Each split is one distributed fit, splits follow one another (there are few of them), and a split's predictions are staged. Importance is
    the model's own (or the share of its absolute coefficients), else zeros.
    """
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=list(features), outputCol="__x").transform(dataset.join(splits, "date")).persist()
    out = None
    counts = ready.groupBy("split").agg(F.count_if(F.col("part") == "train").alias("a"), F.count_if(F.col("part") == "test").alias("b")).where((F.col("a") >= least_train) & (F.col("b") >= least_test))
    for split in sorted(r.split for r in counts.collect()):
        part = ready.where(F.col("split") == split)
        model = estimator.fit(part.where("part = 'train'"))
        told = getattr(model, "featureImportances", None)
        told = told if told is not None else getattr(model, "coefficients", None)
        parts = np.abs(told.toArray()) if told is not None else np.zeros(len(features))
        weights = F.array(*[F.lit(float(x / (parts.sum() or 1.0))) for x in parts])
        scored = stage_table(model.transform(part.where("part = 'test'")).select("split", "symbol", "date", "prediction", F.col(label).alias("label"), weights.alias("importance")), "scored")
        out = scored if out is None else out.unionByName(scored)
    empty = ready.select("split", "symbol", "date", F.col(label).alias("prediction"), F.col(label).alias("label"), F.array().cast("array<double>").alias("importance")).limit(0)
    if out is not None:
        ready.unpersist()
    return out if out is not None else empty


def predict_trees(dataset: DataFrame, splits: DataFrame, features: Sequence[str], label: str = "label", *, rounds: int = 20, rate: float = 0.05, depth: int = 5, least_train: int = 30, least_test: int = 10) -> DataFrame:
    """predict_with boosted trees."""
    from pyspark.ml.regression import GBTRegressor

    trees = GBTRegressor(featuresCol="__x", labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=7)
    return predict_with(trees, dataset, splits, features, label, least_train=least_train, least_test=least_test)


def prediction_ic(predictions: DataFrame) -> DataFrame:
    """Summary of the daily rank correlation of predictions and labels."""
    return ic_summary(rank_ic(predictions, "prediction", "label"))


def yearly_splits(dates: DataFrame, least_years: int = 2) -> DataFrame:
    """(split, date, part): each year is predicted from all years before it, from the third year on."""
    d = dates.select("date").distinct().withColumn("y", F.year("date"))
    span = d.agg(F.min("y").alias("a"), F.max("y").alias("z"))
    row = span.first()
    if row.a is None:
        return d.select(F.col("y").alias("split"), "date", F.lit("train").alias("part")).limit(0)
    each = d.select("date", "y", F.explode(F.sequence(F.greatest(F.col("y"), F.lit(row.a + least_years)), F.greatest(F.lit(row.z), F.lit(row.a + least_years)))).alias("split"))
    return each.where(F.col("split") <= row.z).select("split", "date", F.when(F.col("y") == F.col("split"), "test").otherwise("train").alias("part"))
