"""Scores and diagnostics of predictions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.operators.smoothing import line_fit, scatter_points


def _scores(label: str, prediction: str) -> list[Column]:
    y = F.col(label).cast("double")
    err = y - F.col(prediction).cast("double")
    y = F.when(err.isNotNull(), y)
    return [
        F.count(err).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.avg(err * err), F.var_pop(y))).alias("r2"),
    ]


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Row count, RMSE and R2 in one pass; R2 is null for a constant label."""
    return df.agg(*_scores(label, prediction))


def cv_rmse(
    df: DataFrame, fold: str = "_fold", label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Mean of the per-fold RMSE (not the root of the mean squared error)."""
    err = F.col(label).cast("double") - F.col(prediction).cast("double")
    per_fold = df.groupBy(fold).agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    return per_fold.agg(F.count("*").cast("int").alias("folds"), F.avg("rmse").alias("cv_rmse"))


def residuals(
    df: DataFrame, label: str = "label", prediction: str = "prediction", name: str = "residual"
) -> DataFrame:
    """Label less prediction, per row."""
    return df.withColumn(name, F.col(label) - F.col(prediction))


def residual_summary(df: DataFrame, name: str = "residual") -> DataFrame:
    """Count, mean, deviation and range of a residual column, as one row."""
    return df.agg(
        F.count(name).alias("n"),
        F.avg(name).alias("mean"),
        F.stddev_pop(name).alias("std"),
        F.min(name).alias("lowest"),
        F.max(name).alias("highest"),
    )


def pred_vs_actual(
    df: DataFrame, label: str = "label", prediction: str = "prediction", step: float = 250
) -> tuple[DataFrame, DataFrame]:
    """All (label, prediction) points counted in square cells, and the straight line through them."""
    return scatter_points(df, label, prediction, step, step), line_fit(df, label, prediction)


def compare_models(scored: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One row of scores per model, smallest RMSE first.

    Maps a model name to a frame with its label and prediction columns.
    """
    rows = [
        evaluate(df, label, prediction).select(F.lit(name).alias("model"), "n", "rmse", "r2")
        for name, (df, label, prediction) in scored.items()
    ]
    return reduce(DataFrame.unionByName, rows).orderBy("rmse", "model")


def compare_by(df: DataFrame, by: str, label: str, predictions: Mapping[str, str]) -> DataFrame:
    """Scores of several predictions of the same rows per group, from one pass, smallest RMSE first.

    Maps a model name to its prediction column.
    """
    scores = [F.struct(F.lit(name).alias("name"), *_scores(label, p)) for name, p in predictions.items()]
    rows = df.groupBy(by).agg(F.array(*scores).alias("s")).select(by, F.explode("s").alias("s"))
    return rows.select(F.concat_ws(", ", "s.name", by).alias("model"), "s.n", "s.rmse", "s.r2").orderBy("rmse", "model")
