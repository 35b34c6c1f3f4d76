"""Boosted trees for panels: regression on log1p of a target, and weighted classification; nulls stay nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Booster, Params, fit


def fit_regression(df: DataFrame, columns: list[str], target: str, validation: DataFrame | None = None, iterations: int = 2500, rate: float = 0.03, depth: int = 4, share: float = 0.8, columns_share: float = 0.8, patience: int = 60, seed: int = 42, checkpoint: str | None = None) -> Booster:
    """Trees on log1p of the target, with rows and columns drawn for each tree; a validation frame stops them early.

    The trees of least validation error are kept; with `checkpoint` a restart goes on (see fit()).
    """
    rows = df.withColumn("held_", F.lit(False))
    if validation is not None:
        rows = rows.unionByName(validation.withColumn("held_", F.lit(True)))
    p = Params(rounds=iterations, rate=rate, depth=depth, row_share=share, column_share=columns_share, patience=patience if validation is not None else 0, seed=seed)
    return fit(rows, columns, F.log1p(target), p, held=F.col("held_"), checkpoint=checkpoint)


def fit_classifier(df: DataFrame, columns: list[str], label: str, weight: str, iterations: int = 800, rate: float = 0.03, depth: int = 4, share: float = 0.8, columns_share: float = 0.8, seed: int = 42) -> Booster:
    """Trees for a 0/1 label with row weights."""
    p = Params(rounds=iterations, rate=rate, depth=depth, row_share=share, column_share=columns_share, loss="logistic", seed=seed)
    return fit(df, columns, F.col(label), p, weight=F.col(weight))


def predict(model: Booster, df: DataFrame, log_target: bool = False) -> DataFrame:
    """df with `prediction`: the target (log_target), the margin, or for a classifier 0 or 1, with `probability`."""
    out = model.predict("prediction")(df)
    if model.params.loss == "logistic":
        return out.withColumn("probability", F.col("prediction")).withColumn("prediction", (F.col("prediction") >= 0.5).cast("double"))
    return out.withColumn("prediction", F.expm1("prediction")) if log_target else out


def importances(spark, model: Booster) -> DataFrame:
    return spark.createDataFrame(model.importances(), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def fold_importances(spark, models: list[Booster]) -> DataFrame:
    """(feature, importance, folds): the mean importance over the models of several folds, greatest first."""
    frame = spark.createDataFrame([r for m in models for r in m.importances()], "feature string, importance double")
    return frame.groupBy("feature").agg((F.sum("importance") / len(models)).alias("importance"), F.count("*").alias("folds")).orderBy(F.desc("importance"), "feature")
