"""Derived views of forecast results used by the reports."""

from __future__ import annotations

from typing import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ...functions.dates import FEATURES
from ...functions.numeric import round_to
from ...session import ship_package
from .boosting import Boosted

# fixed values: R² bands of the run report
R2_GOOD, R2_FAIR = 0.8, 0.5


def future_points(points: DataFrame) -> DataFrame:
    """Points after the training data."""
    return points.where(F.col("is_future"))


def split_dates(points: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """First future date per series and model: where the chart switches to forecasts."""
    return future_points(points).groupBy(*series_cols, "model").agg(F.min("date").alias("split_date"))


def chart_points(points: DataFrame) -> DataFrame:
    """Two-decimal values and the [lower, upper] band as one array column."""
    lo, hi = round_to("lower_bound", 2), round_to("upper_bound", 2)
    return points.select(
        *[c for c in points.columns if c not in ("predicted", "actual", "lower_bound", "upper_bound")],
        round_to("actual", 2).alias("actual"), round_to("predicted", 2).alias("predicted"),
        lo.alias("lower"), hi.alias("upper"),
        F.when(F.col("lower_bound").isNotNull() & F.col("upper_bound").isNotNull(), F.array(lo, hi)).alias("confidence"),
    )


def r2_band(metrics: DataFrame) -> DataFrame:
    """good / fair / poor colour band of R²."""
    return metrics.withColumn(
        "r2_band", F.when(F.col("r2") > R2_GOOD, "good").when(F.col("r2") > R2_FAIR, "fair").otherwise("poor")
    )


def relative_importance(importances: DataFrame, series_cols: Sequence[str] = (), n: int = 8) -> DataFrame:
    """The n strongest features per series/model as % of the strongest."""
    keys = [*series_cols, "model"]
    w = Window.partitionBy(*keys).orderBy(F.col("importance").desc(), F.col("feature"))
    top = importances.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    mx = F.max("importance").over(Window.partitionBy(*keys))
    return top.select(*keys, "feature", "importance", round_to(F.col("importance") / mx * 100, 0).alias("pct_of_max")).drop("_r")


def first_anomalies(anomalies: DataFrame, n: int = 20) -> DataFrame:
    """The first n flagged days in date order."""
    return anomalies.where(F.col("is_anomaly")).orderBy("date").limit(n)


def save_linear_model(result, path: str) -> None:
    """Persist the fitted coefficients of a linear model (A12), one row per series and feature."""
    result.coefficients.write.mode("overwrite").parquet(path)


def predict_linear(features: DataFrame, path: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """``features`` with the ``predicted`` values of a saved linear model."""
    s = list(series_cols)
    model = features.sparkSession.read.parquet(path).groupBy(*s).pivot("feature", [*FEATURES, "intercept"]).agg(F.first("coefficient"))
    model = model.select(*s, *[F.col(f).alias(f"__w_{f}") for f in (*FEATURES, "intercept")])
    if s:
        joined, weight = features.join(model, s), {f: F.col(f"__w_{f}") for f in (*FEATURES, "intercept")}
    else:  # one row of coefficients
        row = model.first()
        joined, weight = features, {f: F.lit(row[f"__w_{f}"]) for f in (*FEATURES, "intercept")}
    value = weight["intercept"]
    for f in FEATURES:
        value = value + F.col(f) * weight[f]
    return joined.select(*features.columns, value.alias("predicted"))


def save_trees(result, path: str) -> None:
    """Persist the trees of a boosted model (A12), one row per series and tree."""
    result.trees.write.mode("overwrite").parquet(path)


def predict_trees(features: DataFrame, path: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """``features`` with the ``predicted`` values of saved boosted models, series by series.

    Rows of a series without a model go; a series has at most a few hundred trees and a row per day.
    """
    s = list(series_cols)
    trees = features.sparkSession.read.parquet(path)
    if not s:
        features, trees = features.withColumn("__all", F.lit(0)), trees.withColumn("__all", F.lit(0))
    keys = s or ["__all"]
    columns = [c for c in features.columns if c != "__all"]
    schema = StructType([*features.select(*columns).schema.fields, StructField("predicted", DoubleType())])

    def score(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(model) or not len(rows):
            return pd.DataFrame(columns=[*columns, "predicted"])
        known = Boosted.from_rows(model.rename(columns={"tree": "feature", "base": "importance"}))
        return rows[columns].assign(predicted=known.predict(rows[FEATURES].to_numpy(dtype=float)))

    ship_package(features.sparkSession)
    return features.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(score, schema)


def save_spark_model(model, path: str) -> None:
    """Persist a fitted Spark ML model (A12), e.g. the pooled boosted-tree model."""
    model.write().overwrite().save(path)
