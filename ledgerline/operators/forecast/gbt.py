"""One boosted-tree model over the pooled rows of all series, with Spark ML (M3; ``boosting`` has a model per
series): early stopping by prefix choice, and a rollout of all series in one grouped map (M7, M8).

Training is Spark's distributed ``GBTRegressor`` over the feature table; with several series, each
one's mean over its training rows is a numeric feature, so any number of series fits. Spark has
no patience-based early stopping: the model is fitted once with ``max_iter`` trees,
``evaluateEachIteration`` scores every prefix on a validation tail, the patience rule picks the
number of trees, and a fit with that many trees on all training rows gives the final model.

The rollout reads the trees as a table of nodes (at most trees x 2 ** (depth + 1), whatever the
input) and feeds every series' own predictions back on the executors, 30 values of state each.
"""

from __future__ import annotations

import math
from typing import Sequence
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...functions.dates import CALENDAR_FEATURES, FEATURES
from ...session import ensure_checkpoint_dir, ship_package, stored
from ..series import chrono_split, feature_table, with_calendar
from .core import Recent, by_features, rollout, with_future
from .grouped import RECORD_COLS, RECORD_FIELDS, ForecastResult, run_per_series

# fixed values: tree settings of the original forecaster
DEPTH, SUBSAMPLE, COLSAMPLE, SEED, PATIENCE = 6, 0.8, 0.8, 42, 20
TREES, RATE = 300, 0.05
LEVEL = "series_level"


def early_stop_prefix(losses: list[float], patience: int = PATIENCE) -> int:
    """Number of trees the patience rule keeps: best round before ``patience`` flat rounds."""
    best, best_i = math.inf, 0
    for i, v in enumerate(losses):
        if v < best:
            best, best_i = v, i
        elif i - best_i >= patience:
            break
    return best_i + 1


class Trees:
    """The nodes of a fitted model as arrays; predicts many rows without Spark."""

    def __init__(self, model: GBTRegressionModel):
        session = SparkSession.active()
        path = f"{ensure_checkpoint_dir(session)}/trees-{uuid4().hex}"
        model.save(path)
        nodes = session.read.parquet(f"{path}/data")
        flat = nodes.select(
            "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        ).orderBy("treeID", "id").toPandas()
        start = flat.groupby("treeID").cumcount().eq(0).to_numpy().nonzero()[0]
        base = np.repeat(start, np.diff(np.append(start, len(flat))))
        own = np.arange(len(flat))
        leaf = flat["leftChild"].to_numpy() < 0
        self.root, self.weight = start, np.array(model.treeWeights)
        self.left = np.where(leaf, own, base + flat["leftChild"].to_numpy())
        self.right = np.where(leaf, own, base + flat["rightChild"].to_numpy())
        self.feature = np.where(leaf, 0, flat["feature"].to_numpy())
        self.threshold = flat["threshold"].fillna(0.0).to_numpy(dtype=float)
        self.value = flat["prediction"].to_numpy(dtype=float)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.root, (len(x), len(self.root)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at] @ self.weight


def _records(df: DataFrame, s: list[str], kinds: dict[str, str]) -> DataFrame:
    return df.select(*s, *[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in RECORD_COLS])


def gbt_forecast(
    ts: DataFrame, series_cols: Sequence[str] = (), horizon: int = 30, max_iter: int = TREES,
    step_size: float = RATE, validation_frac: float = 0.1, patience: int = PATIENCE,
) -> ForecastResult:
    """Points, importances, metrics and errors; series too short for the features get an error row."""
    s = list(series_cols)
    spark = ts.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in RECORD_FIELDS}
    ts = stored(ts)
    ft = chrono_split(feature_table(ts, s), s)
    inputs = list(FEATURES)
    if s:
        level = F.avg(F.when(F.col("is_train"), F.col("y"))).over(Window.partitionBy(*s))
        ft = ft.withColumn(LEVEL, F.coalesce(level, F.lit(0.0)))
        inputs.append(LEVEL)
    w = Window.partitionBy(*s).orderBy("ds")
    n_train = F.count_if(F.col("is_train")).over(Window.partitionBy(*s))
    ft = stored(ft.withColumn("_is_val", F.col("is_train") & (F.row_number().over(w) > F.floor(n_train * (1 - validation_frac)))))
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(ft)

    def fit(n: int, data: DataFrame) -> GBTRegressionModel:
        return GBTRegressor(
            labelCol="y", featuresCol="features", maxIter=n, stepSize=step_size, maxDepth=DEPTH,
            subsamplingRate=SUBSAMPLE, featureSubsetStrategy=str(COLSAMPLE), seed=SEED,
        ).fit(data)

    probe = fit(max_iter, rows.where(F.col("is_train") & ~F.col("_is_val")))
    losses = probe.evaluateEachIteration(rows.where("_is_val"), "squared")  # max_iter numbers
    model = fit(early_stop_prefix(list(losses), patience), rows.where("is_train"))

    held_out = model.transform(rows.where(~F.col("is_train"))).select(
        *s, F.lit("xgboost").alias("model"), F.lit("point").alias("record"), F.col("ds").alias("date"),
        F.col("prediction").alias("predicted"), F.col("prediction").alias("raw"), F.col("y").alias("actual"),
        F.lit(False).alias("is_future"),
    )
    trees = Trees(model)
    day_cols = ["ds", "y", "is_future", *CALENDAR_FEATURES]
    days = with_calendar(with_future(ts, s, horizon)).select(*s, *day_cols)
    if s:
        days = days.join(ft.select(*s, LEVEL).distinct(), s, "left")

    def future(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf.loc[~pdf["is_future"], "y"]
        level = list(pdf[LEVEL].iloc[:1]) if LEVEL in pdf else []
        if len(known) <= 30 or any(pd.isna(v) for v in level):
            raise ValueError(f"series too short for the features: {len(known)} rows")
        rolled = rollout(pdf[pdf["is_future"]], Recent(known), by_features(trees.predict, level))
        return rolled.assign(record="point", raw=rolled["predicted"], is_future=True)

    ship_package(spark)
    ahead = run_per_series(days, s, "xgboost", future).records
    # ten rows of model metadata: one model serves all series, so its importances carry no key
    best = sorted(zip(inputs, model.featureImportances.toArray().tolist()), key=lambda t: -t[1])[:10]
    weights = spark.createDataFrame([(f, float(v)) for f, v in best], "feature string, importance double").select(
        *[F.lit(None).cast(ts.schema[c].dataType).alias(c) for c in s],
        F.lit("xgboost").alias("model"), F.lit("importance").alias("record"), "feature", "importance",
    )
    out = ForecastResult(
        _records(held_out, s, kinds).unionByName(ahead).unionByName(_records(weights, s, kinds)), s
    )
    out.model = model  # the fitted Spark ML model, for saving (A12)
    return out


__all__ = ["gbt_forecast", "early_stop_prefix", "Trees"]
