"""Train dispatcher (M10) and model comparison."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Sequence

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...session import stored
from .arima import arima_forecast
from .boosting import boosted_forecast
from .grouped import ForecastResult
from .models import ridge_forecast, sequence_forecast
from .trend import trend_forecast

# fixed values: model names accepted by the original application and its default comparison list
TRAINERS: dict[str, Callable[..., ForecastResult]] = {
    "linear": ridge_forecast,
    "xgboost": boosted_forecast,
    "arima": arima_forecast,
    "prophet": trend_forecast,
    "lstm": sequence_forecast,
}
DEFAULT_COMPARE = ["linear", "xgboost", "arima", "prophet"]


def train_model(ts: DataFrame, model_type: str, series_cols: Sequence[str] = (), horizon: int = 30, **kw) -> ForecastResult:
    """Name -> trainer; unknown names (also 'ensemble', which has no trainer) are rejected."""
    if model_type not in TRAINERS:
        raise ValueError(f"no trainer named {model_type!r}; there are {', '.join(TRAINERS)}")
    return TRAINERS[model_type](ts, series_cols, horizon, **kw)


def compare_models(ts: DataFrame, models: Sequence[str] = DEFAULT_COMPARE, series_cols: Sequence[str] = (), horizon: int = 30) -> DataFrame:
    """Metrics of every requested model per series; failures stay as rows (status 'failed').

    The series is written once and every model reads it; each model is fitted once. The models are
    submitted together, as concurrent Spark jobs. Output:
    series..., model, request_pos, status, mae, rmse, r2, mape, error, best_model.
    """
    s = list(series_cols)
    spark = ts.sparkSession
    base = stored(ts)
    scores = ("mae", "rmse", "r2", "mape")

    def trained(name: str) -> DataFrame:
        res = train_model(base, name, s, horizon)
        res.records = stored(res.records)  # small; metrics and errors both read it, the model is fitted once
        ok = res.metrics.select(*s, "model", F.lit("success").alias("status"), *scores, F.lit(None).cast("string").alias("error"))
        none = [F.lit(None).cast("double").alias(c) for c in scores]
        return ok.unionByName(res.errors.select(*s, "model", F.lit("failed").alias("status"), *none, "error"))

    def failed(name: str, error: Exception) -> DataFrame:
        """A model that cannot run at all fails for every series."""
        src = base.select(*s).distinct() if s else spark.range(1)
        none = [F.lit(None).cast("double").alias(c) for c in scores]
        return src.select(*s, F.lit(name).alias("model"), F.lit("failed").alias("status"), *none, F.lit(f"{type(error).__name__}: {error}").alias("error"))

    def row(name: str) -> DataFrame:
        try:
            return trained(name)
        except Exception as e:
            return failed(name, e)

    with ThreadPoolExecutor(max_workers=max(1, len(models))) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(row), models))
    parts = [part.withColumn("request_pos", F.lit(pos)) for pos, part in enumerate(parts)]
    allm = parts[0]
    for p in parts[1:]:
        allm = allm.unionByName(p)
    w = Window.partitionBy(*s).orderBy(F.col("rmse").asc_nulls_last(), F.col("request_pos"))
    best = F.first(F.when(F.col("status") == "success", F.col("model")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return allm.select("*", F.coalesce(best, F.lit(models[0])).alias("best_model"))
