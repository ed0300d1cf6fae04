"""Forecast metrics (D22) and the naive seasonal baseline used by the SQL-checked query."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.numeric import round_to
from ..series import chrono_split

# fixed value: MAPE denominator guard of the original application
MAPE_EPS = 1e-8


def metric_columns(actual: str = "actual", predicted: str = "predicted", digits: int = 4) -> list[Column]:
    """MAE, RMSE, R² and MAPE (%) as aggregate expressions (group by series/model outside)."""
    e = F.col(actual) - F.col(predicted)
    sse = F.sum(e * e)
    sst = F.var_pop(actual) * F.count(actual)
    r2 = F.when(sst > 0, F.lit(1.0) - sse / sst).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    mape = F.avg(F.abs(e / (F.col(actual) + F.lit(MAPE_EPS)))) * 100
    return [
        round_to(F.avg(F.abs(e)), digits).alias("mae"),
        round_to(F.sqrt(F.avg(e * e)), digits).alias("rmse"),
        round_to(r2, digits).alias("r2"),
        round_to(mape, digits).alias("mape"),
    ]


def evaluate(points: DataFrame, group_cols: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Metrics per group over rows that have both an actual and a prediction."""
    p = points.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return p.groupBy(*group_cols).agg(*metric_columns(actual, predicted))


def seasonal_naive_points(ts: DataFrame, series_cols: Sequence[str] = (), season: int = 7, train_frac: float = 0.8) -> DataFrame:
    """Hold-out points of a seasonal-naive forecast: the value ``season`` days earlier."""
    w = Window.partitionBy(*series_cols).orderBy("ds")
    s = chrono_split(ts.withColumn("predicted", F.lag("y", season).over(w)), series_cols, train_frac)
    return s.where(~F.col("is_train")).select(*series_cols, F.col("ds").alias("date"), F.col("y").alias("actual"), "predicted")
