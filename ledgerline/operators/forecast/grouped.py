"""Run a per-series forecaster as one grouped pandas map and split its output.

Output records of every forecaster share one schema:
series..., model, record ('point' | 'importance' | 'coefficient' | 'tree' | 'error'), date, predicted, lower_bound,
upper_bound, actual, raw (the prediction before it is cut at 0), is_future, feature, importance, error.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, StringType, StructField, StructType

from ...session import ship_package
from .metrics import evaluate

RECORD_FIELDS = [
    StructField("model", StringType()),
    StructField("record", StringType()),
    StructField("date", DateType()),
    StructField("predicted", DoubleType()),
    StructField("lower_bound", DoubleType()),
    StructField("upper_bound", DoubleType()),
    StructField("actual", DoubleType()),
    StructField("raw", DoubleType()),
    StructField("is_future", BooleanType()),
    StructField("feature", StringType()),
    StructField("importance", DoubleType()),
    StructField("error", StringType()),
]
RECORD_COLS = [f.name for f in RECORD_FIELDS]
POINT_COLS = ["date", "predicted", "lower_bound", "upper_bound", "actual", "is_future"]


def points_frame(dates, predicted, actual=None, lower=None, upper=None, future=False, raw=None) -> pd.DataFrame:
    n = len(dates)
    return pd.DataFrame({
        "record": "point",
        "date": list(dates),
        "predicted": pd.Series(predicted, dtype="float64").to_numpy(),
        "lower_bound": pd.Series([None] * n if lower is None else lower, dtype="float64").to_numpy(),
        "upper_bound": pd.Series([None] * n if upper is None else upper, dtype="float64").to_numpy(),
        "actual": pd.Series([None] * n if actual is None else actual, dtype="float64").to_numpy(),
        "raw": pd.Series(predicted if raw is None else raw, dtype="float64").to_numpy(),
        "is_future": future,
    })


def future_points(rolled: pd.DataFrame) -> pd.DataFrame:
    return points_frame(
        rolled["date"], rolled["predicted"], lower=rolled["lower_bound"], upper=rolled["upper_bound"], future=True
    )


def importance_frame(items: dict[str, float]) -> pd.DataFrame:
    return pd.DataFrame({"record": "importance", "feature": list(items), "importance": [float(v) for v in items.values()]})


def coefficient_frame(features: Sequence[str], coef, intercept: float) -> pd.DataFrame:
    """Coefficients on unscaled features, the intercept last; the value is in ``importance``."""
    return pd.DataFrame({
        "record": "coefficient", "feature": [*features, "intercept"], "importance": [*map(float, coef), intercept],
    })


@dataclass
class ForecastResult:
    """points (historical test points + future points), importances, metrics, errors."""

    records: DataFrame
    series_cols: list[str]
    model: object = None

    @property
    def points(self) -> DataFrame:
        return self.records.where(F.col("record") == "point").select(*self.series_cols, "model", *POINT_COLS)

    @property
    def importances(self) -> DataFrame:
        return self.records.where(F.col("record") == "importance").select(*self.series_cols, "model", "feature", "importance")

    @property
    def coefficients(self) -> DataFrame:
        """series..., feature, coefficient of linear models (the one named intercept is added)."""
        rows = self.records.where(F.col("record") == "coefficient")
        return rows.select(*self.series_cols, "feature", F.col("importance").alias("coefficient"))

    @property
    def trees(self) -> DataFrame:
        """series..., tree, base: the trees of boosted models (any order), as JSON, and the value their sum is
        added to."""
        rows = self.records.where(F.col("record") == "tree")
        return rows.select(*self.series_cols, F.col("feature").alias("tree"), F.col("importance").alias("base"))

    @property
    def errors(self) -> DataFrame:
        return self.records.where(F.col("record") == "error").select(*self.series_cols, "model", "error")

    @property
    def metrics(self) -> DataFrame:
        """Hold-out metrics of the raw predictions; only stored points are cut at 0."""
        hist = self.records.where((F.col("record") == "point") & ~F.col("is_future"))
        return evaluate(hist, [*self.series_cols, "model"], predicted="raw")


def run_per_series(
    data: DataFrame, series_cols: Sequence[str], model: str, fn: Callable[[pd.DataFrame], pd.DataFrame]
) -> ForecastResult:
    """Apply ``fn`` (one series, sorted by ``ds``) to every series with ``applyInPandas``.

    Failures of one series become an 'error' record instead of failing the job, as the
    model comparison keeps failed models as rows.
    """
    s = list(series_cols)
    key_fields = [data.schema[c] for c in s]
    schema = StructType(key_fields + RECORD_FIELDS)
    keyed = data if s else data.withColumn("_series", F.lit(0))
    group = s or ["_series"]

    def wrapper(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds").reset_index(drop=True)
        try:
            out = fn(pdf)
        except Exception as e:  # the error travels as data
            out = pd.DataFrame({"record": ["error"], "error": [f"{type(e).__name__}: {e}"]})
        for c in RECORD_COLS:
            if c not in out.columns:
                out[c] = None
        out["model"] = model
        for c in s:
            out[c] = pdf[c].iloc[0] if len(pdf) else None
        out["is_future"] = out["is_future"].astype("object").where(out["is_future"].notna(), None)
        return out[[*s, *RECORD_COLS]]

    ship_package(data.sparkSession)
    records = keyed.groupBy(*group).applyInPandas(wrapper, schema)
    return ForecastResult(records, s)
