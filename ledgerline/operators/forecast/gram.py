"""Ridge fits from sums of products (M2): the history of a series is never gathered.

All that a ridge fit needs of a series is how many rows it has and the sums of its features and of their
products, with the target as one of them: 27 x 27 numbers, one partial-and-final aggregate per series. New days are
added to stored sums. Features are moved by fixed amounts first, so that products of large, nearly constant
features (the year) keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ...functions.dates import FEATURES
from ...session import ship_package
from .models import RIDGE_ALPHA

#: Amounts that features are moved by; the others stay.
MOVED = {"year": 2000.0, "week_of_year": 26.0, "month": 6.0, "day_of_month": 15.0, "day_of_year": 183.0}
TARGET = "y"


def gram_sums(ft: DataFrame, series_cols: Sequence[str] = (), features: Sequence[str] = FEATURES) -> DataFrame:
    """series..., rows, sums (array): per series the sums of products i <= j of (1, features..., y), row by row.

    Rows with a missing feature or target have no part. One aggregate, combined before the shuffle.
    """
    cols = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(MOVED.get(c, 0.0)) for c in features], F.col(TARGET).cast("double")]
    known = ft.dropna(subset=[*features, TARGET]).select(*series_cols, *[c.alias(f"_{i}") for i, c in enumerate(cols)])
    products = [F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = known.groupBy(*series_cols).agg(F.count(F.lit(1)).alias("rows"), *[p.alias(f"s{n}") for n, p in enumerate(products)])
    return sums.select(*series_cols, "rows", F.array(*[f"s{n}" for n in range(len(products))]).alias("sums")).where("rows > 0")


def merged_sums(sums: DataFrame, more: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Sums of the rows of both: those of stored days, and those of new ones."""
    n = sums.unionByName(more).select(*series_cols, "rows", F.posexplode("sums").alias("at", "v"))
    each = n.groupBy(*series_cols, "at").agg(F.sum("v").alias("v"), F.sum("rows").alias("rows"))
    return each.groupBy(*series_cols).agg(
        F.max("rows").alias("rows"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("sums")
    )


def matrix(sums: Sequence[float], size: int) -> np.ndarray:
    """The full matrix of sums of products."""
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = sums
    return m + np.triu(m, 1).T


def ridge_from_sums(sums: Sequence[float], features: Sequence[str] = FEATURES, alpha: float = RIDGE_ALPHA) -> tuple[np.ndarray, float]:
    """(coefficients on unscaled features, intercept) of ridge on standardised features, intercept unpenalised."""
    m = matrix(sums, len(features) + 2)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    sd[sd <= 1e-12 * (1 + np.abs(mean[:-1]))] = 1.0
    x = n * cov[:-1, :-1] / np.outer(sd, sd)
    xy = n * cov[:-1, -1] / sd
    coef = np.linalg.solve(x + alpha * np.eye(len(features)), xy) / sd
    moved = np.array([MOVED.get(c, 0.0) for c in features])
    return coef, float(mean[-1] - coef @ (mean[:-1] + moved))


def ridge_coefficients(
    ft: DataFrame, series_cols: Sequence[str] = (), features: Sequence[str] = FEATURES, alpha: float = RIDGE_ALPHA,
) -> DataFrame:
    """series..., feature, coefficient (one named intercept is added) of a feature table, as ``views.predict_linear``
    reads them."""
    return solved(gram_sums(ft, series_cols, features), series_cols, features, alpha)


def _per_series(sums: DataFrame, series_cols: Sequence[str], columns: list[StructField], of: Callable[[Sequence[float]], list]) -> DataFrame:
    """series... and a row for each entry of the columns that ``of`` makes of a series' sums, where the sums lie."""
    s = list(series_cols)
    schema = StructType([*[sums.schema[c] for c in s], *[StructField(f.name, ArrayType(f.dataType)) for f in columns]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [of(x) for x in batch["sums"]]
            yield pd.DataFrame({**{c: batch[c] for c in s}, **{f.name: [x[n] for x in found] for n, f in enumerate(columns)}})

    ship_package(sums.sparkSession)
    both = sums.select(*s, "sums").mapInPandas(run, schema)
    return both.select(*s, F.inline(F.arrays_zip(*[f.name for f in columns])))


def solved(sums: DataFrame, series_cols: Sequence[str] = (), features: Sequence[str] = FEATURES, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """The coefficients from sums, one row of which is a fit."""

    def fit(x: Sequence[float]) -> list:
        coef, intercept = ridge_from_sums(x, features, alpha)
        return [[*features, "intercept"], [*map(float, coef), intercept]]

    return _per_series(sums, series_cols, [StructField("feature", StringType()), StructField("coefficient", DoubleType())], fit)


def correlations(sums: DataFrame, series_cols: Sequence[str] = (), features: Sequence[str] = FEATURES) -> DataFrame:
    """series..., a, b, correlation for all pairs of features and the target, from the sums alone; null where one
    does not vary."""
    names = [*features, TARGET]

    def pairs(x: Sequence[float]) -> list:
        m = matrix(x, len(names) + 1)
        moment = m[0, 0] * m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:])
        spread = np.sqrt(np.maximum(np.outer(np.diag(moment), np.diag(moment)), 0.0))
        i, j = np.triu_indices(len(names), 1)
        found = [moment[a, b] / spread[a, b] if spread[a, b] > 0 else None for a, b in zip(i, j)]
        return [[names[a] for a in i], [names[b] for b in j], found]

    text = StringType()
    return _per_series(sums, series_cols, [StructField("a", text), StructField("b", text), StructField("correlation", DoubleType())], pairs)
