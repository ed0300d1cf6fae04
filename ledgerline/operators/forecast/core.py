"""Ridge and the recursive rollout, on one series at a time.

A rolled-up series has one row per day, so it is bounded by the calendar, not by the data volume;
Spark spreads series over the cluster. Calendar features of past and future days come from
``functions.dates`` on the executors' JVM; here only the lag and rolling features of a day not seen
yet are made, from a state of the last 30 values.
"""

from __future__ import annotations

from collections import deque
from typing import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.dates import CALENDAR_FEATURES, LAGS, ROLLING_WINDOWS

# fixed values of the original forecasters
Z95 = 1.96
INTERVAL_WINDOW = 30
SHORT_HISTORY_SHARE = 0.1
TRAIN_SHARE = 0.8


def with_future(ts: DataFrame, series_cols: Sequence[str], horizon: int) -> DataFrame:
    """The series and ``horizon`` more days after each one's last, with NULL ``y`` and ``is_future``."""
    last = F.lead("ds").over(Window.partitionBy(*series_cols).orderBy("ds")).isNull()
    days = F.when(F.col("_last"), F.sequence(F.col("ds"), F.date_add("ds", int(horizon)))).otherwise(F.array("ds"))
    rows = ts.withColumn("_last", last).select(*series_cols, "y", F.posexplode(days).alias("_pos", "ds"))
    is_future = F.col("_pos") > 0
    return rows.select(*series_cols, "ds", F.when(~is_future, F.col("y")).alias("y"), is_future.alias("is_future"))


class Ridge:
    """Ridge regression on standardised features (population std), intercept unpenalised."""

    def __init__(self, alpha: float | np.ndarray = 1.0):
        self.alpha = alpha  # a scalar, or one penalty per column

    def fit(self, X: np.ndarray, y: np.ndarray) -> "Ridge":
        self.mu = X.mean(axis=0)
        sd = X.std(axis=0)
        sd[sd == 0] = 1.0
        self.sd = sd
        Xs = (X - self.mu) / sd
        self.y0 = float(y.mean())
        A = Xs.T @ Xs + np.diag(np.broadcast_to(np.asarray(self.alpha, dtype=float), (X.shape[1],)))
        self.coef = np.linalg.solve(A, Xs.T @ (y - self.y0))
        return self

    def predict(self, X: np.ndarray) -> np.ndarray:
        return ((X - self.mu) / self.sd) @ self.coef + self.y0


class Recent:
    """The newest values of a series, with the sum and sum of squares of every rolling window.

    A push adds the new value to each window's sums and takes out the one that leaves it, so the
    state is 30 numbers and a step costs the same whatever the history.
    """

    WIDTHS = sorted({*ROLLING_WINDOWS, INTERVAL_WINDOW})

    def __init__(self, values: Iterable[float]):
        self.values: deque[float] = deque(maxlen=max(*LAGS, *self.WIDTHS))
        self.seen = 0
        self.total = dict.fromkeys(self.WIDTHS, 0.0)
        self.squares = dict.fromkeys(self.WIDTHS, 0.0)
        for v in values:
            self.push(float(v))

    def push(self, v: float) -> None:
        for w in self.WIDTHS:
            gone = self.values[-w] if len(self.values) >= w else 0.0
            self.total[w] += v - gone
            self.squares[w] += v * v - gone * gone
        self.values.append(v)
        self.seen += 1

    def mean(self, w: int) -> float:
        return self.total[w] / min(w, self.seen) if self.seen else 0.0

    def std(self, w: int) -> float:
        """Population std of a full window, 0 before it is full."""
        return float(np.sqrt(max(0.0, self.squares[w] / w - self.mean(w) ** 2))) if self.seen >= w else 0.0

    def features(self) -> list[float]:
        """Lags (one that is missing is the 30-value mean), then mean and std per rolling window."""
        lags = [self.values[-k] if self.seen >= k else self.mean(INTERVAL_WINDOW) for k in LAGS]
        return lags + [f(w) for w in ROLLING_WINDOWS for f in (self.mean, self.std)]

    def band(self) -> tuple[float, float]:
        """95 % interval around the newest value from the spread of the last 30; the lower end is
        at least 0 (M8, E10). Before 30 values the spread is a fixed share of the value."""
        centre = self.values[-1]
        spread = self.std(INTERVAL_WINDOW) if self.seen >= INTERVAL_WINDOW else SHORT_HISTORY_SHARE * centre
        return max(0.0, centre - Z95 * spread), centre + Z95 * spread


def rollout(days: pd.DataFrame, recent: Recent, next_value: Callable[[pd.Series, Recent], float]) -> pd.DataFrame:
    """Future points of ``days`` (M7): every value, not under 0, becomes history for the next."""

    def step(day) -> tuple:
        recent.push(max(0.0, float(next_value(day, recent))))
        return (day["ds"], recent.values[-1], *recent.band())

    found = [step(day) for _, day in days.iterrows()]
    out = pd.DataFrame(found, columns=["date", "predicted", "lower_bound", "upper_bound"])
    return out.assign(date=pd.to_datetime(out["date"]).dt.date)


def by_features(predict: Callable[[np.ndarray], np.ndarray], extra: Sequence[float] = ()) -> Callable[[pd.Series, Recent], float]:
    """Next value from a model over calendar, lag and rolling features (and ``extra`` ones behind)."""

    def next_value(day: pd.Series, recent: Recent) -> float:
        row = [*day[CALENDAR_FEATURES].astype(float), *recent.features(), *extra]
        return predict(np.array([row]))[0]

    return next_value


def split_point(n: int, frac: float = TRAIN_SHARE) -> int:
    return int(n * frac)
