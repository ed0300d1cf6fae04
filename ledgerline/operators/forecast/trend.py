"""Trend and seasonality (M5): the published additive model (Taylor & Letham 2018), per series.

    y(t) / max|y| = m + k t + sum_j delta_j max(0, t - s_j) + yearly and weekly Fourier terms + noise

with t from 0 to 1 over the training days, 25 changepoints over their first 80 %, delta ~ Laplace(0, 0.05), Fourier
coefficients ~ N(0, 10), k, m ~ N(0, 5) and noise of half-normal scale 0.5. The most probable parameters are
found by reweighting: the Laplace prior is met by ridge penalties 1 / (tau |delta|), renewed until nothing
moves, from sums of squares and products of 53 columns; changes that end at nothing are 0.

The interval simulates what the trend may do: days after the training change the slope as often as changepoints
were spaced and by Laplace steps of the mean size found, so it widens with the horizon.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .core import split_point
from .grouped import ForecastResult, coefficient_frame, importance_frame, points_frame, run_per_series

# ---- fixed values of the published model and the original's settings ---------------------------
N_CHANGEPOINTS, CHANGEPOINT_RANGE = 25, 0.8
CHANGEPOINT_SCALE, SEASONALITY_SCALE, LEVEL_SCALE, NOISE_SCALE = 0.05, 10.0, 5.0, 0.5
YEARLY_ORDER, YEARLY_PERIOD = 10, 365.25
WEEKLY_ORDER, WEEKLY_PERIOD = 3, 7.0
INTERVAL = 0.95
# -------------------------------------------------------------------------------------------------
#: Simulated futures and their seed; rounds of reweighting at most; changes below this are none.
FUTURES, SEED = 1000, 42
ROUNDS, NONE = 500, 1e-5


def seasonal_columns(days: np.ndarray) -> np.ndarray:
    """Sine and cosine of every order, by absolute day."""
    cols = []
    for order, period in ((YEARLY_ORDER, YEARLY_PERIOD), (WEEKLY_ORDER, WEEKLY_PERIOD)):
        for k in range(1, order + 1):
            angle = 2 * np.pi * k * days / period
            cols += [np.sin(angle), np.cos(angle)]
    return np.column_stack(cols)


@dataclass
class Trend:
    start: float
    length: float
    size: float
    changepoints: np.ndarray
    offset: float
    slope: float
    delta: np.ndarray
    season: np.ndarray
    noise: float

    def scaled(self, days: np.ndarray) -> np.ndarray:
        return (days - self.start) / self.length

    def trend(self, days: np.ndarray) -> np.ndarray:
        t = self.scaled(days)
        return (self.offset + self.slope * t + np.maximum(0.0, t[:, None] - self.changepoints) @ self.delta) * self.size

    def predict(self, days: np.ndarray) -> np.ndarray:
        return self.trend(days) + seasonal_columns(days) @ self.season * self.size

    def interval(self, days: np.ndarray, seed: int = SEED, futures: int = FUTURES) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper end of the central 95 % of simulated futures, per day of a run of days after training."""
        rng = np.random.default_rng(seed)
        t = self.scaled(days)
        end = max(1.0, float(t[-1]))  # 1 is the last day of training
        step = float(np.mean(np.abs(self.delta))) + 1e-8 if len(self.delta) else 0.0
        paths = []
        for _ in range(futures):
            n = rng.poisson(len(self.changepoints) * (end - 1.0))
            at, by = rng.uniform(1.0, end, n), rng.laplace(0.0, step, n)
            paths.append(np.maximum(0.0, t[:, None] - at) @ by)
        # one draw of noise per future: each day has its spread, and the widths of days compare
        moved = np.array(paths) + rng.normal(0.0, self.noise, (futures, 1))
        low, high = np.quantile(moved, [(1 - INTERVAL) / 2, (1 + INTERVAL) / 2], axis=0) * self.size
        centre = self.predict(days)
        return centre + low, centre + high


def fit_trend(days: np.ndarray, y: np.ndarray) -> Trend:
    """The most probable parameters for a series of days (numbers) and values."""
    size = float(np.abs(y).max()) or 1.0
    start, length = float(days[0]), max(float(days[-1] - days[0]), 1.0)
    n_cp = min(N_CHANGEPOINTS, max(0, int(len(days) * CHANGEPOINT_RANGE) - 1))
    t = (days - start) / length
    history = int(np.floor(len(days) * CHANGEPOINT_RANGE))
    places = np.linspace(0, history - 1, n_cp + 1).round().astype(int)[1:]
    cps = t[places]
    X = np.column_stack([np.ones(len(t)), t, np.maximum(0.0, t[:, None] - cps), seasonal_columns(days)])
    z, n = y / size, len(y)
    G, c, zz = X.T @ X, X.T @ z, float(z @ z)
    hinge = slice(2, 2 + n_cp)
    prior = np.full(X.shape[1], 1.0 / SEASONALITY_SCALE**2)
    prior[:2] = 1.0 / LEVEL_SCALE**2
    beta, s2 = np.zeros(X.shape[1]), max(float(np.var(z)), 1e-12)
    size_of = np.full(n_cp, 1.0)
    for _ in range(ROUNDS):
        prior[hinge] = 1.0 / (CHANGEPOINT_SCALE * np.maximum(size_of, 1e-9))
        new = np.linalg.solve(G + s2 * np.diag(prior), c)
        rest = max(zz - 2 * new @ c + new @ G @ new, 1e-12 * n)
        # noise with its half-normal prior: n / s - rest / s^3 + s / scale^2 = 0
        new_s2 = NOISE_SCALE**2 * (-n + np.sqrt(n * n + 4 * rest / NOISE_SCALE**2)) / 2
        still = np.abs(new - beta).max() < 1e-7 and abs(new_s2 - s2) < 1e-7 * s2
        beta, s2, size_of = new, max(new_s2, 1e-12), np.abs(new[hinge])
        if still:
            break
    delta = np.where(np.abs(beta[hinge]) < NONE, 0.0, beta[hinge])
    return Trend(start, length, size, cps, beta[0], beta[1], delta, beta[2 + n_cp:], float(np.sqrt(s2)))


def _trend_series(horizon: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, ds = pdf["y"].to_numpy(dtype=float), pd.to_datetime(pdf["ds"])
        k = split_point(len(pdf))
        if k < 10 or k >= len(pdf):
            raise ValueError(f"series too short for a hold-out split: {len(pdf)} rows")
        days = (ds - pd.Timestamp("1970-01-01")).dt.days.to_numpy(dtype=float)
        model = fit_trend(days[:k], y[:k])
        ahead = days[-1] + np.arange(1, horizon + 1, dtype=float)
        tested, future = model.predict(days[k:]), model.predict(ahead)
        low, high = model.interval(np.concatenate([days[k:], ahead]))
        hist = points_frame([d.date() for d in ds[k:]], np.maximum(0, tested), actual=y[k:], raw=tested)
        dates = [(ds.iloc[-1] + pd.Timedelta(days=i + 1)).date() for i in range(horizon)]
        fut = points_frame(dates, np.maximum(0, future), lower=np.maximum(0, low[len(tested):]), upper=high[len(tested):], future=True)
        imp = {"trend": float(np.mean(model.trend(np.concatenate([days, ahead])))), "yearly": 1.0, "weekly": 1.0}
        per_day = model.size / model.length
        changes = [(pd.Timestamp("1970-01-01") + pd.Timedelta(days=model.start + c * model.length)).date() for c in model.changepoints]
        slopes = coefficient_frame(
            ["slope", *(f"change_{d}" for d in changes)], [model.slope * per_day, *(model.delta * per_day)], model.offset * model.size
        )
        return pd.concat([hist, fut, importance_frame(imp), slopes], ignore_index=True)

    return fit


def trend_forecast(ts: DataFrame, series_cols: Sequence[str] = (), horizon: int = 30) -> ForecastResult:
    """Piecewise-linear trend with sparse changes, yearly and weekly seasonality, simulated intervals.

    ``coefficients`` has the slope a day, its change at each changepoint (most are 0) and the level at the start.
    """
    return run_per_series(ts, series_cols, "prophet", _trend_series(horizon))


__all__ = ["trend_forecast", "fit_trend"]
