"""Boosted-tree forecast (M3): histogram gradient boosting, one model per series.

A series has a row per day, so its features are a few thousand rows at any data volume: each series is fitted whole
in its own grouped map, and the series spread over the cluster. (``gbt`` has one model over the pooled
rows of all series, by Spark ML.) Values are put in at most ``BINS`` bins by quantiles; a level of a tree
is grown by sums of gradients per (node, feature, bin), all nodes at once. Squared error, so every row weighs 1.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ...functions.dates import FEATURES
from ..series import with_calendar, with_lags
from .core import Recent, by_features, rollout, split_point, with_future
from .grouped import ForecastResult, future_points, importance_frame, points_frame, run_per_series

# fixed values: tree settings of the original forecaster, and its library's defaults
TREES, RATE, DEPTH, SUBSAMPLE, COLSAMPLE, SEED, PATIENCE = 300, 0.05, 6, 0.8, 0.8, 42, 20
PENALTY, LEAST_ROWS, TOP_FEATURES = 1.0, 1, 10
#: Bins of a feature; share of the training rows, the latest ones, that the patience rule looks at.
BINS, VALIDATION = 64, 0.1


def bin_edges(x: np.ndarray) -> np.ndarray:
    """Cuts between different values of a feature, at most BINS - 1, evenly by rows where there are more."""
    values = np.unique(x)
    if len(values) > BINS:
        values = np.unique(np.quantile(x, np.linspace(0, 1, BINS), method="lower"))
    return (values[:-1] + values[1:]) / 2


@dataclass
class Tree:
    """A full binary tree: the children of slot i are 2 i + 1 (value <= threshold) and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray


@dataclass
class Boosted:
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    gain: np.ndarray | None = None
    splits: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.base)
        feature = np.array([t.feature for t in self.trees])
        threshold = np.array([t.threshold for t in self.trees])
        value = np.array([t.value for t in self.trees])
        tree, row = np.arange(len(self.trees))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.trees)), dtype=int)
        for _ in range(DEPTH):
            f = feature[tree, at]
            below = 2 * at + 1 + (x[row, np.maximum(f, 0)] > threshold[tree, at])
            at = np.where(f < 0, at, below)
        return self.base + value[tree, at].sum(axis=1)

    def importances(self, names: Sequence[str]) -> dict[str, float]:
        """Mean gain of a feature's splits, as a share of the sum over features."""
        mean = self.gain / np.maximum(self.splits, 1)
        share = mean / mean.sum() if mean.sum() else mean
        return dict(sorted(zip(names, share.tolist()), key=lambda t: -t[1])[:TOP_FEATURES])

    def rows(self) -> pd.DataFrame:
        """The model as records: one per tree, the base value beside each."""
        return pd.DataFrame({
            "record": "tree",
            "feature": [json.dumps([t.feature.tolist(), t.threshold.tolist(), t.value.tolist()]) for t in self.trees],
            "importance": self.base,
        })

    @classmethod
    def from_rows(cls, rows: pd.DataFrame) -> "Boosted":
        trees = [Tree(*(np.array(x) for x in json.loads(text))) for text in rows["feature"]]
        return cls(float(rows["importance"].iloc[0]) if len(rows) else 0.0, trees)


class Binned:
    """Training rows by bin."""

    def __init__(self, x: np.ndarray):
        self.edges = [bin_edges(c) for c in x.T]
        self.at = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)]).astype(np.int32)


def grow(data: Binned, gradient: np.ndarray, rows: np.ndarray, features: np.ndarray, rate: float, gain: np.ndarray, splits: np.ndarray) -> Tree:
    """One tree on the given rows and features; adds its gains per feature to ``gain`` and ``splits``."""
    slots = 2 ** (DEPTH + 1) - 1
    tree = Tree(np.full(slots, -1), np.zeros(slots), np.zeros(slots))
    at, g = data.at[np.ix_(rows, features)], gradient[rows]
    node = np.zeros(len(rows), dtype=int)  # slot of each row
    n_f = len(features)
    place = np.arange(n_f)[None, :] * BINS + at
    open_rows = np.ones(len(rows), dtype=bool)
    for level in range(DEPTH + 1):
        first, width = 2**level - 1, 2**level
        own = node - first
        total = np.bincount(own[open_rows], g[open_rows], width)
        count = np.bincount(own[open_rows], minlength=width)
        tree.value[first : first + width] = np.where(count > 0, -rate * total / (count + PENALTY), 0.0)
        if level == DEPTH:
            break
        key = (own[open_rows, None] * (n_f * BINS) + place[open_rows]).ravel()
        sums = np.bincount(key, np.repeat(g[open_rows], n_f), width * n_f * BINS).reshape(width, n_f, BINS).cumsum(2)
        n = np.bincount(key, minlength=width * n_f * BINS).reshape(width, n_f, BINS).cumsum(2)
        right, n_right = total[:, None, None] - sums, count[:, None, None] - n
        better = sums**2 / (n + PENALTY) + right**2 / (n_right + PENALTY) - (total**2 / (count + PENALTY))[:, None, None]
        better[(n < LEAST_ROWS) | (n_right < LEAST_ROWS)] = 0.0
        flat = better.reshape(width, -1)
        best = flat.argmax(axis=1)
        found = flat[np.arange(width), best]
        split = found > 1e-12
        f, cut = features[best // BINS], best % BINS
        slot = first + np.flatnonzero(split)
        tree.feature[slot] = f[split]
        tree.threshold[slot] = [data.edges[a][b] for a, b in zip(f[split], cut[split])]
        np.add.at(gain, f[split], found[split])
        np.add.at(splits, f[split], 1)
        open_rows &= split[np.where(open_rows, own, 0)]
        if not open_rows.any():
            break
        moved = at[np.arange(len(rows)), (best // BINS)[np.where(open_rows, own, 0)]] > cut[np.where(open_rows, own, 0)]
        node = np.where(open_rows, 2 * node + 1 + moved, node)
    return tree


def boost(
    x: np.ndarray, y: np.ndarray, rounds: int = TREES, rate: float = RATE, seed: int = SEED,
    watch: tuple[np.ndarray, np.ndarray] | None = None, patience: int = PATIENCE,
) -> tuple[Boosted, int]:
    """A model of up to ``rounds`` trees, and the number of trees after which the error on the watched rows was
    least; the fit ends when that has not fallen for ``patience`` trees."""
    rng = np.random.default_rng(seed)
    data, n_f = Binned(x), x.shape[1]
    model = Boosted(float(y.mean()), [], np.zeros(n_f), np.zeros(n_f))
    now = np.full(len(y), model.base)
    held = np.full(len(watch[1]), model.base) if watch else None
    best, best_at = np.inf, 0
    for number in range(rounds):
        rows = np.sort(rng.choice(len(y), max(1, int(SUBSAMPLE * len(y))), replace=False))
        features = np.sort(rng.choice(n_f, max(1, int(COLSAMPLE * n_f)), replace=False))
        tree = grow(data, now - y, rows, features, rate, model.gain, model.splits)
        model.trees.append(tree)
        one = Boosted(0.0, [tree])
        now = now + one.predict(x)
        if watch:
            held = held + one.predict(watch[0])
            error = float(np.mean((held - watch[1]) ** 2))
            if error < best:
                best, best_at = error, number
            elif number - best_at >= patience:
                break
    return model, (best_at + 1 if watch else len(model.trees))


def _boosted_series(rounds: int, rate: float, validation: float, patience: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        days = pdf[pdf["is_future"]]
        pdf = pdf[~pdf["is_future"]].dropna(subset=FEATURES).reset_index(drop=True)  # warm-up rows
        x, y = pdf[FEATURES].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float)
        k = split_point(len(pdf))
        seen = int(np.floor(k * (1 - validation)))
        if seen < 2 or k >= len(pdf) or seen >= k:
            raise ValueError(f"series too short for the features and a hold-out split: {len(pdf)} rows")
        _, kept = boost(x[:seen], y[:seen], rounds, rate, watch=(x[seen:k], y[seen:k]), patience=patience)
        model, _ = boost(x[:k], y[:k], kept, rate)
        dates = [d.date() for d in pd.to_datetime(pdf["ds"])[k:]]
        hist = points_frame(dates, model.predict(x[k:]), actual=y[k:])
        fut = future_points(rollout(days, Recent(y), by_features(model.predict)))
        return pd.concat([hist, fut, importance_frame(model.importances(FEATURES)), model.rows()], ignore_index=True)

    return fit


def boosted_forecast(
    ts: DataFrame, series_cols: Sequence[str] = (), horizon: int = 30, rounds: int = TREES, rate: float = RATE,
    validation: float = VALIDATION, patience: int = PATIENCE,
) -> ForecastResult:
    """Boosted trees on calendar and lag features, 80/20 chronological split, recursive rollout.

    The number of trees is chosen on the latest part of the training rows, by the patience rule; a fit with so
    many on all training rows gives the model. Series too short for the features get an error row.
    """
    ft = with_lags(with_calendar(with_future(ts, series_cols, horizon)), series_cols)
    ft = ft.select(*series_cols, "ds", "y", "is_future", *FEATURES)
    return run_per_series(ft, series_cols, "xgboost", _boosted_series(rounds, rate, validation, patience))


__all__ = ["boosted_forecast", "boost", "Boosted"]
