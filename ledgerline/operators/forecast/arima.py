"""ARIMA (M4): state-space form, exact Gaussian likelihood by the Kalman filter, per series.

The differenced series is an ARMA(p, q) around 0 with state

    a[t+1] = T a[t] + R e[t+1],   z[t] = first element of a[t]

(T the companion matrix of the AR part, R = (1, theta)). The filter starts from the stationary state, so the
likelihood is that of the whole sample, none conditioned away. The noise variance is concentrated out. The
coefficients are searched as partial autocorrelations (Barndorff-Nielsen & Schou 1973, Monahan 1984),
which keeps every step stationary and invertible, by BFGS from the Hannan-Rissanen estimate; a step is taken
only if it raises the likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .core import Z95, split_point
from .grouped import ForecastResult, coefficient_frame, points_frame, run_per_series

# fixed values of the original forecaster: the order, and the one taken when it cannot be fitted
ARIMA_ORDER, ARIMA_FALLBACK = (2, 1, 2), (1, 1, 1)
#: Partial autocorrelations stay within this; a filter whose state variance changes less than TOLERANCE is steady.
LIMIT, TOLERANCE = 0.999, 1e-11
STEPS, STEP = 60, 1e-5


def _lagmat(x: np.ndarray, p: int) -> np.ndarray:
    return np.column_stack([x[p - i - 1: len(x) - i - 1] for i in range(p)]) if p else np.empty((len(x) - p, 0))


def hannan_rissanen(z: np.ndarray, p: int, q: int, long_order: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Long autoregression for the innovations, then least squares on p lags and q innovations.

    The order of the long autoregression is ``long_order``, by default the published rule
    floor(12 (n / 100) ** 0.25) (Schwert 1989), at least p + q + 1.
    """
    n = len(z)
    m = long_order or max(p + q + 1, int(12 * (n / 100) ** 0.25))
    if n <= m + max(p, q) + 5:
        raise ValueError("series too short for ARIMA")
    Xl = _lagmat(z, m)
    a, *_ = np.linalg.lstsq(Xl, z[m:], rcond=None)
    e = np.zeros(n)
    e[m:] = z[m:] - Xl @ a
    start = m + max(p, q)
    cols = [z[start - i - 1: n - i - 1] for i in range(p)] + [e[start - j - 1: n - j - 1] for j in range(q)]
    beta, *_ = np.linalg.lstsq(np.column_stack(cols), z[start:], rcond=None)
    return beta[:p], beta[p:]


def from_partial(partial: np.ndarray) -> np.ndarray:
    """Autoregression coefficients with these partial autocorrelations (Durbin-Levinson recursion)."""
    coef = np.zeros(0)
    for r in partial:
        coef = np.append(coef - r * coef[::-1], r)
    return coef


def to_partial(coef: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of an autoregression, drawn inside the limit where it is not stationary."""
    coef, out = np.asarray(coef, dtype=float), []
    while len(coef):
        r = float(np.clip(coef[-1], -0.95, 0.95))
        out.append(r)
        coef = (coef[:-1] + r * coef[:-1][::-1]) / (1 - r * r)
    return np.array(out[::-1])


def _system(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = max(len(phi), len(theta) + 1)
    T = np.eye(r, k=1)
    T[: len(phi), 0] = phi
    R = np.zeros(r)
    R[0], R[1: 1 + len(theta)] = 1.0, theta
    return T, R


def innovations(z: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors of the Kalman filter and their variances, in units of the noise variance.

    Once the state variance is steady the errors follow the ARMA recursion, at a few operations a day.
    """
    T, R = _system(phi, theta)
    r, Q = len(R), np.outer(R, R)
    P = np.linalg.solve(np.eye(r * r) - np.kron(T, T), Q.ravel()).reshape(r, r)
    a, n = np.zeros(r), len(z)
    v, f = np.zeros(n), np.ones(n)
    t = 0
    while t < n:
        v[t], f[t] = z[t] - a[0], P[0, 0]
        K = T @ P[:, 0] / f[t]
        a = T @ a + K * v[t]
        new = T @ P @ T.T + Q - np.outer(K, K) * f[t]
        steady = np.abs(new - P).max() < TOLERANCE and t >= max(len(phi), len(theta))
        P, t = new, t + 1
        if steady:
            break
    if t < n:
        w = z[t:].astype(float)
        for i, c in enumerate(phi):
            w = w - c * z[t - i - 1: n - i - 1]
        last = list(v[max(0, t - len(theta)): t][::-1])
        out, coef = [], theta.tolist()
        if len(coef) == 2:  # the usual order, written out
            (t1, t2), (e1, e2) = coef, last
            for x in w.tolist():
                e1, e2 = x - t1 * e1 - t2 * e2, e1
                out.append(e1)
        else:
            for x in w.tolist():
                x -= sum(c * e for c, e in zip(coef, last))
                last = [x, *last[:-1]] if last else last
                out.append(x)
        v[t:], f[t:] = out, f[t - 1]
    return v, f


def log_likelihood(z: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[float, float]:
    """Exact Gaussian log-likelihood with the noise variance at its best, and that variance."""
    v, f = innovations(z, phi, theta)
    s2 = float(np.mean(v * v / f))
    if not np.isfinite(s2) or s2 <= 0 or (f <= 0).any():
        return -np.inf, np.nan
    return float(-0.5 * (len(z) * (np.log(2 * np.pi * s2) + 1) + np.log(f).sum())), s2


@dataclass
class Arma:
    phi: np.ndarray
    theta: np.ndarray
    s2: float
    likelihood: float

    def ahead(self, z: np.ndarray, steps: int) -> np.ndarray:
        """Expected values of the next ``steps`` days."""
        v, _ = innovations(z, self.phi, self.theta)
        zs, es = list(z[-max(1, len(self.phi)):]), list(v[-max(1, len(self.theta)):])
        out = []
        for _ in range(steps):
            x = sum(c * zs[-i - 1] for i, c in enumerate(self.phi)) + sum(c * es[-j - 1] for j, c in enumerate(self.theta))
            zs.append(x)
            es.append(0.0)
            out.append(x)
        return np.array(out)

    def spread(self, steps: int) -> np.ndarray:
        """Standard errors of the sums of the next 1 .. ``steps`` days."""
        psi = np.zeros(steps)
        psi[0] = 1.0
        for j in range(1, steps):
            psi[j] = (self.theta[j - 1] if j <= len(self.theta) else 0.0) + sum(
                c * psi[j - i - 1] for i, c in enumerate(self.phi) if j > i
            )
        return np.sqrt(self.s2 * np.cumsum(np.cumsum(psi) ** 2))


def arma_fit(z: np.ndarray, p: int, q: int) -> Arma:
    """The ARMA(p, q) around 0 of greatest likelihood, from the Hannan-Rissanen estimate on."""
    z = np.asarray(z, dtype=float)
    scale = float(np.sqrt(np.mean(z * z)))
    if not scale:
        raise ValueError("series does not change")
    phi, theta = hannan_rissanen(z / scale, p, q)
    x = z / scale

    def coefficients(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        partial = LIMIT * np.tanh(u)
        return from_partial(partial[:p]), -from_partial(partial[p:])

    def cost(u: np.ndarray) -> float:
        return -log_likelihood(x, *coefficients(u))[0]

    def slope(u: np.ndarray) -> np.ndarray:
        steps = np.eye(len(u)) * STEP
        return np.array([(cost(u + d) - cost(u - d)) / (2 * STEP) for d in steps])

    # the MA part is invertible where the autoregression with negative coefficients is stationary
    u = np.arctanh(np.concatenate([to_partial(phi), to_partial(-theta)]) / LIMIT)
    now, g, H = cost(u), slope(u), np.eye(p + q) / len(z)
    for _ in range(STEPS):
        d = -H @ g
        if g @ d >= 0:
            H = np.eye(p + q) / len(z)
            d = -H @ g
        d *= min(1.0, 2.0 / max(np.abs(d).max(), 1e-300))  # no leap to the limit
        t = 1.0
        while t > 1e-10 and not cost(u + t * d) <= now + 1e-4 * t * (g @ d):
            t /= 2
        if t <= 1e-10:
            break
        s = t * d
        new, g2 = cost(u + s), slope(u + s)
        change, y = now - new, g2 - g
        u, now, g = u + s, new, g2
        if s @ y > 1e-12:
            rho = 1.0 / (s @ y)
            A = np.eye(p + q) - rho * np.outer(s, y)
            H = A @ H @ A.T + rho * np.outer(s, s)
        if change < 1e-9 * (1 + abs(now)) and np.abs(g).max() < 1e-3 * len(z) ** 0.5:
            break
    phi, theta = coefficients(u)
    likelihood, s2 = log_likelihood(x, phi, theta)
    if not np.isfinite(likelihood):
        raise ValueError("no likelihood at the fitted coefficients")
    return Arma(phi, theta, s2 * scale**2, likelihood - len(z) * float(np.log(scale)))


def arima_fit(y: np.ndarray) -> Arma:
    """The differenced series as ARMA(2, 2), as ARMA(1, 1) when that cannot be fitted."""
    z = np.diff(y)
    try:
        return arma_fit(z, ARIMA_ORDER[0], ARIMA_ORDER[2])
    except (ValueError, np.linalg.LinAlgError):
        return arma_fit(z, ARIMA_FALLBACK[0], ARIMA_FALLBACK[2])


def _arima_series(horizon: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, ds = pdf["y"].to_numpy(dtype=float), pd.to_datetime(pdf["ds"])
        k = split_point(len(y))
        train, test = y[:k], y[k:]
        model = arima_fit(train)
        steps = len(test) + horizon
        level, se = train[-1] + np.cumsum(model.ahead(np.diff(train), steps)), model.spread(steps)
        hist = points_frame([d.date() for d in ds[k:]], np.maximum(0, level[: len(test)]), actual=test, raw=level[: len(test)])
        f_level, f_se = level[len(test):], se[len(test):]
        fut_dates = [(ds.iloc[k - 1] + pd.Timedelta(days=len(test) + i + 1)).date() for i in range(horizon)]
        fut = points_frame(fut_dates, np.maximum(0, f_level), lower=np.maximum(0, f_level - Z95 * f_se),
                           upper=f_level + Z95 * f_se, future=True)
        names = [f"ar_{i + 1}" for i in range(len(model.phi))] + [f"ma_{j + 1}" for j in range(len(model.theta))]
        weights = coefficient_frame([*names, "variance"], [*model.phi, *model.theta, model.s2], 0.0)
        return pd.concat([hist, fut, weights], ignore_index=True)

    return fit


def arima_forecast(ts: DataFrame, series_cols: Sequence[str] = (), horizon: int = 30) -> ForecastResult:
    """ARIMA(2,1,2) on the first 80 %, (1,1,1) when that cannot be fitted; 95 % intervals.

    ``coefficients`` has ar_1, ar_2, ma_1, ma_2 and the noise variance of every series.
    """
    return run_per_series(ts, series_cols, "arima", _arima_series(horizon))


__all__ = ["arima_forecast", "arima_fit", "arma_fit", "log_likelihood", "hannan_rissanen"]
