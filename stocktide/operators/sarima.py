"""Seasonal ARIMA of many nodes at once: (1,1,1)(0,1,1) with a season, (1,1,1) without.

A node's likelihood is the exact Gaussian one of its differenced series, by a Kalman filter that starts from the stationary distribution,
which is the diffuse likelihood of the series itself. All nodes of a batch go through the filter together. Its derivatives come from its
own recursions, run with parameters an imaginary step away (exact to rounding), and the parameters from Fisher scoring on them.
Forecasts have the variance of the model's moving-average form.

A node's series is a bounded number of days or weeks (`last`); batches are rows of arrays, dealt by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 1e-20
ROUNDS = 12


def _differenced(x: np.ndarray, season: int) -> np.ndarray:
    d = np.diff(x, axis=1)
    return d[:, season:] - d[:, :-season] if season else d


def _moving(p: np.ndarray, season: int) -> np.ndarray:
    """Coefficients of the moving average, from lag 0, of parameters (phi, theta, seasonal theta)."""
    out = np.zeros((len(p), season + 2), p.dtype)
    out[:, 0], out[:, 1] = 1, p[:, 1]
    if season:
        out[:, season] += p[:, 2]
        out[:, season + 1] += p[:, 1] * p[:, 2]
    return out


def _moved(m: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """The transition applied to the next-to-last axis of m (states)."""
    out = np.zeros_like(m)
    out[:, :-1] = m[:, 1:]
    out[:, 0] += phi[:, None] * m[:, 0]
    return out


def innovations(w: np.ndarray, p: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one-step errors, their variances over sigma squared, the state after the last) of each row of w under its parameters p."""
    rows, n = w.shape
    phi, ma = p[:, 0], _moving(p, season)
    noise = ma[:, :, None] * ma[:, None, :]
    transit = lambda m: np.swapaxes(_moved(np.swapaxes(_moved(m, phi), 1, 2), phi), 1, 2)
    size = ma.shape[1]
    t = np.zeros((rows, size, size), p.dtype)
    t[:, np.arange(size - 1), np.arange(1, size)] = 1
    t[:, 0, 0] = phi
    cov = noise
    for _ in range(14):  # doubling: terms of the stationary covariance up to 2 ** 14 steps back
        cov = cov + t @ cov @ np.swapaxes(t, 1, 2)
        t = t @ t
    a, v, f = np.zeros((rows, size), p.dtype), np.empty((rows, n), p.dtype), np.empty((rows, n), p.dtype)
    steady, gain = False, None
    for k in range(n):
        v[:, k] = w[:, k] - a[:, 0]
        if not steady:
            scale = cov[:, 0, 0]
            gain = cov[:, :, 0] / scale[:, None]
        f[:, k] = scale
        a = a + gain * v[:, k, None]
        a = np.concatenate([a[:, 1:], np.zeros((rows, 1), p.dtype)], axis=1) + np.concatenate([(phi * a[:, 0])[:, None], np.zeros((rows, size - 1), p.dtype)], axis=1)
        if not steady:
            after = transit(cov - gain[:, :, None] * cov[:, None, 0, :]) + noise
            gap = after - cov
            steady = np.abs(gap.real).max() < 1e-12 and np.abs(gap.imag).max() < 1e-10 * STEP
            cov = after
    return v, f, a


def log_likelihood(v: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Gaussian, at the best sigma squared, of each row."""
    n = v.shape[1]
    sigma2 = np.maximum((v**2 / f).mean(axis=1), 1e-300)
    return -0.5 * (n * np.log(2 * np.pi * sigma2) + n + np.log(f).sum(axis=1))


def fit(w: np.ndarray, season: int) -> np.ndarray:
    """(phi, theta, seasonal theta) of each row of differences, inside the stationary box."""
    free = 3 if season else 2
    u = np.zeros((len(w), 3))
    inside = lambda u: 0.98 * np.tanh(u)
    best = log_likelihood(*innovations(w, inside(u), season)[:2])
    damp = np.full(len(w), 0.01)
    for _ in range(ROUNDS):
        wide = np.repeat(inside(u), free, axis=0).astype(complex)
        wide[np.arange(len(wide)), np.tile(np.arange(free), len(w))] += 1j * STEP
        v, f, _ = innovations(np.repeat(w, free, axis=0).astype(complex), wide, season)
        dv, df = (x.imag.reshape(len(w), free, -1) / STEP for x in (v, f))
        v, f = (x.real.reshape(len(w), free, -1)[:, 0] for x in (v, f))
        chain = (0.98 - inside(u)[:, :free] ** 2 / 0.98)[:, :, None]
        dv, df = dv * chain, df * chain
        sigma2 = np.maximum((v**2 / f).mean(axis=1), 1e-300)[:, None]
        score = -(dv * (v / (f * sigma2))[:, None] + 0.5 * (df / f[:, None]) * (1 - v**2 / (f * sigma2))[:, None]).sum(axis=2)
        info = np.einsum("akt,alt->akl", dv / np.sqrt(f * sigma2)[:, None], dv / np.sqrt(f * sigma2)[:, None]) + 0.5 * np.einsum("akt,alt->akl", df / f[:, None], df / f[:, None])
        diag = np.einsum("akk->ak", info)
        info = info + np.eye(free) * (damp[:, None] * diag + 1e-9)[:, :, None]
        move = np.clip(np.linalg.solve(info, score[:, :, None])[:, :, 0], -1.0, 1.0)
        tried = u.copy()
        tried[:, :free] = np.clip(u[:, :free] + move, -4, 4)
        value = log_likelihood(*innovations(w, inside(tried), season)[:2])
        better = value > best
        u[better], best[better] = tried[better], value[better]
        damp = np.where(better, damp / 3, damp * 10)
    return inside(u)


def forecast(x: np.ndarray, horizon: int, season: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(forecasts, at least zero, and their variances) of each row of x, all of one length. Rows that leave fewer than twenty (or two
    seasons of) differences are repeated from their last season, with variance 0."""
    x = np.asarray(x, float)
    n = x.shape[1] - 1 - season
    if n < max(20, 2 * season):
        last = x[:, -season:] if season and x.shape[1] >= season else x[:, -1:]
        return np.maximum(last[:, np.arange(horizon) % last.shape[1]], 0), np.zeros((len(x), horizon))
    size = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1.0)
    w = _differenced(x / size, season)
    p = fit(w, season)
    v, f, a = innovations(w, p, season)
    sigma2 = (v**2 / f).mean(axis=1) * size[:, 0] ** 2
    full = x.copy()
    for _ in range(horizon):
        step = a[:, 0] * size[:, 0] + full[:, -1] + (full[:, -season] - full[:, -season - 1] if season else 0.0)
        full = np.concatenate([full, step[:, None]], axis=1)
        a = _moved(a[:, :, None], p[:, 0])[:, :, 0]
    difference = np.zeros(season + 2)
    difference[[0, 1]] = 1, -1
    if season:
        difference[[season, season + 1]] += -1, 1
    ar = np.stack([np.convolve(difference, [1, -phi]) for phi in p[:, 0]])
    ma, psi = _moving(p, season), np.zeros((len(x), horizon))
    for h in range(horizon):
        psi[:, h] = (ma[:, h] if h < ma.shape[1] else 0.0) - sum(ar[:, i] * psi[:, h - i] for i in range(1, min(h, ar.shape[1] - 1) + 1))
    return np.maximum(full[:, -horizon:], 0), sigma2[:, None] * np.cumsum(psi**2, axis=1)


def nodes(days: DataFrame, by: list[str], horizon: int = 28, season: int = 7, batch: int = 64) -> DataFrame:
    """days: by, date, sales (each node's last days or weeks, a bounded number). Returns by, step, forecast, variance."""
    series = days.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("date", F.col("sales").cast("double").alias("sales")))), lambda x: x["sales"]).alias("_x"))
    schema = days.select(*by).schema.add("step", "integer").add("forecast", "double").add("variance", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(b.column("_x").offsets.to_numpy())
            for n in np.unique(lengths):
                found = np.flatnonzero(lengths == n)
                for i in (found[k : k + batch] for k in range(0, len(found), batch)):
                    x = np.array(b.column("_x").take(pa.array(i)).to_pylist(), float)
                    f, var = forecast(x, horizon, season)
                    again = pa.array(np.repeat(i, horizon))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(again) for c in by), pa.array(np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(i))), pa.array(f.ravel()), pa.array(var.ravel())], [*by, "step", "forecast", "variance"])

    return series.mapInArrow(run, schema)
