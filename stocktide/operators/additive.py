"""Additive trend and seasonality for many nodes at once.

A node's model is linear: level, slope, a change of slope at each of CHANGES points over the first RANGE of its history, weekly and yearly waves and
a holiday effect. Its normal equations are sums over days, so they are added up before anything is shuffled: a task's rows give one matrix a
node, a node's matrices are one small sum, and each is solved with a ridge on the changes alone. Intervals are those of simulated futures whose slope
goes on changing as often and as much as it did, with the residuals' noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES, RANGE = 12, 0.8
WAVES = ((7.0, 3), (365.25, 4))
FUTURES = 400


def design(day: np.ndarray, holiday: np.ndarray, first: int, last: int) -> np.ndarray:
    """A row for each day (days since 1970); first and last: of the history."""
    t = (day - first) / max(last - first, 1)
    at = np.arange(1, CHANGES + 1) / (CHANGES + 1) * RANGE
    waves = [f(2 * np.pi * k * day / period) for period, top in WAVES for k in range(1, top + 1) for f in (np.sin, np.cos)]
    return np.column_stack([np.ones(len(day)), t, np.maximum(t[:, None] - at, 0), *waves, holiday])


def solve(gram: np.ndarray, cross: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients; a direction without data gets 0."""
    weight = np.full(len(gram), 1e-9)
    weight[2 : 2 + CHANGES] = ridge
    return np.linalg.solve(gram + np.diag(weight * max(gram[0, 0], 1.0)), cross)


def bounds(beta: np.ndarray, x: np.ndarray, steps: np.ndarray, noise: float, seed: int, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper of futures; steps: the days ahead over the history's length."""
    r, changes = np.random.Generator(np.random.PCG64(seed)), beta[2 : 2 + CHANGES]
    size, often = np.abs(changes).mean(), CHANGES / RANGE
    order = np.argsort(steps, kind="stable")
    gaps = np.diff(steps[order], prepend=0.0)
    jumps = (r.random((FUTURES, len(gaps))) < often * gaps) * r.laplace(0, max(size, 1e-12), (FUTURES, len(gaps)))
    drift = np.empty((FUTURES, len(gaps)))
    drift[:, order] = np.cumsum(np.cumsum(jumps, axis=1) * gaps, axis=1)
    paths = x @ beta + drift + r.normal(0, noise, drift.shape)
    return tuple(np.quantile(paths, q, axis=0) for q in ((1 - level) / 2, (1 + level) / 2))


_PART = "n long, yy double, gram binary, cross binary"


def forecasts(history: DataFrame, future: DataFrame, by: list[str], ridge: float = 0.01, level: float = 0.95) -> DataFrame:
    """history: by, date, sales, holiday (0 or 1); future: date, holiday, the same days for all nodes. Returns by, date, forecast, lower, upper,
    at least 0. A node's draws depend on its name alone, so a lost task gives them again.
    """
    day = F.unix_date("date").cast("long")
    first, last = history.agg(F.min(day), F.max(day)).first()
    width = len(design(np.zeros(1), np.zeros(1), 0, 1)[0])
    ahead = [(d, float(h)) for d, h in future.select(day, "holiday").orderBy("date").collect()]  # the days of a horizon

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = pa.Table.from_batches([b]).select(by).combine_chunks().to_pylist()
            rows: dict[tuple, list[int]] = {}
            for i, n in enumerate(names):
                rows.setdefault(tuple(n.values()), []).append(i)
            x = design(b.column("_day").to_numpy().astype(float), b.column("holiday").to_numpy(zero_copy_only=False), first, last)
            y = b.column("sales").to_numpy(zero_copy_only=False)
            out = [(*k, len(i), float(y[i] @ y[i]), (x[i].T @ x[i]).tobytes(), (x[i].T @ y[i]).tobytes()) for k, i in rows.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*by, "n", "yy", "gram", "cross"])

    types = [pa.string()] * len(by) + [pa.int64(), pa.float64(), pa.binary(), pa.binary()]
    names = [F.col(c).cast("string").alias(c) for c in by]
    parts = history.select(*names, day.alias("_day"), F.col("holiday").cast("double").alias("holiday"), F.col("sales").cast("double").alias("sales")).mapInArrow(sums, ", ".join(f"{c} string" for c in by) + ", " + _PART)

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        gram = sum(np.frombuffer(g).reshape(width, width) for g in table.column("gram").to_pylist())
        cross = sum(np.frombuffer(c) for c in table.column("cross").to_pylist())
        n, yy = sum(table.column("n").to_pylist()), sum(table.column("yy").to_pylist())
        beta = solve(gram, cross, ridge)
        noise = np.sqrt(max(yy - 2 * beta @ cross + beta @ gram @ beta, 0.0) / max(n - width, 1))
        days, holiday = (np.array(c, float) for c in zip(*ahead, strict=True))
        x = design(days, holiday, first, last)
        low, high = bounds(beta, x, (days - last) / max(last - first, 1), noise, zlib.crc32("|".join(str(k.as_py()) for k in key).encode()), level)
        at = lambda v: np.maximum(v, 0.0)
        return pa.table({**{c: pa.array([k.as_py()] * len(days), pa.string()) for c, k in zip(by, key, strict=True)}, "date": pa.array(days.astype(np.int32)).cast(pa.date32()), "forecast": at(x @ beta), "lower": at(low), "upper": at(high)})

    # one row a node and task that held rows of it
    return parts.groupBy(*by).applyInArrow(finish, ", ".join(f"{c} string" for c in by) + ", date date, forecast double, lower double, upper double")
