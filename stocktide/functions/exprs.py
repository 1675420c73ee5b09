"""Expressions that several operators share. NULL stands for unknown; nothing yields NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(col: Column | str, places: int = 4) -> Column:
    """A double rounded for output."""
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double"), places)


def div(a: Column, b: Column) -> Column:
    """NULL where the divisor is zero."""
    return F.try_divide(a, b)


def lookup(values: dict, key: Column, default) -> Column:
    """values[key], or the default."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def wmape(actual, forecast, empty: float | None = 0.0) -> Column:
    """Sum of absolute errors over the sum of absolute actuals; `empty` where that is zero."""
    out = div(F.sum(F.abs(F.col(actual) - F.col(forecast))), F.sum(F.abs(F.col(actual))))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def bias(actual, forecast, empty: float | None = 0.0) -> Column:
    out = div(F.sum(F.col(forecast) - F.col(actual)), F.sum(F.abs(F.col(actual))))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def mape(actual, forecast) -> Column:
    """Over non-zero actuals; 0 if there are none."""
    a, f = F.col(actual), F.col(forecast)
    return F.coalesce(F.avg(F.when(a != 0, F.abs((a - f) / a))), F.lit(0.0))


def pinball(actual, forecast, q: float = 0.5) -> Column:
    e = F.col(actual) - F.col(forecast)
    return F.avg(F.greatest(q * e, (q - 1) * e))


def velocity(mean_daily: Column) -> Column:
    return F.when(mean_daily >= 2.0, "fast").when(mean_daily >= 0.5, "medium").when(mean_daily >= 0.1, "slow").otherwise("sporadic")


def round_to_case(quantity: Column, pack: int = 1) -> Column:
    """Whole case packs, upwards."""
    return F.ceil(F.greatest(quantity, F.lit(0.0)) / pack - 1e-9) * float(pack)


def uniform(*keys) -> Column:
    """A draw in [0, 1) that depends on the keys alone, the same in every engine with MD5."""
    h = F.md5(F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
