"""Leakage-safe features. All windows share one partitioning and order, so one exchange and one sort serve them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import div

MIN_LAG = 28  # a horizon: what is older is known when a forecast is made
LAGS, WINDOWS = (28, 35, 42, 56), (7, 28, 56)
EVENT_WINDOW = 14


def add_features(frame: DataFrame, lags=LAGS, windows=WINDOWS, min_lag: int = MIN_LAG) -> DataFrame:
    """Lags, rolling statistics of values at least min_lag old, calendar parts, and price features where there are prices."""
    if any(lag < min_lag for lag in lags):
        raise ValueError(f"all lags must be at least {min_lag}")
    s = W.partitionBy("series_id").orderBy("date")
    cols = [F.lag("sales", n).over(s).alias(f"lag_{n}") for n in lags]
    for w in windows:
        rows = s.rowsBetween(-min_lag - w + 1, -min_lag)
        cols.append(F.when(F.count("sales").over(rows) == w, F.avg("sales").over(rows)).alias(f"rolling_mean_{w}"))
    month = s.rowsBetween(-min_lag - 27, -min_lag)
    cols.append(F.when(F.count("sales").over(month) == 28, F.stddev_samp("sales").over(month)).alias("rolling_std_28"))
    cols += [F.weekday("date").alias("dayofweek"), F.dayofmonth("date").alias("day"), F.month("date").alias("month"), F.weekofyear("date").alias("weekofyear"), F.weekday("date").isin(5, 6).cast("int").alias("weekend")]
    if "price" in frame.columns:
        cols += [div(F.col("price"), F.median("price").over(W.partitionBy("series_id"))).alias("price_ratio"), (div(F.col("price"), F.lag("price", 7).over(s)) - 1).alias("price_change_7")]
    return frame.select("*", *cols)


def event_distance(calendar: DataFrame, window: int = EVENT_WINDOW) -> DataFrame:
    """days_to_next (0 on the day) and days_since (strictly before), capped at window + 1: an as-of join both ways as two frames over the calendar."""
    s, event = W.orderBy("date"), F.when(F.col("event_name").isNotNull(), F.col("date"))
    nxt = F.first(event, ignorenulls=True).over(s.rowsBetween(0, W.unboundedFollowing))
    last = F.last(event, ignorenulls=True).over(s.rowsBetween(W.unboundedPreceding, -1))
    cap = lambda d: F.least(F.coalesce(d, F.lit(window + 1)), F.lit(window + 1))
    return calendar.select("*", cap(F.datediff(nxt, "date")).alias("days_to_next"), cap(F.datediff("date", last)).alias("days_since"))


def training_rows(features: DataFrame, flagged: DataFrame) -> DataFrame:
    """Rows to learn from: on the shelf, with a full history, open, and not a probable stock-out (anti-join on flagged)."""
    ok = F.col("price").isNotNull() & F.col("rolling_mean_56").isNotNull() & ~F.coalesce(F.col("event_name") == "Christmas", F.lit(False))
    return features.where(ok).join(flagged.select("series_id", "date"), ["series_id", "date"], "left_anti")
