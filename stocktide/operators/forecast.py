"""Forecast floors, rolling origins, and selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def origins(bounds: DataFrame, back: dict[str, int]) -> DataFrame:
    """fold, origin: one row a fold."""
    names = F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(v).alias("back")) for k, v in back.items()))
    return bounds.select("hi", F.explode(names).alias("x")).select("x.fold", F.date_sub("hi", F.col("x.back")).alias("origin"))


def floors(panel: DataFrame, folds: DataFrame, horizon: int = 28) -> DataFrame:
    """naive (the last value) and seasonal_naive (the last seven days, cycled) of every series and fold.

    Columns: fold, series_id, the panel's keys, step, date, method, forecast. A series with under seven days of history has the naive
    forecast for both.
    """
    keys = [c for c in panel.columns if c not in ("date", "day_idx", "sales", "revenue", "price")]
    near = panel.join(F.broadcast(folds), (F.col("date") <= F.col("origin")) & (F.col("date") > F.date_sub("origin", 7)))  # one row a fold
    week = near.groupBy("fold", "origin", *keys).agg(F.sort_array(F.collect_list(F.struct("date", "sales"))).alias("w"))  # seven values
    steps = week.select("fold", "origin", *keys, "w", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    last = F.element_at("w", -1)["sales"]
    season = F.when(F.size("w") == 7, F.element_at("w", ((F.col("step") - 1) % 7 + 1).cast("int"))["sales"]).otherwise(last)
    both = F.explode(F.array(F.struct(F.lit("naive").alias("method"), last.alias("forecast")), F.struct(F.lit("seasonal_naive").alias("method"), season.alias("forecast"))))
    return steps.select("fold", *keys, "step", F.date_add("origin", F.col("step")).alias("date"), both.alias("x")).select("fold", *keys, "step", "date", "x.method", "x.forecast")


def with_actuals(forecasts: DataFrame, panel: DataFrame) -> DataFrame:
    """Forecasts whose day is in the panel, with its sales as `actual`."""
    return forecasts.join(panel.select("series_id", "date", F.col("sales").alias("actual")), ["series_id", "date"])


def rolling_origin(panel: DataFrame, folds: DataFrame, forecast_fn: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Evaluates a caller's forecasts: forecast_fn(history rows with fold and origin, fold table) -> fold, series_id, date, forecast.

    Only rows up to each fold's origin reach it. Raises if a test row has no forecast or more than one.
    """
    seen = panel.join(F.broadcast(folds), F.col("date") <= F.col("origin"))
    test = panel.join(F.broadcast(folds), (F.col("date") > F.col("origin")) & (F.col("date") <= F.date_add("origin", 28))).select("fold", "series_id", "date", F.col("sales").alias("actual"))
    out = test.join(forecast_fn(seen, folds), ["fold", "series_id", "date"], "left")
    missing, n, tests = out.agg(F.count_if(F.col("forecast").isNull()), F.count("*")).crossJoin(test.agg(F.count("*"))).first()
    if missing or n != tests:
        raise ValueError(f"forecasts are not one to one with the {tests} test rows: {missing} missing, {n} joined")
    return out


def best_by(scores: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """The name with the least value for each `by` (ties by name)."""
    w = W.partitionBy(*by).orderBy(value, name)
    return scores.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
