"""Files for dashboards and web pages: an extract of the gold tables, and forecasts as JSON by level."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.store import columnar_json, json_records, read_gold

REQUIRED = ("forecasts", "model_metrics", "prediction_intervals", "safety_stock", "allocation", "allocation_backtest", "drift")
OPTIONAL = ("interval_coverage", "interval_coverage_segment", "reconciliation_metrics", "probable_stockouts", "decision_accuracy", "weekday_bias", "event_accuracy", "override_fva", "bias_exceptions", "planning_cycle", "allocation_node_fill")


def extract(spark: SparkSession, gold: str, target: str) -> dict[str, int]:
    """Copies the tables a dashboard reads, doubles rounded to four places, as Parquet and CSV; returns their rows. A missing required one is an error."""
    rows = {}
    for name in REQUIRED + OPTIONAL:
        df = read_gold(spark, gold, name, required=name in REQUIRED)
        if df is None:
            continue
        df = df.select(*(F.round(c, 4).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
        df.write.mode("overwrite").parquet(f"{target}/{name}.parquet")
        df.write.mode("overwrite").option("header", True).csv(f"{target}/{name}.csv")
        rows[name] = spark.read.parquet(f"{target}/{name}.parquet").count()
    return rows


def build(spark: SparkSession, gold: str, folder: str) -> dict[str, int]:
    """A JSON file set: the served forecasts by level, every other gold table as records, and a manifest of rows."""
    served = read_gold(spark, gold, "forecasts").where("served")
    by_level = served.select("level", F.struct("series_id", "date", "forecast").alias("x")).select("level", "x.*")
    rows = {}
    for level in ("total", "state", "category", "series"):
        columnar_json(by_level.where(F.col("level") == level), "series_id", "date", ["forecast"]).write.mode("overwrite").text(f"{folder}/forecasts/{level}")
        rows[f"forecasts/{level}"] = by_level.where(F.col("level") == level).select("series_id").distinct().count()
    for name in REQUIRED[1:] + OPTIONAL:
        df = read_gold(spark, gold, name, required=False)
        if df is not None:
            json_records(df).write.mode("overwrite").text(f"{folder}/{name}")
            rows[name] = df.count()
    manifest = spark.createDataFrame(list(rows.items()), "file string, rows long")
    json_records(manifest).coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return rows
