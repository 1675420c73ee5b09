"""From the warehouse tables to the gold tables: python -m stocktide gold SF_DIR FOLDER [TABLE...]."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

from ..sources.store import log_run, write_gold
from .catalogue import QUERIES

#: Gold table -> the registered query that makes it.
GOLD = {
    "forecasts": "served_forecasts", "backtest_forecasts": "forecast_alignment", "prediction_intervals": "mondrian_interval", "safety_stock": "item_safety_stock", "allocation": "allocate_lp",
    "allocation_backtest": "allocation_backtest_lp", "allocation_backtest_pro_rata": "allocation_backtest_pro_rata", "allocation_node_fill": "allocation_node_fill", "model_metrics": "level_metrics", "reconciliation_metrics": "reconcile_all",
    "interval_coverage": "interval_coverage", "interval_coverage_segment": "interval_coverage_segment", "probable_stockouts": "censoring_summary", "drift": "drift_table", "decision_accuracy": "decision_accuracy",
    "weekday_bias": "weekday_bias", "event_accuracy": "event_accuracy", "override_fva": "forecast_value_added", "bias_exceptions": "bias_exceptions", "planning_cycle": "planning_cycle",
}


def summary(spark: SparkSession, sf_dir: str) -> dict:
    """What was selected and how good it is, as nested values."""
    rows = lambda name: [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]  # noqa: E731  a few rows each
    return {
        "selected_model": rows("model_select")[0], "served_method": rows("serve_select")[0]["method"], "wmape_by_level": rows("summary_pivot"), "reconciliation": rows("reconcile_all"), "coverage": rows("interval_coverage"),
        "paired": rows("paired_ci")[0], "drift": rows("drift_table"), "retrain": rows("retrain_flag")[0],
    }


def build(spark: SparkSession, sf_dir: str, folder: str, names: list[str] | None = None) -> dict:
    """Writes the tables (all, or the named ones), a run log and returns the summary: seconds by table."""
    took = {}
    for name in names or GOLD:
        t = time.time()
        write_gold({name: QUERIES[GOLD[name]](spark, sf_dir)}, folder)
        took[name] = round(time.time() - t, 2)
    if not names:
        text = json.dumps(summary(spark, sf_dir), default=str)
        spark.createDataFrame([(text,)], "json string").coalesce(1).write.mode("overwrite").text(f"{folder}/run_summary.json")
    log_run(took, spark, f"{folder}/run_log", f"run-{int(time.time())}")
    return {"source": sf_dir, "seconds": took}
