"""The serving surface: functions that answer what the endpoints of a planning API answer, over gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import exists, read_gold

METRIC_TABLES = ("model_metrics", "reconciliation_metrics", "interval_coverage", "allocation_backtest", "drift")
TABLES = ("planning_cycle", "decision_accuracy", "weekday_bias", "event_accuracy", "override_fva", "bias_exceptions", "probable_stockouts", "interval_coverage_segment", "allocation_node_fill")
MAX_PAGE = 50_000


def page(df: DataFrame, equal: dict, order: list[str], limit: int = 1000, offset: int = 0) -> tuple[DataFrame, int]:
    """(the page, the number of matching rows). Raises ValueError for an unknown column or a bad limit."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_PAGE} and offset 0 or more")
    for c, v in equal.items():
        if c not in df.columns:
            raise ValueError(f"unknown column {c!r}")
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.orderBy(*order).offset(offset).limit(limit), df.count()


class Service:
    """Answers over a folder of gold tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def health(self) -> dict:
        return {"status": "ok", "tables": [t for t in ("forecasts", "prediction_intervals", "allocation", *METRIC_TABLES, *TABLES) if exists(self.spark, f"{self.folder}/{t}.parquet")]}

    def _page(self, table: str, equal: dict, limit: int, offset: int) -> tuple[DataFrame, int]:
        df = read_gold(self.spark, self.folder, table)
        return page(df, equal, df.columns, limit, offset)

    def get_forecast(self, series: str | None = None, level: str | None = None, method: str | None = None, limit: int = 1000, offset: int = 0):
        """Without a method, the served one alone."""
        equal = {"series_id": series, "level": level, **({"method": method} if method else {"served": True})}
        return self._page("forecasts", equal, limit, offset)

    def get_interval(self, series: str | None = None, limit: int = 1000, offset: int = 0):
        return self._page("prediction_intervals", {"series_id": series}, limit, offset)

    def get_allocation(self, limit: int = 1000, offset: int = 0):
        return self._page("allocation", {}, limit, offset)

    def get_metrics(self, table: str = "model_metrics", limit: int = 1000, offset: int = 0):
        if table not in METRIC_TABLES:
            raise ValueError(f"table must be one of {METRIC_TABLES}")
        return self._page(table, {}, limit, offset)

    def get_table(self, name: str, limit: int = 1000, offset: int = 0):
        if name not in TABLES:
            raise ValueError(f"table must be one of {TABLES}")
        return self._page(name, {}, limit, offset)
