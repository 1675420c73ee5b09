"""The Spark session that runs and tests share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "stocktide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and skew handling; a cluster's own settings stay as they are."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
