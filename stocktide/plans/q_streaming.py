"""Streaming forms as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import retail
from ..streaming import limits
from .registry import query


@query("SELECT user_id, CAST(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS TIMESTAMP) AS start, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1)) t(k) GROUP BY ALL")
def stream_sliding_counts(spark, sf):
    """Sliding windows over the events as a stream."""
    schema = retail.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    out = limits.drain(limits.sliding_counts(stream), ["user_id", "start"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, event_id, n::BIGINT AS n, n > 2 AS limited FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events WHERE ts IS NOT NULL) WHERE epoch_us(ts) <= 1000 * (SELECT epoch_ms(max(ts)) - 7200000 FROM events)")
def stream_rate_limited(spark, sf):
    """The rate limit as stateful processing over the events as a stream: all requests that the watermark, two hours behind the last one, has passed."""
    limits.state_in_rocksdb(spark)
    schema = retail.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    return limits.drain(limits.rate_limited(stream))
