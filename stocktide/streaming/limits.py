"""Windowed and stateful operators over streams: an extension, with the same meaning as their batch forms."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.store import exists, shared_folder


def sliding_counts(events: DataFrame, window: str = "60 minutes", slide: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Requests of each user in sliding windows; rows later than the watermark are left out."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window, slide), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "n")


def daily_sales(lines: DataFrame, late: str = "7 days") -> DataFrame:
    """Units by day and item of a stream of sales lines."""
    s = lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return s.groupBy(F.window("ts", "1 day"), "item_id").agg(F.sum("sales").alias("sales")).select(F.to_date("window.start").alias("date"), "item_id", "sales")


class SlidingLimit(StatefulProcessor):
    """Counts each request with its client's requests of the span before it, whatever order they come in.

    A client's state is its requests that wait for the watermark and the times decided within the last span. One timer a client stands at its
    earliest waiting request; no request at or before the watermark can still come, so when it fires, all up to the watermark are decided
    in order. With none waiting, the timer stands where the last decided time leaves the span, and clears the state.
    """

    def __init__(self, seconds: int, limit: int):
        self.span, self.limit = seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long")
        self.decided = handle.getListState("decided", "us long")

    def _wake(self, us: int) -> None:
        """Sets the client's timer to this time, if none stands before it."""
        at, standing = -(-us // 1000), list(self.handle.listTimers())
        if not standing or at < min(standing):
            for t in standing:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            ids = [None if pd.isna(i) else int(i) for i in part["event_id"]]
            self.waiting.appendList([(int(us), i) for us, i in zip(part["us"], ids, strict=True)])
            self._wake(int(part["us"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get())
        due, rest = [w for w in waiting if w[0] <= mark], [w for w in waiting if w[0] > mark]
        at = np.array([w[0] for w in due], dtype="int64")
        times = np.sort(np.append(np.array([d[0] for d in self.decided.get()], dtype="int64"), at))
        n = np.searchsorted(times, at, "right") - np.searchsorted(times, at - self.span, "left")
        kept = times[times > mark - self.span]
        for state, left in ((self.waiting, [tuple(w) for w in rest]), (self.decided, [(int(t),) for t in kept])):
            if left:
                state.put(left)
            else:
                state.clear()
        if rest or len(kept):
            self._wake(min(w[0] for w in rest) if rest else int(kept[-1]) + self.span)
        if due:
            ids = pd.array([w[1] for w in due], dtype="Int64")
            yield pd.DataFrame({"user_id": pd.Series([key[0]] * len(due), dtype=object), "event_id": ids, "n": n.astype("int64"), "limited": n > self.limit})

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, seconds: int = 3600, limit: int = 2, late: str = "2 hours") -> DataFrame:
    """user_id, event_id, the client's requests within `seconds` up to this one (those of the same instant too), whether they exceed the limit.

    A request is decided once the watermark has passed it, those that come later than the watermark are left out, and so are rows without a time; a
    null user is a client, repeated rows count each. The session must keep its state in RocksDB (see `state_in_rocksdb`).
    """
    e = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).where("ts is not null").withColumn("us", F.unix_micros("ts"))
    key = events.schema["user_id"].dataType.simpleString()
    return e.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(
        SlidingLimit(seconds, limit), f"user_id {key}, event_id long, n long, limited boolean", "append", "EventTime"
    )


def state_in_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, as stateful processing asks for; a setting of the session's own stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns its rows: in update mode the last of each key, without keys all, in append mode.

    Each micro-batch appends its changed rows to a table of the shared folder; nothing passes the driver.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def add(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")  # a repeated batch replaces itself

    stream.writeStream.foreachBatch(add).outputMode("update" if keys else "append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema, StructField("_batch", IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows") if exists(spark, f"{path}/rows") else spark.createDataFrame([], schema)
    if not keys:
        return rows.select(*stream.columns)
    last = F.max_by(F.struct(*stream.columns), "_batch").alias("x")
    return rows.groupBy(*keys).agg(last).select("x.*")
