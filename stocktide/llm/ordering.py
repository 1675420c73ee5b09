"""Places of rows in a total order, without a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written


def positions(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with `position`, from 0, of each row among those of its group `by` (columns without nulls) in the given order, and `total`, the group's rows.

    Rows are dealt by ranges of (by, order) and sorted within a task; how many rows of a group earlier tasks hold is a running sum over
    one row for each task and group. Rows equal in all of these are told apart by where they lie in df, which should be a written table,
    so that no number of equal rows is one task's.
    """
    salted = df.withColumn("_place", F.monotonically_increasing_id())
    keys = [*map(F.col, by), *order, F.col("_place")]
    dealt = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place")
    placed = written(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_line")), "ordered")
    runs = placed.groupBy("_part", *by).agg(F.min("_line").alias("_first"), F.count("*").alias("_rows"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # a row for each task that holds rows of the group
    earlier = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("_part", *by, (earlier - F.col("_first")).alias("_start"), F.sum("_rows").over(group).alias("total"))
    return placed.join(starts, ["_part", *by]).withColumn("position", F.col("_line") + F.col("_start")).drop("_part", "_line", "_start")
