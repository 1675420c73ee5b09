"""Order statistics and running sums of large groups, without a group in one task.

The range of a group's values is cut at approximate quantiles (a sketch that is merged, of fixed size). Rows are then dealt by group
and range; the sum of each range is one row, and what stands before a range is a running sum over those few rows. All results are
exact: only where the cuts lie is approximate. Running sums and codes are dealt by Spark's own range partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import materialised

RANGES = 64


def _with(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """Joined by group; without groups `other` is one row or a few."""
    return df.join(other, [*by]) if by else df.crossJoin(F.broadcast(other))


def ranges(df: DataFrame, by: Sequence[str], order: str, amount: str) -> tuple[DataFrame, DataFrame]:
    """df, a written table, with _range; and _range, start, stop of each group's ranges: sums of `amount` before and up to its end."""
    cuts = F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 1000)
    cut = _with(df, df.groupBy(*by).agg(cuts.alias("_cuts")), by).withColumn("_range", F.size(F.filter("_cuts", lambda e: e <= F.col(order)))).drop("_cuts")
    stop = F.sum("_sum").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, 0))  # RANGES rows a group
    sums = cut.groupBy(*by, "_range").agg(F.sum(amount).alias("_sum"))
    return cut, sums.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("_sum")).drop("_sum")


def running(df: DataFrame, by: Sequence[str], order: str, amount: str, ties: Sequence[str] = ()) -> DataFrame:
    """df with `before`: the sum of `amount` over the rows of the group that come earlier by `order`, then by `ties`.

    Rows are dealt by ranges of all of these, so neither a large group nor many equal values of `order` are one task's; what earlier
    tasks hold of a group is a running sum over one row for each task and group.
    """
    keys = [*by, order, *ties]
    dealt = materialised(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = dealt.groupBy("_part", *by).agg(F.sum(amount).alias("_sum"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # a row for each task that holds rows of the group
    starts = sums.select("_part", *by, F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    earlier = W.partitionBy("_part", *by).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    joined = dealt.join(starts, ["_part", *by])
    return joined.withColumn("before", F.col("_start") + F.coalesce(F.sum(amount).over(earlier), F.lit(0))).drop("_part", "_start")


def codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """column, code: 0, 1, 2, ... in the order of the distinct values of a column; NULL has none."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running(distinct, [], column, "_one").select(column, F.col("before").alias(code))


def coded(df: DataFrame, known: DataFrame, column: str, code: str = "code") -> DataFrame:
    """df with the code of each value, -1 for a value without one. known: from codes()."""
    return df.join(known, column, "left").withColumn(code, F.coalesce(code, F.lit(-1)))


def quantiles(values: DataFrame, by: Sequence[str], value: str, wanted: DataFrame, position: Callable[[Column, Column], Column]) -> DataFrame:
    """wanted: by, q. Returns by, q, value, n: the value at position(q, n), from 0 to n - 1, of each group's sorted values, between two by its fraction.

    NULLs are left out. Equal values are one row with a count before they are dealt.
    """
    counts = materialised(values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_count")), "counts")
    cut, sums = ranges(counts, by, "_value", "_count")
    n = counts.groupBy(*by).agg(F.sum("_count").alias("n"))
    at = _with(wanted.distinct(), n, by).withColumn("_at", position(F.col("q"), F.col("n")))
    low, part = F.floor("_at"), F.col("_at") - F.floor("_at")
    both = F.explode(F.array(F.struct(low.alias("rank"), (1 - part).alias("weight")), F.struct((low + 1).alias("rank"), part.alias("weight"))))
    ranks = at.select(*by, "q", "n", both.alias("_r")).select(*by, "q", "n", "_r.rank", "_r.weight").where("weight > 0")
    # a few rows a group on either side: which range holds the rank
    found = _with(ranks, sums, by).where("start <= rank and rank < stop")
    before = F.coalesce(F.sum("_count").over(W.partitionBy(*by, "_range").orderBy("_value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = cut.join(found.select(*by, "_range").distinct(), [*by, "_range"], "left_semi").withColumn("_before", before)
    hit = inside.join(found, [*by, "_range"]).where((F.col("start") + F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("start") + F.col("_before") + F.col("_count")))
    return hit.groupBy(*by, "q").agg(F.sum(F.col("_value") * F.col("weight")).alias("value"), F.first("n").alias("n"))


def plain_position(q: Column, n: Column) -> Column:
    """Linear interpolation between order statistics."""
    return q * (n - 1)
