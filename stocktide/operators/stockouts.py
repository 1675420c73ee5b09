"""Probable stock-outs from zero runs (gaps and islands), and demand classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import div, lookup
from . import ordered

#: Service target of each value and variability class (fixed values).
SERVICE_TARGETS = {"AX": 0.98, "AY": 0.97, "AZ": 0.95, "BX": 0.96, "BY": 0.95, "BZ": 0.92, "CX": 0.93, "CY": 0.90, "CZ": 0.85}


def zero_runs(panel: DataFrame) -> DataFrame:
    """run_length: of the run of zero days that a zero day lies in, else 0; started: whether the series has sold by then."""
    s = W.partitionBy("series_id").orderBy("date")
    so_far = s.rowsBetween(W.unboundedPreceding, 0)
    p = panel.withColumn("island", F.count_if(F.col("sales") != 0).over(so_far)).withColumn("started", F.max(F.col("sales") > 0).over(so_far))
    run = F.count_if(F.col("sales") == 0).over(W.partitionBy("series_id", "island"))
    return p.select(*panel.columns, "started", F.when(F.col("sales") == 0, run).otherwise(0).cast("long").alias("run_length"))


def probable_stockouts(panel: DataFrame, p_threshold: float = 0.001, min_run: int = 2, min_rate: float = 1.0) -> DataFrame:
    """flagged: a zero day in a run that a Poisson seller of the series' rate would hardly have."""
    own = W.partitionBy("series_id")
    z = zero_runs(panel).withColumn("rate", F.sum("sales").over(own) / F.greatest(F.count_if("started").over(own), F.lit(1)))
    flag = (F.col("sales") == 0) & F.col("started") & (F.col("run_length") >= min_run) & (F.exp(-F.col("rate") * F.col("run_length")) < p_threshold) & (F.col("rate") >= min_rate)
    return z.withColumn("flagged", flag)


def censoring_summary(flags: DataFrame, by: list[str]) -> DataFrame:
    out = flags.groupBy(*by).agg(F.count_if("flagged").alias("flagged_days"), F.count_if("started").alias("observed_days"))
    return out.withColumn("censored_share", F.col("flagged_days") / F.greatest("observed_days", F.lit(1)))


def abc_class(revenue: DataFrame, key: str = "series_id", a: float = 0.80, b: float = 0.95) -> DataFrame:
    """revenue: key, revenue. The class by the share of revenue before the row, largest first (ties by key).

    The running sum is taken by ranges of revenue (ordered.running), so no task holds all rows.
    """
    ranked = ordered.running(revenue.withColumn("_least", -F.col("revenue")), [], "_least", "revenue", [key])
    total = revenue.agg(F.sum("revenue").alias("_total"))  # one row
    share = F.coalesce(div(F.col("before"), F.col("_total")), F.lit(1.0))
    return ranked.crossJoin(F.broadcast(total)).select(*revenue.columns, F.when(share < a, "A").when(share < b, "B").otherwise("C").alias("abc"))


def xyz_class(weekly: DataFrame, key: str = "series_id", x: float = 0.5, y: float = 1.0) -> DataFrame:
    """weekly: key, sales of each week. By the coefficient of variation; a mean of zero is Z."""
    g = weekly.groupBy(key).agg(F.avg("sales").alias("m"), F.stddev_pop("sales").alias("sd"))
    cv = F.when(F.col("m") > 0, F.col("sd") / F.col("m"))
    return g.select(key, cv.alias("cv"), F.when(cv < x, "X").when(cv < y, "Y").otherwise("Z").alias("xyz"))


def service_target(classes: DataFrame) -> DataFrame:
    return classes.withColumn("service_level", lookup(SERVICE_TARGETS, F.concat("abc", "xyz"), 0.95))
