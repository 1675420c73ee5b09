"""Conformal quantiles, intervals, safety stock and risk from calibration scores (by, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import div
from . import ordered


def level_position(q: Column, n: Column) -> Column:
    """Where, from 0 to n - 1, the finite-sample quantile q of n scores lies."""
    share = F.when(q >= 0.5, F.ceil((n + 1) * q) / n).otherwise(F.floor((n + 1) * q) / n)
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (n - 1)


def conformal_quantiles(scores: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """wanted: by, q. Returns by, q, value, n: each group's quantile at its own levels, by rank and two-point interpolation."""
    return ordered.quantiles(scores, by, "score", wanted, level_position)


def mondrian_quantiles(scores: DataFrame, segment: str, levels: list[float], min_count: int = 500) -> DataFrame:
    """segment, q, value: of the segment's scores, or of all where it has fewer than min_count."""
    qs = scores.sparkSession.createDataFrame([(q,) for q in levels], "q double")
    segments = scores.select(segment).distinct()
    own = conformal_quantiles(scores, [segment], segments.crossJoin(qs))
    pooled = conformal_quantiles(scores.select("score"), [], qs).select("q", F.col("value").alias("pooled"))
    return own.join(F.broadcast(pooled), "q").select(segment, "q", F.when(F.col("n") >= min_count, F.col("value")).otherwise(F.col("pooled")).alias("value"), "n")  # pooled: a row a level


def intervals(points: DataFrame, quantiles: DataFrame, by: list[str], level: float) -> DataFrame:
    """points: by, forecast, scale. lower and upper, clipped at zero."""
    a = (1 - level) / 2
    band = quantiles.groupBy(*by).agg(F.max(F.when(F.abs(F.col("q") - a) < 1e-9, F.col("value"))).alias("lo"), F.max(F.when(F.abs(F.col("q") - (1 - a)) < 1e-9, F.col("value"))).alias("hi"))
    j = points.join(band, by) if by else points.crossJoin(F.broadcast(band))
    at = lambda c: F.greatest(F.col("forecast") + F.col(c) * F.col("scale"), F.lit(0.0))
    return j.withColumns({"lower": at("lo"), "upper": at("hi")}).drop("lo", "hi")


def share_at_most(scores: DataFrame, points: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """points: by, key, threshold. Share of the group's scores at or under each threshold, NULL without scores.

    A range-count join without pairs: scores and thresholds are dealt together by ranges of (by, value), scores before thresholds of the
    same value, and the running count of scores is what each threshold passes. A group is as many tasks' as its rows need.
    """
    s = scores.where("score is not null").select(*by, F.col("score").alias("x"), F.lit(0).alias("kind"), *(F.lit(None).cast(points.schema[k].dataType).alias(k) for k in key))
    both = s.unionByName(points.select(*by, F.col("threshold").alias("x"), F.lit(1).alias("kind"), *key)).withColumn("one", (1 - F.col("kind")).cast("long"))
    n = scores.where("score is not null").groupBy(*by).agg(F.count("*").alias("n"))
    below = ordered.running(both, by, "x", "one", ["kind"]).where("kind = 1")
    joined = below.join(n, by, "left") if by else below.crossJoin(F.broadcast(n))  # one row without groups
    return joined.select(*by, *key, div(F.col("before"), F.col("n")).alias("share"))


SCENARIOS = 25


def grid(k: int) -> list[float]:
    return [(i + 0.5) / k for i in range(k)]


def score_grid(scores: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k mid-quantiles of each group's scores as an array."""
    qs = F.explode(F.array(*map(F.lit, grid(k)))).alias("q")
    wanted = scores.select(*by).distinct().select(*by, qs) if by else scores.sparkSession.range(1).select(qs)
    found = ordered.quantiles(scores, by, "score", wanted, ordered.plain_position)
    return found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "value"))), lambda x: x["value"]).alias("quantiles"))


def scenarios(points: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """points with `scenarios`: equally likely demands, clipped at zero."""
    j = points.join(quantiles, by) if by else points.crossJoin(F.broadcast(quantiles))  # one row without groups
    return j.withColumn("scenarios", F.transform("quantiles", lambda q: F.greatest(F.col("forecast") + F.col("scale") * q, F.lit(0.0)))).drop("quantiles")


def mean_of(array: Column | str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x) / F.size(array)


def expected_fill(stock: Column, demand: Column | str = "scenarios") -> Column:
    """E[min(D, stock)] / E[D] over a demand array; 1 where none is expected."""
    return F.coalesce(div(mean_of(F.transform(demand, lambda d: F.least(d, stock))), mean_of(demand)), F.lit(1.0))


def safety_stock(points: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """points: by, q, forecast, scale. safety_stock and order_up_to at each row's own service level q."""
    j = points.join(quantiles.select(*by, "q", "value"), [*by, "q"])
    safety = F.greatest(F.col("value") * F.col("scale"), F.lit(0.0))
    return j.withColumn("safety_stock", safety).withColumn("order_up_to", F.col("forecast") + safety).drop("value")
