"""Allocation of a short supply, and rationing. The scenario problem is separable and concave: segments of equal marginal value are taken
above the supply's shadow price, none below it, and those at the price share what is left in proportion. The price is found from
histograms of the values, so no order of all segments is ever made."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import div
from . import ordered
from .uncertainty import expected_fill, mean_of

MIN_FILL = 0.5  # of its forecast, what every node gets
BINS = 4096


def _group_totals(df: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """A row for each `by` (a run, a week): broadcast, as runs and weeks are few whatever the number of nodes."""
    return F.broadcast(df.groupBy(*by).agg(*(v.alias(k) for k, v in sums.items())))


def shadow_price(segments: DataFrame, by: list[str], budget: dict[tuple, float], top: dict[tuple, float]) -> dict[tuple, tuple[float, float]]:
    """segments: by, marginal, length; of each group the budget and an upper bound of the marginals, above zero. Group -> (price, share of the segments at the price that fits).

    Two rounds narrow a group's price to one of BINS ranges of the values, then to one of BINS within it; the distinct values left there (a
    sixteen-millionth of the span) are summed one by one. What comes to the driver is BINS sums a group, whatever the number of
    segments. Groups without budget are left out.
    """
    spark, keys = segments.sparkSession, ", ".join(f"{c} {segments.schema[c].dataType.simpleString()}" for c in by)
    found = {g: (0.0, top[g], 0.0) for g in budget if budget[g] > 0 and top[g] > 0}  # the range's ends, what lies above it
    rest = segments
    for last in (False, False, True):
        if not found:
            return {}
        spans = spark.createDataFrame([(*g, low, high) for g, (low, high, _) in found.items()], f"{keys}, lo double, hi double")
        rest = rest.join(F.broadcast(spans), by).where((F.col("marginal") > F.col("lo")) & (F.col("marginal") <= F.col("hi")))
        at = F.col("marginal") if last else F.ceil((F.col("marginal") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)
        sums = rest.groupBy(*by, at.alias("at")).agg(F.sum("length").alias("sum"), F.min("marginal").alias("low"), F.max("marginal").alias("high")).collect()
        rest, narrowed, prices = segments, {}, {}
        for row in sorted(sums, key=lambda row: -row.low):
            g = tuple(row[c] for c in by)
            _, _, above = narrowed.get(g, found[g])
            before = above if g not in narrowed else above + prices[g][2]
            if before < budget[g]:
                narrowed[g] = (float(np.nextafter(row.low, 0.0)), row.high, before)
                prices[g] = (row.low, min((budget[g] - before) / row.sum, 1.0), row.sum)
        found = narrowed
    return {g: v[:2] for g, v in prices.items()}


def allocate(nodes: DataFrame, by: list[str], supply: Column, min_fill: float = MIN_FILL) -> DataFrame:
    """nodes: by (few groups: runs or weeks), node, forecast, weight, held, scenarios; best a written table, as the search reads it four times.
    supply: an expression over the total `t_forecast` of each `by`.

    Returns nodes with allocated, expected_fill_rate, stockout_risk. Raises nothing: floors beyond the supply show as a
    negative `slack`.
    """
    n = nodes.select(*by, "node", "forecast", "weight", F.greatest("held", F.lit(0.0)).alias("held"), "scenarios")
    n = n.withColumn("floor", F.greatest(F.lit(min_fill) * F.col("forecast") - F.col("held"), F.lit(0.0))).withColumn("start", F.col("held") + F.col("floor"))
    totals = n.groupBy(*by).agg(F.sum("forecast").alias("t_forecast"), F.sum("floor").alias("t_floor"), F.max("weight").alias("top")).select(*by, (supply - F.col("t_floor")).alias("slack"), "top").collect()  # a row a group
    budget = {tuple(t[c] for c in by): t.slack for t in totals}
    k, tops = F.size("scenarios"), F.array_sort("scenarios")
    length = lambda top, j: F.greatest(top - F.greatest(F.col("start"), F.when(j > 0, F.get(tops, j - 1)).otherwise(0.0)), F.lit(0.0))
    marginal = lambda j: F.col("weight") * (k - j) / k
    seg = n.select(*by, F.inline(F.transform(tops, lambda top, j: F.struct(length(top, j).alias("length"), marginal(j).alias("marginal"))))).where("length > 0")
    price = shadow_price(seg, by, budget, {tuple(t[c] for c in by): t.top for t in totals})
    keys = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in by)
    groups = nodes.sparkSession.createDataFrame([(*g, budget[g], *price.get(g, (float("inf"), 0.0))) for g in budget], f"{keys}, slack double, price double, share double")
    part = lambda j: F.when(marginal(j) > F.col("price"), F.lit(1.0)).when(marginal(j) == F.col("price"), F.col("share")).otherwise(0.0)
    take = F.aggregate(F.transform(tops, lambda top, j: length(top, j) * part(j)), F.lit(0.0), lambda a, x: a + x)
    out = n.join(F.broadcast(groups), by).withColumn("allocated", F.col("floor") + take)
    stock = F.col("allocated") + F.col("held")
    return out.select(*by, "node", "forecast", "weight", "held", "scenarios", "allocated", "slack", expected_fill(stock).alias("expected_fill_rate"), mean_of(F.transform("scenarios", lambda d: (d > stock + 1e-9).cast("double"))).alias("stockout_risk"))


def pro_rata(nodes: DataFrame, by: list[str], supply: Column) -> DataFrame:
    """nodes: by, node, forecast, held. Split by net need, never more than the need."""
    n = nodes.withColumn("need", F.greatest(F.col("forecast") - F.col("held"), F.lit(0.0)))
    n = n.join(_group_totals(n, by, t_forecast=F.sum("forecast"), t_need=F.sum("need")), by)
    return n.withColumn("allocated", F.coalesce(div(F.col("need"), F.col("t_need")) * F.least(supply, F.col("t_need")), F.lit(0.0))).drop("need", "t_forecast", "t_need")


def longest_short_runs(fill: DataFrame, floor: float, max_weeks: int) -> DataFrame:
    """fill: node, period, fill_rate. Nodes under the floor for more than max_weeks in a row, with the longest such run."""
    w = W.partitionBy("node").orderBy("period")
    f = fill.withColumn("short", F.coalesce(F.col("fill_rate") < floor - 1e-9, F.lit(False)))  # an unknown rate ends a run
    f = f.withColumn("island", F.count_if(~F.col("short")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = f.where("short").groupBy("node", "island").agg(F.count("*").alias("n")).groupBy("node").agg(F.max("n").alias("longest_short_run"))
    return runs.where(F.col("longest_short_run") > max_weeks)


def ration(orders: DataFrame, mode: str) -> DataFrame:
    """orders: product, row, quantity, available (of the product), cover, value. Adds `shipped`.

    proportional: all alike. days_of_cover, value: whole orders in the order of least cover or most value, then of the row. Products are
    added up before the join; a product's order is taken by ranges, so one with very many rows is no one task's.
    """
    if mode == "proportional":
        total = orders.groupBy("product").agg(F.sum("quantity").alias("_asked"))
        share = F.least(F.coalesce(div(F.col("available"), F.col("_asked")), F.lit(1.0)), F.lit(1.0))
        return orders.join(total, "product").withColumn("shipped", F.col("quantity") * share).drop("_asked")
    if mode not in ("days_of_cover", "value"):
        raise ValueError(f"unknown rationing {mode!r}")
    first = F.col("cover") if mode == "days_of_cover" else -F.col("value")
    ranked = ordered.running(orders.withColumn("_first", first), ["product"], "_first", "quantity", ["row"])
    return ranked.withColumn("shipped", F.greatest(F.least(F.col("quantity"), F.col("available") - F.col("before")), F.lit(0.0))).drop("_first", "before")


def cover_targets(forecast: DataFrame) -> DataFrame:
    """forecast: series_id, step, forecast, cover. Demand over the `cover` days after each day; days past the end count as the mean of the last seven.

    A running sum and, for the end of each span, the running sum `cover` days on.
    """
    s = W.partitionBy("series_id").orderBy("step")
    end = F.max("step").over(W.partitionBy("series_id"))
    f = forecast.withColumn("run", F.sum("forecast").over(s.rowsBetween(W.unboundedPreceding, 0))).withColumn("end", end)
    f = f.withColumn("tail", F.avg(F.when(F.col("step") > F.col("end") - 7, F.col("forecast"))).over(W.partitionBy("series_id"))).withColumn("total", F.sum("forecast").over(W.partitionBy("series_id")))
    upto = f.select("series_id", (F.col("step") - F.col("cover")).alias("step"), F.col("run").alias("then"))
    past = F.greatest(F.col("step") + F.col("cover") - F.col("end"), F.lit(0))
    return f.join(upto, ["series_id", "step"], "left").select("series_id", "step", "cover", (F.coalesce("then", "total") - F.col("run") + past * F.col("tail")).alias("target"))


def dc_safety(rows: DataFrame, dc_cover: int, lead_sd: float = 1.0, z: float = 1.65, factor: float = 1.0) -> DataFrame:
    """rows: product, safety, cover, mean_daily. The warehouse's pooled safety stock of each product."""
    own = F.greatest("safety", F.lit(0.0)) * F.sqrt(F.lit(float(dc_cover)) / F.greatest("cover", F.lit(1)))
    return rows.groupBy("product").agg((F.sqrt(F.sum(own * own) + (F.lit(z * lead_sd) * F.sum("mean_daily")) ** 2) * factor).alias("dc_safety"))
