"""Dashboard aggregates and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import bias, r, velocity, wmape
from ..operators import metrics, ordered
from .q_forecast import fca, p1
from .q_stock import banded, cal_scores, carried
from .registry import define, query


_SOLD = "SELECT week, sum(least(actual, held + allocated) * price) AS sold FROM {t} GROUP BY 1"
define("polpair", f"SELECT week, l.sold AS lp, p.sold AS pro_rata FROM ({_SOLD.format(t='lwall')}) l JOIN ({_SOLD.format(t='pwall')}) p USING (week)")


def pairs(spark, sf):
    """What both allocation policies sell in each week, in money."""
    sold = lambda policy: carried(spark, sf, policy).groupBy("week").agg(F.sum(F.least(F.col("actual"), F.col("held") + F.col("allocated")) * F.col("price")).alias(policy))
    return sold("lp").join(sold("pro_rata"), "week")


@query("SELECT week, round(lp, 2) AS lp, round(pro_rata, 2) AS pro_rata, lp > pro_rata AS won FROM polpair")
def policy_pairing(spark, sf):
    """The scenario allocation and the pro-rata one side by side for each week."""
    return pairs(spark, sf).select("week", r("lp", 2).alias("lp"), r("pro_rata", 2).alias("pro_rata"), (F.col("lp") > F.col("pro_rata")).alias("won"))


@query("SELECT round(avg(lp - pro_rata), 4) AS mean, round(avg(lp - pro_rata) - 2.200985160082949 * stddev_samp(lp - pro_rata) / sqrt(count(*)), 4) AS lower, round(avg(lp - pro_rata) + 2.200985160082949 * stddev_samp(lp - pro_rata) / sqrt(count(*)), 4) AS upper, round(avg((lp > pro_rata)::INT), 6) AS wins, count(*) AS n FROM polpair")
def paired_ci(spark, sf):
    """Weekly gain of the scenario allocation over the pro-rata one, with a t interval over the weeks."""
    ci = metrics.paired_ci(pairs(spark, sf).select(F.col("lp").alias("a"), F.col("pro_rata").alias("b")))
    return ci.select(*(r(c).alias(c) for c in ("mean", "lower", "upper")), r("wins", 6).alias("wins"), "n")


@query("SELECT state_id, cat_id, round(w, 6) AS wmape, round(w - min(w) OVER (PARTITION BY state_id), 6) AS gap_to_best FROM (SELECT state_id, cat_id, coalesce(sum(abs(actual - forecast)) / nullif(sum(actual), 0), 0) AS w FROM fca WHERE fold = 'holdout' AND method = 'seasonal_naive' GROUP BY ALL)")
def heat_map(spark, sf):
    """Error by state and category with each row's gap to the state's best."""
    g = fca(spark, sf).where("fold = 'holdout' and method = 'seasonal_naive'").groupBy("state_id", "cat_id").agg(wmape("actual", "forecast").alias("w"))
    return g.select("state_id", "cat_id", r("w", 6).alias("wmape"), r(F.col("w") - F.min("w").over(W.partitionBy("state_id")), 6).alias("gap_to_best"))


@query("SELECT cat_id, round(sum(sales) / sum(sum(sales)) OVER (), 6) AS share, sum(sales) AS sales, count(DISTINCT series_id) AS series FROM p1 CROSS JOIN bounds WHERE date > hi - 28 GROUP BY cat_id")
def category_share(spark, sf):
    from ..sources import retail

    p = p1(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf))).where(F.col("date") > F.date_sub("hi", 28))
    g = p.groupBy("cat_id").agg(F.sum("sales").alias("sales"), F.countDistinct("series_id").alias("series"))
    return g.select("cat_id", r(F.col("sales") / F.sum("sales").over(W.partitionBy()), 6).alias("share"), "sales", "series")


@query("SELECT CASE WHEN v IN ('slow', 'sporadic') THEN 'long_tail' ELSE 'core' END AS part, count(*) AS series, sum(sales) AS sales, round(sum(sales) / sum(sum(sales)) OVER (), 6) AS share FROM (SELECT series_id, sum(sales) AS sales, CASE WHEN avg(sales) >= 2 THEN 'fast' WHEN avg(sales) >= 0.5 THEN 'medium' WHEN avg(sales) >= 0.1 THEN 'slow' ELSE 'sporadic' END AS v FROM p2 GROUP BY 1) GROUP BY 1")
def long_tail_share(spark, sf):
    from .q_panel import p2

    s = p2(spark, sf).groupBy("series_id").agg(F.sum("sales").alias("sales"), velocity(F.avg("sales")).alias("v"))
    g = s.groupBy(F.when(F.col("v").isin("slow", "sporadic"), "long_tail").otherwise("core").alias("part")).agg(F.count("*").alias("series"), F.sum("sales").alias("sales"))
    return g.select("part", "series", "sales", r(F.col("sales") / F.sum("sales").over(W.partitionBy()), 6).alias("share"))


@query("SELECT method, round(least_bias, 6) AS least_bias, round(most_bias, 6) AS most_bias, round(coverage, 6) AS segment_coverage, round(trusted, 6) AS trusted_share FROM (SELECT method, min(bias) AS least_bias, max(bias) AS most_bias FROM (SELECT fold, method, sum(forecast - actual) / nullif(sum(abs(actual)), 0) AS bias FROM fca GROUP BY ALL) GROUP BY 1) CROSS JOIN (SELECT avg(coverage) AS coverage, avg((coverage >= 0.9)::INT) AS trusted FROM (SELECT cat_id, avg((actual BETWEEN lower_95 AND upper_95)::INT) AS coverage FROM ivp GROUP BY 1))")
def accuracy_summary(spark, sf):
    """Of each method the range of its bias over the folds; the mean coverage of the categories' intervals and the share of those that hold 90 % or more."""
    each = fca(spark, sf).groupBy("fold", "method").agg(F.try_divide(F.sum(F.col("forecast") - F.col("actual")), F.sum(F.abs("actual"))).alias("bias"))
    held = banded(spark, sf, False).groupBy("cat_id").agg(F.avg(F.col("actual").between(F.col("lower_95"), F.col("upper_95")).cast("double")).alias("coverage"))
    c = held.agg(r(F.avg("coverage"), 6).alias("segment_coverage"), r(F.avg((F.col("coverage") >= 0.9).cast("double")), 6).alias("trusted_share"))
    return each.groupBy("method").agg(r(F.min("bias"), 6).alias("least_bias"), r(F.max("bias"), 6).alias("most_bias")).crossJoin(F.broadcast(c))  # one row


@query("SELECT round(avg((actual BETWEEN lower_95 AND upper_95)::INT), 6) AS coverage_95, round(sum(abs(actual - forecast)) / sum(actual), 6) AS wmape, round(sum(forecast - actual) / sum(actual), 6) AS bias, count(*) AS n, round((SELECT sum(lp) / sum(pro_rata) - 1 FROM polpair), 6) AS lp_revenue_change FROM ivp")
def overview(spark, sf):
    """Headline figures of the holdout, and what the scenario allocation earned beyond the pro-rata one."""
    b = banded(spark, sf, False)
    change = pairs(spark, sf).agg(r(F.try_divide(F.sum("lp"), F.sum("pro_rata")) - 1, 6).alias("lp_revenue_change"))
    return b.agg(r(F.avg(F.col("actual").between(F.col("lower_95"), F.col("upper_95")).cast("double")), 6).alias("coverage_95"), r(wmape("actual", "forecast"), 6).alias("wmape"), r(bias("actual", "forecast"), 6).alias("bias"), F.count("*").alias("n")).crossJoin(F.broadcast(change))  # one row


@query("SELECT cat_id, round(avg(score), 6) AS mean_score, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, count(*) AS n FROM cal_scores GROUP BY 1")
def score_summary(spark, sf):
    s = cal_scores(spark, sf)
    wanted = s.select("cat_id").distinct().select("cat_id", F.explode(F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    at = lambda level: r(F.max(F.when(F.col("q") == level, F.col("value"))), 6)
    found = ordered.quantiles(s, ["cat_id"], "score", wanted, ordered.plain_position).groupBy("cat_id").agg(at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.95).alias("p95"))
    return s.groupBy("cat_id").agg(r(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n")).join(found, "cat_id")


define("hol_events", "SELECT DISTINCT date AS ds, event_name AS holiday FROM cal WHERE event_name IS NOT NULL")


@query("SELECT ds, holiday FROM hol_events")
def holidays(spark, sf):
    from ..sources import m5, retail

    cal = retail.calendar(spark, sf).select("date", F.col("event_name").alias("event_name_1"), F.col("event_name").alias("event_name_2"))
    return m5.holidays(cal)


@query("SELECT series_id, dense_rank() OVER (ORDER BY series_id) - 1 AS code FROM (SELECT DISTINCT series_id FROM p1)")
def category_codes(spark, sf):
    """Integer codes of the series, in order of their names."""
    return ordered.codes(p1(spark, sf), "series_id")


@query("SELECT fold, method, series_id, round(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0), 6) AS wmape, round(sum(forecast - actual) / nullif(sum(abs(actual)), 0), 6) AS bias, sum(actual) AS units FROM fca GROUP BY ALL")
def series_accuracy(spark, sf):
    """Error and bias of each series, NULL where nothing was sold."""
    m = metrics.wmape_bias(fca(spark, sf), ["fold", "method", "series_id"])
    return m.withColumns({"wmape": r("wmape", 6), "bias": r("bias", 6)})
