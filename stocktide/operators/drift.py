"""Population stability and retraining flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import div
from ..sources.store import exists, materialised
from . import ordered


def psi(values: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """values: by, recent (boolean), x. PSI of the recent values over quantile bins of the others, by group.

    Values at an edge go up, the outer bins are open, shares are at least 1e-6; 0 without values or with one bin. NULL, NaN and infinite values are left out.
    """
    values = materialised(values.where((F.col("x") > float("-inf")) & (F.col("x") < float("inf"))), "values")  # NaN is above infinity
    old = values.where("not recent")
    wanted = old.select(*by).distinct().select(*by, F.explode(F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("q"))
    edges = ordered.quantiles(old, by, "x", wanted, ordered.plain_position).groupBy(*by).agg(F.sort_array(F.collect_set("value")).alias("edges"))
    binned = values.join(edges, by).select(*by, "recent", "edges", F.size(F.filter("edges", lambda e: e <= F.col("x"))).alias("bin"))
    counts = binned.groupBy(*by, "bin").agg(F.count_if("recent").alias("a"), F.count_if(~F.col("recent")).alias("e"), F.first(F.size("edges")).alias("n_edges"))
    totals = counts.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("e").alias("ne"), F.first("n_edges").alias("n_edges"), F.count("*").alias("seen"))
    tiny = lambda c, n: F.greatest(div(F.col(c), F.col(n)), F.lit(1e-6))
    a, e = tiny("a", "na"), tiny("e", "ne")
    # bins that neither side has add nothing: both shares are the floor
    out = counts.drop("n_edges").join(totals, by).groupBy(*by).agg(F.when((F.first("na") > 0) & (F.first("ne") > 0), F.sum((a - e) * F.log(a / e))).otherwise(0.0).alias("psi"))
    return out


def drift_table(demand: DataFrame, residual: DataFrame, by: list[str], threshold: float = 0.2) -> DataFrame:
    """demand and residual: as for psi()."""
    means = demand.groupBy(*by).agg(F.avg(F.when(~F.col("recent"), F.expm1("x"))).alias("reference_mean"), F.avg(F.when(F.col("recent"), F.expm1("x"))).alias("recent_mean"))
    d, e = psi(demand, by).withColumnRenamed("psi", "demand_psi"), psi(residual, by).withColumnRenamed("psi", "residual_psi")
    worst = F.greatest("demand_psi", "residual_psi")
    return d.join(e, by).join(means, by).withColumn("psi", worst).withColumn("drift", worst >= threshold)


def retrain_flag(scores: DataFrame, node: str, errors: DataFrame, threshold: float = 0.2, degradation: float = 0.10) -> DataFrame:
    """scores: node, psi; errors: one row, recent and reference. One row: retrain, wmape_decay, reasons."""
    names = F.array_sort(F.collect_list(F.when(F.col("psi") >= threshold, F.col(node))))
    g = scores.agg(names.alias("names")).crossJoin(errors.select((div(F.col("recent"), F.col("reference")) - 1).alias("wmape_decay")))
    drifted = F.when(F.size("names") > 0, F.concat(F.lit(f"PSI >= {threshold} for "), F.size("names").cast("string"), F.lit(" node(s): "), F.array_join("names", ", ")))
    worse = F.when(F.col("wmape_decay") > degradation, f"WMAPE is worse than before by over {degradation} of it")
    reasons = F.concat_ws("; ", drifted, worse)
    return g.select((reasons != "").alias("retrain"), "wmape_decay", F.when(reasons == "", "stable").otherwise(reasons).alias("reasons"))


GRID = 1000
SKETCH_K = 800  # ranks off by some 0.4 % (single) with 99 % confidence


def add_sketches(values: DataFrame, path: str, by: list[str]) -> int:
    """values: by, date, x. Appends a mergeable sketch of x for each group and day to the table at path, for the days that it does not hold yet, and
    returns how many days these are. NULL, NaN and infinite values are left out.
    """
    spark = values.sparkSession
    known = values.where((F.col("x") > float("-inf")) & (F.col("x") < float("inf")))
    if exists(spark, path):
        known = known.join(spark.read.parquet(path).select("date").distinct(), "date", "left_anti")
    fresh = materialised(known.groupBy(*by, "date").agg(F.kll_sketch_agg_double(F.col("x").cast("double"), SKETCH_K).alias("sketch"), F.count("*").alias("n")), "sketches")
    days = fresh.select("date").distinct().count()
    if days:
        fresh.write.mode("append").parquet(path)
    return days


def psi_of_sketches(sketches: DataFrame, by: list[str], reference: Column, recent: Column, bins: int = 10) -> DataFrame:
    """by, psi of the recent days over quantile bins of the reference days (conditions on `date`), from stored sketches alone: no value is read again.

    As psi(), with shares off by the sketches' rank error and half a thousandth; 0 where one side has no day.
    """
    merged = lambda c, name: sketches.where(c).groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias(name))
    both = merged(reference, "old").join(merged(recent, "new"), by, "full")
    edges = F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double("old", F.array(*(F.lit(i / bins) for i in range(1, bins))))))
    # values at an edge go up; a rank is read off a grid of the sketch's own quantiles
    ranks = [(i + 0.5) / GRID for i in range(GRID)]
    grid = lambda c: F.kll_sketch_get_quantile_double(c, F.array(*map(F.lit, ranks)))
    at = both.where("old is not null and new is not null").select(*by, edges.alias("_edges"), grid("old").alias("old"), grid("new").alias("new"))
    below = lambda c: F.transform("_edges", lambda e: F.size(F.filter(c, lambda x: x < e)) / F.lit(float(GRID)))
    shares = lambda c: F.concat(F.array(F.lit(0.0)), below(c), F.array(F.lit(1.0)))
    cut = at.select(*by, shares("old").alias("e"), shares("new").alias("a"))
    widths = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.greatest(F.get(c, i) - F.get(c, i - 1), F.lit(1e-6)))
    terms = F.zip_with(widths("a"), widths("e"), lambda a, e: (a - e) * F.log(a / e))
    scored = cut.select(*by, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("psi"))
    return both.select(*by).join(scored, by, "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))
