"""What dashboards show: masked forecasts, name parts, weighted errors, policy totals, a watch list and display texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import r
from ..operators import allocate as al
from ..sources import retail
from .q_forecast import decision_accuracy, fc1, p1
from .q_stock import _supply, alloc_nodes, carried
from .registry import BODIES, define, query

define("shelf", "SELECT f.fold, s.series_id, max(p.date) AS sold FROM foldt f CROSS JOIN (SELECT DISTINCT series_id FROM p1) s LEFT JOIN p1 p ON p.series_id = s.series_id AND p.price IS NOT NULL AND p.date <= f.origin AND p.date > f.origin - 28 GROUP BY ALL")


@query("SELECT f.fold, f.series_id, f.method, f.date, CASE WHEN sold IS NULL OR event_name IS NOT DISTINCT FROM 'Christmas' THEN 0.0 ELSE forecast END AS forecast FROM fc1 f JOIN shelf USING (fold, series_id) LEFT JOIN cal c ON c.date = f.date")
def on_shelf_forecast(spark, sf):
    """Forecasts, 0 on closed days and for series without a price in the four weeks before the origin."""
    from .q_forecast import fold_table

    priced = p1(spark, sf).where("price is not null").crossJoin(F.broadcast(fold_table(spark, sf)))  # a row a fold
    sold = priced.where((F.col("date") <= F.col("origin")) & (F.col("date") > F.date_sub("origin", 28))).select("fold", "series_id", F.lit(True).alias("sold")).distinct()
    days = F.broadcast(retail.calendar(spark, sf).select("date", "event_name"))  # a row a day
    j = fc1(spark, sf).join(sold, ["fold", "series_id"], "left").join(days, "date", "left")
    open_ = F.col("sold") & ~F.col("event_name").eqNullSafe("Christmas")
    return j.select("fold", "series_id", "method", "date", F.when(open_, F.col("forecast")).otherwise(0.0).alias("forecast"))


@query("SELECT DISTINCT dept_id, regexp_extract(dept_id, '^(.*)_[^_]*$', 1) AS before, regexp_extract(dept_id, '_([^_]*)$', 1) AS last, split_part(dept_id, '_', 1) AS prefix FROM fact")
def name_parts(spark, sf):
    """A department's name cut at its last underscore, and its first part."""
    names = retail.table(spark, sf, "part").select(F.concat("p_type", F.lit("_"), "p_brand").alias("dept_id")).distinct()
    return names.select("dept_id", F.regexp_extract("dept_id", "^(.*)_[^_]*$", 1).alias("before"), F.regexp_extract("dept_id", "_([^_]*)$", 1).alias("last"), F.split_part("dept_id", F.lit("_"), F.lit(1)).alias("prefix"))


@query(f"SELECT fold, method, round(sum(wmape * greatest(units, 1e-9)) / sum(greatest(units, 1e-9)), 6) AS wmape FROM ({BODIES['decision_accuracy']}) WHERE wmape IS NOT NULL GROUP BY ALL")
def weighted_decision_error(spark, sf):
    """The decision windows' error, weighted by their units."""
    weight = F.greatest("units", F.lit(1e-9))
    return decision_accuracy(spark, sf).where("wmape is not null").groupBy("fold", "method").agg(r(F.sum(F.col("wmape") * weight) / F.sum(weight), 6).alias("wmape"))


define("bothpol", "SELECT 'lp' AS policy, * FROM lwall UNION ALL SELECT 'pro_rata', * FROM pwall")


def policies(spark, sf) -> DataFrame:
    return carried(spark, sf, "lp").withColumn("policy", F.lit("lp")).unionByName(carried(spark, sf, "pro_rata").withColumn("policy", F.lit("pro_rata")))


@query("SELECT policy, round(sum(allocated), 2) AS allocated, sum(actual) AS demand, round(sum(least(actual, held + allocated)) / sum(actual), 6) AS fill_rate FROM bothpol GROUP BY 1")
def allocation_totals(spark, sf):
    """Each policy over all weeks."""
    sold = F.least(F.col("actual"), F.col("held") + F.col("allocated"))
    return policies(spark, sf).groupBy("policy").agg(r(F.sum("allocated"), 2).alias("allocated"), F.sum("actual").alias("demand"), r(F.try_divide(F.sum(sold), F.sum("actual")), 6).alias("fill_rate"))


@query("SELECT policy, node, max(n)::BIGINT AS longest_short_run FROM (SELECT policy, node, island, count(*) AS n FROM (SELECT *, week - row_number() OVER (PARTITION BY policy, node ORDER BY week) AS island FROM (SELECT policy, node, week FROM bothpol WHERE least(actual, held + allocated) / nullif(actual, 0) < 0.5 - 1e-9)) GROUP BY ALL) GROUP BY ALL HAVING max(n) > 2")
def fairness_by_policy(spark, sf):
    """Nodes that a policy leaves short for over two weeks in a row."""
    fill = F.try_divide(F.least(F.col("actual"), F.col("held") + F.col("allocated")), F.col("actual"))
    rows = policies(spark, sf).select(F.struct("policy", "node").alias("node"), F.col("week").alias("period"), fill.alias("fill_rate"))
    return al.longest_short_runs(rows, 0.5, 2).select("node.policy", "node.node", "longest_short_run")


@query("SELECT split_part(node, '|', 1) AS category, count(*) AS watched, round(sum(forecast) / any_value(total), 6) AS share_of_week FROM (SELECT *, sum(forecast) OVER () AS total, list_avg(list_transform(scenarios, lambda d: least(d, allocated + held))) / nullif(list_avg(scenarios), 0) AS fill FROM alp) WHERE fill < 0.95 GROUP BY 1")
def watch_list(spark, sf):
    """By category: nodes expected to fill less than 0.95 of the next week's demand, and their share of it."""
    nodes = alloc_nodes(spark, sf)
    out = al.allocate(nodes, ["run"], _supply(), al.MIN_FILL)
    total = F.broadcast(nodes.agg(F.sum("forecast").alias("total")))  # one row
    low = out.where("expected_fill_rate < 0.95").crossJoin(total)
    return low.groupBy(F.split_part("node", F.lit("|"), F.lit(1)).alias("category")).agg(F.count("*").alias("watched"), r(F.sum("forecast") / F.first("total"), 6).alias("share_of_week"))


def percent(x: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.round(x * 100, 1)), F.lit("%"))


def money(x: Column) -> Column:
    """$950, $12.3k or $4.5M."""
    scaled = lambda by, end: F.concat(F.format_string("$%.1f", F.round(x / by, 1)), F.lit(end))
    return F.when(F.abs(x) >= 1e6, scaled(1e6, "M")).when(F.abs(x) >= 1e3, scaled(1e3, "k")).otherwise(F.format_string("$%.0f", F.round(x, 0)))


def signed(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise("-"), F.format_string("%.1f", F.abs(F.round(x, 1))))


def node_label(node: Column) -> Column:
    """level:a=x|b=y as x / y."""
    return F.array_join(F.transform(F.split(F.regexp_replace(node, "^[^:]*:", ""), "[|]"), lambda p: F.regexp_replace(p, "^[^=]*=", "")), " / ")


_USD = "CASE WHEN abs({x}) >= 1e6 THEN printf('$%.1fM', round({x} / 1e6, 1)) WHEN abs({x}) >= 1e3 THEN printf('$%.1fk', round({x} / 1e3, 1)) ELSE printf('$%.0f', round({x}, 0)) END"


@query(f"SELECT 'store:store_id=' || store_id AS node, store_id AS label, {_USD.format(x='revenue')} AS revenue, printf('%.1f', round(share * 100, 1)) || '%' AS share, CASE WHEN share - even >= 0 THEN '+' ELSE '-' END || printf('%.1f', abs(round((share - even) * 1000, 1))) AS above_even FROM (SELECT store_id, round(sum(revenue), 2) AS revenue, round(sum(sales) / any_value(t), 9) AS share, round(1.0 / any_value(n), 9) AS even FROM fact CROSS JOIN (SELECT sum(sales) AS t, count(DISTINCT store_id) AS n FROM fact) GROUP BY store_id)")
def display_texts(spark, sf):
    """Revenue, share of units and distance to an even share (in thousandths) of each store, as texts."""
    by_store = retail.daily(spark, sf, ["store_id"]).groupBy("store_id").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.sum("sales").alias("sales"))
    whole = F.broadcast(by_store.agg(F.sum("sales").alias("t"), F.count("*").alias("n")))  # one row
    s = by_store.crossJoin(whole).select("store_id", "revenue", F.round(F.col("sales") / F.col("t"), 9).alias("share"), F.round(1.0 / F.col("n"), 9).alias("even"))
    node = F.concat(F.lit("store:store_id="), "store_id")
    return s.select(node.alias("node"), node_label(node).alias("label"), money(F.col("revenue")).alias("revenue"), percent(F.col("share")).alias("share"), signed((F.col("share") - F.col("even")) * 1000).alias("above_even"))
