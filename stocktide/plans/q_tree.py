"""The tree of departments, categories, states and the total: base forecasts, the reconciliation menu, its choice and what is served.

Three folds: backtest_3, on which the method is chosen; holdout; and production, after the last day. The errors of the fold before
weigh `mint_oos`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import r, wmape
from ..operators import forecast, metrics, reconcile
from ..sources import retail
from .q_forecast import _FLOORS, FOLDS, fca
from .q_panel import p2
from .registry import define, query

#: Fold -> (tag of its CTEs, days from the last day back to its origin, the fold whose errors are known by then).
TREE = {"holdout": ("", FOLDS["holdout"], "backtest_3"), "backtest_3": ("_b3", FOLDS["backtest_3"], "backtest_2"), "production": ("_pr", 0, "holdout")}
CHOSEN_ON, COHERENT = "backtest_3", ("bottom_up", "top_down", "mint_diagonal", "mint_oos")
LEVEL = {0: "total", 1: "state", 2: "category", 3: "series"}

_UP = "SELECT series_id AS node, cat_id || '|' || state_id AS parent, 3 AS level, {c} FROM {t} UNION ALL SELECT cat_id || '|' || state_id, state_id, 2, {c} FROM {t} UNION ALL SELECT state_id, 'total', 1, {c} FROM {t} UNION ALL SELECT 'total', '', 0, {c} FROM {t}"
define("fold_pr", "SELECT 'production' AS fold, hi AS origin FROM bounds")
define("fc2_pr", _FLOORS.replace("foldt o", "fold_pr o").format(keys="series_id, dept_id, cat_id, state_id", panel="p2"))
for _fold, (_t, _back, _prior) in TREE.items():
    define(f"leaf{_t}", f"SELECT series_id, cat_id, state_id, step, date, forecast FROM {'fc2_pr' if _fold == 'production' else 'fc2'} WHERE fold = '{_fold}' AND method = 'seasonal_naive'")
    define(f"nday{_t}", f"SELECT node, parent, level, date, sum(sales) AS sales, sum(revenue) AS revenue FROM ({_UP.format(c='date, sales, revenue', t='p2')}) CROSS JOIN bounds WHERE date <= hi - {_back} GROUP BY ALL")
    define(f"nstat{_t}", f"SELECT node, parent, level, avg(CASE WHEN date > hi - {_back + 28} THEN sales END) AS mean28, greatest(coalesce(var_samp(CASE WHEN date > hi - {_back + 63} THEN d END), 0), 1e-9) AS w FROM (SELECT *, sales - lag(sales, 7) OVER (PARTITION BY node, level ORDER BY date) AS d FROM nday{_t}) CROSS JOIN bounds GROUP BY ALL")
    define(f"omse{_t}", f"SELECT node, avg((a - f) ** 2) AS mse FROM (SELECT node, date, sum(actual) AS a, sum(forecast) AS f FROM (SELECT unnest([cat_id || '|' || state_id, state_id, 'total']) AS node, date, actual, forecast FROM fca WHERE method = 'seasonal_naive' AND fold = '{_prior}') GROUP BY ALL) GROUP BY 1")
    define(f"nbase{_t}", f"SELECT n.node, parent, level, step, w, greatest(coalesce(mse, w), 1e-9) AS wo, CASE WHEN level = 3 THEN forecast ELSE mean28 END AS y FROM nstat{_t} n CROSS JOIN (SELECT DISTINCT step FROM leaf{_t}) s LEFT JOIN (SELECT series_id, step AS st, forecast FROM leaf{_t}) f ON f.series_id = n.node AND f.st = s.step LEFT JOIN omse{_t} o ON o.node = n.node")
    for _v, _w in (("d", "w"), ("o", "wo")):
        define(f"{_v}u3{_t}", f"SELECT node, parent, step, y AS m, {_w} AS v FROM nbase{_t} WHERE level = 3")
        for _k in (2, 1, 0):
            define(f"{_v}s{_k}{_t}", f"SELECT parent AS node, step, sum(m) AS sm, sum(v) AS sv FROM {_v}u{_k + 1}{_t} GROUP BY ALL")
            define(f"{_v}u{_k}{_t}", f"SELECT b.node, b.parent, b.step, (y / {_w} + sm / sv) / (1 / {_w} + 1 / sv) AS m, 1 / (1 / {_w} + 1 / sv) AS v FROM nbase{_t} b JOIN {_v}s{_k}{_t} s ON s.node = b.node AND s.step = b.step WHERE level = {_k}")
        define(f"{_v}x0{_t}", f"SELECT node, step, m AS x FROM {_v}u0{_t}")
        for _k in (1, 2, 3):
            define(f"{_v}x{_k}{_t}", f"SELECT u.node, u.step, m + v / sv * (p.x - sm) AS x FROM {_v}u{_k}{_t} u JOIN {_v}x{_k - 1}{_t} p ON p.node = u.parent AND p.step = u.step JOIN {_v}s{_k - 1}{_t} s ON s.node = u.parent AND s.step = u.step")
    define(f"tprops{_t}", f"SELECT series_id, share / sum(share) OVER () AS proportion FROM (SELECT series_id, avg(sales / d) AS share FROM (SELECT series_id, sales, sum(sales) OVER (PARTITION BY date) AS d FROM p2 CROSS JOIN bounds WHERE date > hi - {_back + 91} AND date <= hi - {_back}) WHERE d > 0 GROUP BY 1)")
    define(f"menu{_t}", f"SELECT method, series_id, step, greatest(f, 0) AS forecast FROM (SELECT 'bottom_up' AS method, node AS series_id, step, y AS f FROM nbase{_t} WHERE level = 3 UNION ALL SELECT 'top_down', series_id, step, proportion * y FROM tprops{_t} CROSS JOIN (SELECT step, sum(forecast) AS y FROM leaf{_t} GROUP BY 1) UNION ALL SELECT 'mint_diagonal', node, step, x FROM dx3{_t} UNION ALL SELECT 'mint_oos', node, step, x FROM ox3{_t})")
    define(f"mday{_t}", f"SELECT method, node, level, step, sum(forecast) AS forecast FROM ({_UP.format(c='method, step, forecast', t=f'(SELECT m.*, cat_id, state_id FROM menu{_t} m JOIN (SELECT DISTINCT series_id, cat_id, state_id FROM leaf{_t}) USING (series_id))')}) GROUP BY ALL UNION ALL SELECT 'base', node, level, step, y FROM nbase{_t}")
    define(f"nact{_t}", f"SELECT node, level, step, sum(sales) AS actual FROM ({_UP.format(c='step, sales', t=f'(SELECT series_id, cat_id, state_id, CAST(date - (hi - {_back}) AS INTEGER) AS step, sales FROM p2 CROSS JOIN bounds WHERE date > hi - {_back} AND date <= hi - {_back} + 28)')}) GROUP BY ALL")
    define(f"nscl{_t}", f"SELECT node, level, avg(step * step) AS scale, any_value(weight) AS weight FROM (SELECT node, level, max(sales) OVER o > 0 AS started, lead(sales) OVER (PARTITION BY node, level ORDER BY date) - sales AS step, sum(CASE WHEN date > hi - {_back + 28} THEN revenue ELSE 0 END) OVER (PARTITION BY node, level) AS weight FROM nday{_t} CROSS JOIN bounds WINDOW o AS (PARTITION BY node, level ORDER BY date ROWS UNBOUNDED PRECEDING)) WHERE started AND step IS NOT NULL GROUP BY ALL")
    define(f"mscore{_t}", f"SELECT '{_fold}' AS fold, method, level, sum(abs(a - f)) / sum(a) AS wmape, wrmsse FROM (SELECT method, level, node, step, actual AS a, forecast AS f FROM mday{_t} JOIN nact{_t} USING (node, level, step)) JOIN (SELECT method, level, sum(weight * sqrt(mse / scale)) / sum(weight) AS wrmsse FROM (SELECT method, level, node, avg((actual - forecast) ** 2) AS mse FROM mday{_t} JOIN nact{_t} USING (node, level, step) GROUP BY ALL) JOIN nscl{_t} USING (node, level) WHERE scale > 0 GROUP BY ALL) USING (method, level) GROUP BY ALL")


def _up(df: DataFrame, *keep: str) -> DataFrame:
    """Each row of series_id, cat_id, state_id once for every node above it: node, parent, level, keep."""
    cat = F.concat_ws("|", "cat_id", "state_id")
    nodes = ((3, F.col("series_id"), cat), (2, cat, F.col("state_id")), (1, F.col("state_id"), F.lit("total")), (0, F.lit("total"), F.lit("")))
    x = F.explode(F.array(*(F.struct(n.alias("node"), p.alias("parent"), F.lit(k).alias("level")) for k, n, p in nodes))).alias("_x")
    return df.select(x, *keep).select("_x.*", *keep)


def leaves(spark, sf, fold="holdout") -> DataFrame:
    """The seasonal naive forecast of each series of a fold."""
    origin = forecast.origins(retail.bounds(spark, sf), {fold: TREE[fold][1]})
    return forecast.floors(p2(spark, sf), origin).where("method = 'seasonal_naive'").drop("method")


def node_days(spark, sf, fold) -> DataFrame:
    """Daily sums of every node up to the fold's origin."""
    known = p2(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf))).where(F.col("date") <= F.date_sub("hi", TREE[fold][1]))  # one row
    days = _up(known, "date", "sales", "revenue", "hi").groupBy("node", "parent", "level", "date", "hi").agg(F.sum("sales").alias("sales"), F.sum("revenue").alias("revenue"))
    return days.withColumn("ago", F.datediff(F.date_sub("hi", TREE[fold][1]), "date"))


def _base(spark, sf, fold) -> DataFrame:
    change = F.col("sales") - F.lag("sales", 7).over(W.partitionBy("node", "level").orderBy("date"))
    days = node_days(spark, sf, fold).withColumn("d", change)
    spread = F.var_samp(F.when(F.col("ago") < 63, F.col("d")))
    stat = days.groupBy("node", "parent", "level").agg(F.avg(F.when(F.col("ago") < 28, F.col("sales"))).alias("mean28"), F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(1e-9)).alias("w"))
    errors = fca(spark, sf).where((F.col("method") == "seasonal_naive") & (F.col("fold") == TREE[fold][2])).select(F.explode(F.array(F.concat_ws("|", "cat_id", "state_id"), "state_id", F.lit("total"))).alias("node"), "date", "actual", "forecast")
    mse = errors.groupBy("node", "date").agg(F.sum("actual").alias("a"), F.sum("forecast").alias("f")).groupBy("node").agg(F.avg((F.col("a") - F.col("f")) ** 2).alias("mse"))
    leaf = leaves(spark, sf, fold).select(F.col("series_id").alias("node"), "step", "forecast")
    steps = stat.join(mse, "node", "left").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(28))))
    j = steps.join(leaf, ["node", "step"], "left")
    return j.select("step", "node", "parent", "level", F.when(F.col("level") == 3, F.col("forecast")).otherwise(F.col("mean28")).alias("y"), "w", F.greatest(F.coalesce("mse", "w"), F.lit(1e-9)).alias("wo"))


def tree_base(spark, sf, fold="holdout") -> DataFrame:
    """y of every node and step: leaves by the seasonal naive, the nodes above by the mean of four weeks. w: variance of week-on-week
    changes over nine weeks; wo: mean squared error on the fold before, w where there is none."""
    return retail.once(spark, sf, ("tree", fold), lambda: _base(spark, sf, fold))


def _mint(base: DataFrame, variance: str) -> DataFrame:
    return reconcile.mint_tree(base.select("step", "node", "parent", "level", "y", F.col(variance).alias("w")), 3, ["step"])


def _proportions(spark, sf, fold) -> DataFrame:
    back = TREE[fold][1]
    h = p2(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf))).where((F.col("date") > F.date_sub("hi", back + 91)) & (F.col("date") <= F.date_sub("hi", back)))
    return reconcile.proportions(h)


def _menu(spark, sf, fold) -> DataFrame:
    base, leaf = tree_base(spark, sf, fold), leaves(spark, sf, fold)
    total = F.broadcast(leaf.groupBy("step").agg(F.sum("forecast").alias("forecast")))  # a row a step
    tops = reconcile.top_down(_proportions(spark, sf, fold), total)
    named = lambda df, name, value="forecast", key="node": df.select(F.lit(name).alias("method"), F.col(key).alias("series_id"), "step", F.greatest(value, F.lit(0.0)).alias("forecast"))
    menu = named(base.where("level = 3"), "bottom_up", "y").unionByName(named(tops, "top_down", key="series_id"))
    for name, variance in (("mint_diagonal", "w"), ("mint_oos", "wo")):
        menu = menu.unionByName(named(_mint(base, variance).where("level = 3"), name))
    added = _up(menu.join(leaf.select("series_id", "cat_id", "state_id").distinct(), "series_id"), "method", "step", "forecast")
    coherent = added.groupBy("method", "node", "level", "step").agg(F.sum("forecast").alias("forecast"))
    return coherent.unionByName(base.select(F.lit("base").alias("method"), "node", "level", "step", F.col("y").alias("forecast")))


def menu(spark, sf, fold) -> DataFrame:
    """method, node, level, step, forecast: each method's leaves, clipped at zero and added up; `base` is each node's own forecast."""
    return retail.once(spark, sf, ("menu", fold), lambda: _menu(spark, sf, fold))


def scores(spark, sf, fold) -> DataFrame:
    """fold, method, level, wmape, wrmsse."""
    back = TREE[fold][1]
    ahead = p2(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf))).withColumn("step", F.datediff("date", F.date_sub("hi", back))).where("step between 1 and 28")
    actual = _up(ahead, "step", "sales").groupBy("node", "level", "step").agg(F.sum("sales").alias("actual"))
    rows = menu(spark, sf, fold).join(actual, ["node", "level", "step"]).withColumn("series_id", F.concat_ws(":", "level", "node"))
    days = node_days(spark, sf, fold).withColumn("series_id", F.concat_ws(":", "level", "node"))
    weights = days.groupBy("series_id").agg(F.sum(F.when(F.col("ago") < 28, F.col("revenue")).otherwise(0.0)).alias("weight"))
    each = rows.groupBy("method", "level").agg(wmape("actual", "forecast").alias("wmape"))
    return each.join(metrics.wrmsse(rows, metrics.naive_scale(days), weights, ["method", "level"]), ["method", "level"]).withColumn("fold", F.lit(fold))


def _level() -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LEVEL.items() for x in kv)), F.col("level"))


_LEVEL = "CASE level " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LEVEL.items()) + " END"


@query(" UNION ALL ".join(f"SELECT {k} AS level, node, step, round(x, 4) AS forecast FROM dx{k}" for k in range(4)))
def mint_tree(spark, sf):
    return _mint(tree_base(spark, sf), "w").select("level", "node", "step", r("forecast").alias("forecast"))


@query(" UNION ALL ".join(f"SELECT {k} AS level, node, step, round(x, 4) AS forecast FROM ox{k}" for k in range(4)))
def mint_oos(spark, sf):
    """The tree with the errors of the fold before as variances, where there are any."""
    return _mint(tree_base(spark, sf), "wo").select("level", "node", "step", r("forecast").alias("forecast"))


define("wktot", "SELECT CAST((ago - (ago % 7)) // 7 AS INTEGER) AS back, sum(sales) AS total FROM (SELECT CAST((hi - 28) - date AS INTEGER) AS ago, sales FROM nday CROSS JOIN bounds WHERE level = 0) WHERE ago < 91 GROUP BY 1")
define("wkfc", "SELECT avg(CASE WHEN back < 4 THEN total END) AS total, greatest(var_samp(d), 1e-9) AS vw FROM (SELECT back, total, total - lead(total) OVER (ORDER BY back) AS d FROM wktot)")


@query("SELECT week, step, round(greatest(forecast + coalesce((total - sum(forecast) OVER (PARTITION BY week)) * vd / (vw + 7 * vd), 0), 0), 4) AS forecast FROM (SELECT CAST((step - 1) // 7 AS BIGINT) AS week, step, sum(forecast) AS forecast FROM leaf GROUP BY 1, 2) CROSS JOIN wkfc CROSS JOIN (SELECT w AS vd FROM nstat WHERE level = 0)")
def temporal_reconcile(spark, sf):
    """The total's days against a forecast of whole weeks: the mean of the last four, with the variance of changes over thirteen."""
    total = node_days(spark, sf, "holdout").where("level = 0 and ago < 91")
    weeks = total.groupBy(F.floor(F.col("ago") / 7).alias("back")).agg(F.sum("sales").alias("total"))
    change = F.col("total") - F.lead("total").over(W.orderBy("back"))  # thirteen rows
    known = weeks.withColumn("d", change).agg(F.avg(F.when(F.col("back") < 4, F.col("total"))).alias("total"), F.greatest(F.var_samp("d"), F.lit(1e-9)).alias("vw"))
    spread = tree_base(spark, sf).where("level = 0 and step = 1").select(F.col("w").alias("vd"))
    daily = leaves(spark, sf).groupBy("step").agg(F.sum("forecast").alias("forecast")).crossJoin(F.broadcast(spread)).select(F.lit("total").alias("node"), F.floor((F.col("step") - 1) / 7).alias("week"), "step", "forecast", "vd")
    weekly = daily.select("node", "week").distinct().crossJoin(F.broadcast(known))
    return reconcile.temporal(daily, weekly, ["node"]).select("week", "step", r("forecast").alias("forecast"))


@query(f"SELECT fold, method, {_LEVEL} AS level, round(wmape, 6) AS wmape, round(wrmsse, 6) AS wrmsse FROM (SELECT * FROM mscore UNION ALL SELECT * FROM mscore_b3)")
def reconcile_all(spark, sf):
    """The reconciliation menu and the base forecasts, scored at each level of two folds."""
    both = scores(spark, sf, "backtest_3").unionByName(scores(spark, sf, "holdout"))
    return both.select("fold", "method", _level().alias("level"), r("wmape", 6).alias("wmape"), r("wrmsse", 6).alias("wrmsse"))


define("chosen", "SELECT arg_min(method, w) AS method, min(w) AS wrmsse FROM (SELECT method, round(avg(wrmsse), 9) AS w FROM mscore_b3 WHERE method <> 'base' GROUP BY 1)")


def _chosen(spark, sf) -> DataFrame:
    each = scores(spark, sf, CHOSEN_ON).where(F.col("method").isin(*COHERENT)).groupBy("method").agg(F.round(F.avg("wrmsse"), 9).alias("w"))
    return each.agg(F.min_by("method", F.struct("w", "method")).alias("method"), F.min("w").alias("wrmsse"))


def chosen(spark, sf) -> DataFrame:
    return retail.once(spark, sf, ("chosen",), lambda: _chosen(spark, sf))


@query("SELECT method, round(wrmsse, 6) AS wrmsse FROM chosen")
def serve_select(spark, sf):
    """The coherent method with the least WRMSSE, mean over the levels, on the last backtest; the holdout has no say."""
    return chosen(spark, sf).select("method", r("wrmsse", 6).alias("wrmsse"))


@query(f"SELECT node AS series_id, {_LEVEL} AS level, m.method, step, CAST(hi + step AS DATE) AS date, round(forecast, 4) AS forecast, m.method = c.method AS served FROM mday_pr m CROSS JOIN chosen c CROSS JOIN bounds")
def served_forecasts(spark, sf):
    """The production forecasts of every node by every method, and which one is served."""
    best = F.broadcast(chosen(spark, sf).select(F.col("method").alias("best")))  # one row
    rows = menu(spark, sf, "production").crossJoin(best).crossJoin(F.broadcast(retail.bounds(spark, sf)))
    return rows.select(F.col("node").alias("series_id"), _level().alias("level"), "method", "step", F.date_add("hi", F.col("step")).alias("date"), r("forecast").alias("forecast"), (F.col("method") == F.col("best")).alias("served"))
