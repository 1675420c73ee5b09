"""Intervals, safety stock, allocation, rationing and serving as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import lookup, r, round_to_case, uniform, velocity
from ..operators import allocate as al
from ..operators import forecast, metrics, stockouts
from ..operators import uncertainty as un
from ..sources import retail
from ..sources.store import materialised
from . import terms
from .q_forecast import _FLOORS, fca, fold_table, p1
from .registry import define, query

define("ms1", "SELECT series_id, greatest(avg(change), 0.1) AS scale FROM (SELECT series_id, date, abs(sales - lag(sales, 7) OVER (PARTITION BY series_id ORDER BY date)) AS change FROM p1) CROSS JOIN bounds WHERE date > hi - 56 GROUP BY 1")
define("srows", "SELECT fold, series_id, cat_id, state_id, step, date, forecast, actual, scale, (actual - forecast) / scale AS score FROM fca JOIN ms1 USING (series_id) WHERE method = 'seasonal_naive'")
define("cal_scores", "SELECT * FROM srows WHERE fold <> 'holdout'")


def srows(spark, sf):
    """Scaled errors of the seasonal naive forecast."""
    j = fca(spark, sf).where("method = 'seasonal_naive'").join(metrics.mad_scale(p1(spark, sf)), "series_id")
    return j.withColumn("score", (F.col("actual") - F.col("forecast")) / F.col("scale"))


def cal_scores(spark, sf):
    return srows(spark, sf).where("fold <> 'holdout'")


def _sqlq(table: str, by: str, q: str) -> str:
    """SQL for the finite-sample quantiles q of table.score by `by` (with a trailing comma), as lists."""
    pos = "(least(greatest(CASE WHEN q >= 0.5 THEN ceil((n + 1) * q) / n ELSE floor((n + 1) * q) / n END, 0), 1) * (n - 1))"
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"SELECT {by} q, n, s[CAST(floor({pos}) AS INTEGER) + 1] * (1 - ({pos} - floor({pos}))) + coalesce(s[CAST(floor({pos}) AS INTEGER) + 2], 0) * ({pos} - floor({pos})) AS value FROM (SELECT {by} list_sort(list(score)) AS s, count(*) AS n FROM {table} {group}) CROSS JOIN (SELECT unnest({q})::DOUBLE AS q)"


_QS = [0.025, 0.1, 0.9, 0.975]
define("cq_cat", _sqlq("cal_scores", "cat_id, ", str(_QS)))
define("cq_all", _sqlq("cal_scores", "", str(_QS)))
define("fcn", _FLOORS.format(keys="series_id, cat_id, store_id, state_id", panel="pn"))
define("msn", "SELECT series_id, greatest(avg(change), 0.1) AS scale FROM (SELECT series_id, date, abs(sales - lag(sales, 7) OVER (PARTITION BY series_id ORDER BY date)) AS change FROM pn) CROSS JOIN bounds WHERE date > hi - 56 GROUP BY 1")
define("veln", "SELECT series_id, CASE WHEN avg(sales) >= 2 THEN 'fast' WHEN avg(sales) >= 0.5 THEN 'medium' WHEN avg(sales) >= 0.1 THEN 'slow' ELSE 'sporadic' END AS speed FROM pn CROSS JOIN bounds WHERE date <= hi - 112 GROUP BY 1")
define("srn", "SELECT f.fold, f.series_id, f.date, f.forecast, scale, (p.sales - f.forecast) / scale AS score, speed || '|' || f.cat_id AS segment FROM fcn f JOIN pn p ON p.series_id = f.series_id AND p.date = f.date JOIN msn ON msn.series_id = f.series_id JOIN veln ON veln.series_id = f.series_id WHERE method = 'seasonal_naive'")
define("calseg", "SELECT segment, score FROM srn WHERE fold <> 'holdout'")
define("cq_seg", _sqlq("calseg", "segment, ", str(_QS)))
define("cq_pool", _sqlq("calseg", "", str(_QS)))
define("mond", "SELECT segment, q, CASE WHEN s.n >= 500 THEN s.value ELSE a.value END AS value FROM cq_seg s JOIN cq_pool a USING (q)")


def _qs(spark, levels=_QS):
    return spark.createDataFrame([(q,) for q in levels], "q double")


@query("SELECT cat_id, q, round(value, 6) AS value, n FROM cq_cat")
def conformal_quantile(spark, sf):
    s = cal_scores(spark, sf)
    out = un.conformal_quantiles(s, ["cat_id"], s.select("cat_id").distinct().crossJoin(_qs(spark)))
    return out.select("cat_id", "q", r("value", 6).alias("value"), "n")


_BAND = "greatest(forecast + lo{l} * scale, 0) AS lower_{l}, greatest(forecast + hi{l} * scale, 0) AS upper_{l}"
define("ivp", "SELECT h.*, " + ", ".join(_BAND.format(l=x) for x in (80, 95)) + " FROM (SELECT * FROM srows WHERE fold = 'holdout') h CROSS JOIN (SELECT max(CASE WHEN q = 0.025 THEN value END) AS lo95, max(CASE WHEN q = 0.975 THEN value END) AS hi95, max(CASE WHEN q = 0.1 THEN value END) AS lo80, max(CASE WHEN q = 0.9 THEN value END) AS hi80 FROM cq_all)")
define("ivm", "SELECT h.*, " + ", ".join(_BAND.format(l=x) for x in (80, 95)) + " FROM (SELECT * FROM srn WHERE fold = 'holdout') h JOIN (SELECT segment, max(CASE WHEN q = 0.025 THEN value END) AS lo95, max(CASE WHEN q = 0.975 THEN value END) AS hi95, max(CASE WHEN q = 0.1 THEN value END) AS lo80, max(CASE WHEN q = 0.9 THEN value END) AS hi80 FROM mond GROUP BY 1) USING (segment)")


def segment_scores(spark, sf):
    """Scaled errors of the seasonal naive forecast of categories in nations, and their segment: speed (before the folds) and category."""
    panel = retail.panel(spark, sf, retail.NATION)
    f = forecast.with_actuals(forecast.floors(panel, fold_table(spark, sf)).where("method = 'seasonal_naive'"), panel)
    known = panel.crossJoin(F.broadcast(retail.bounds(spark, sf))).where(F.col("date") <= F.date_sub("hi", 112))  # one row
    speed = known.groupBy("series_id").agg(velocity(F.avg("sales")).alias("speed"))
    j = f.join(metrics.mad_scale(panel), "series_id").join(speed, "series_id")
    return j.withColumn("score", (F.col("actual") - F.col("forecast")) / F.col("scale")).withColumn("segment", F.concat_ws("|", "speed", "cat_id"))


def banded(spark, sf, segmented: bool):
    s = segment_scores(spark, sf) if segmented else srows(spark, sf)
    cal, points = s.where("fold <> 'holdout'"), s.where("fold = 'holdout'")
    by = ["segment"] if segmented else []
    q = un.mondrian_quantiles(cal, "segment", _QS) if segmented else un.conformal_quantiles(cal.select("score"), [], _qs(spark))
    for level, tag in ((0.8, "80"), (0.95, "95")):
        points = un.intervals(points, q, by, level).withColumnsRenamed({"lower": f"lower_{tag}", "upper": f"upper_{tag}"})
    return points


_IV = "SELECT series_id, date, forecast, round(lower_80, 4) AS lower_80, round(upper_80, 4) AS upper_80, round(lower_95, 4) AS lower_95, round(upper_95, 4) AS upper_95 FROM "
_BANDS = ("lower_80", "upper_80", "lower_95", "upper_95")


@query(_IV + "ivp")
def conformal_interval(spark, sf):
    return banded(spark, sf, False).select("series_id", "date", "forecast", *(r(c).alias(c) for c in _BANDS))


@query(_IV + "ivm")
def mondrian_interval(spark, sf):
    """Categories in nations, by speed and category; segments with fewer than 500 scores take the pooled quantiles."""
    return banded(spark, sf, True).select("series_id", "date", "forecast", *(r(c).alias(c) for c in _BANDS))


_COV = "SELECT {by} nominal, round(avg(CASE WHEN nominal = 0.8 THEN (actual BETWEEN lower_80 AND upper_80)::INT ELSE (actual BETWEEN lower_95 AND upper_95)::INT END), 6) AS coverage, round(avg(CASE WHEN nominal = 0.8 THEN upper_80 - lower_80 ELSE upper_95 - lower_95 END), 4) AS mean_width, count(*) AS n FROM ivp CROSS JOIN (SELECT unnest([0.8, 0.95])::DOUBLE AS nominal) GROUP BY ALL"


def _coverage(b, by):
    one = lambda level, tag: F.struct(F.lit(level).alias("nominal"), F.col("actual").between(F.col(f"lower_{tag}"), F.col(f"upper_{tag}")).cast("double").alias("hit"), (F.col(f"upper_{tag}") - F.col(f"lower_{tag}")).alias("width"))
    rows = b.select(*by, F.explode(F.array(one(0.8, "80"), one(0.95, "95"))).alias("x"))
    return rows.groupBy(*by, "x.nominal").agg(r(F.avg("x.hit"), 6).alias("coverage"), r(F.avg("x.width")).alias("mean_width"), F.count("*").alias("n"))


@query(_COV.format(by=""))
def interval_coverage(spark, sf):
    return _coverage(banded(spark, sf, False), [])


@query(_COV.format(by="cat_id,"))
def interval_coverage_segment(spark, sf):
    return _coverage(banded(spark, sf, False), ["cat_id"])


_GRID = [0.80, 0.85, 0.90, 0.95, 0.98, 0.99, 0.995, 0.998]
define("ssq", _sqlq("cal_scores", "cat_id, ", str(_GRID)))
define("wkpoint", "SELECT series_id, cat_id, state_id, sum(forecast) AS forecast, any_value(scale) AS scale FROM srows WHERE fold = 'holdout' AND step <= 7 GROUP BY ALL")
define("sst", "SELECT series_id, cat_id, q, forecast, scale, greatest(value * scale, 0) AS safety_stock, forecast + greatest(value * scale, 0) AS order_up_to FROM wkpoint JOIN ssq USING (cat_id)")


def week_points(spark, sf):
    return srows(spark, sf).where("fold = 'holdout' and step <= 7").groupBy("series_id", "cat_id", "state_id").agg(F.sum("forecast").alias("forecast"), F.first("scale").alias("scale"))


def safety(spark, sf):
    s, points = cal_scores(spark, sf), week_points(spark, sf).crossJoin(_qs(spark, _GRID))
    q = un.conformal_quantiles(s, ["cat_id"], points.select("cat_id", "q"))
    return un.safety_stock(points, q, ["cat_id"])


@query("SELECT series_id, q AS service_level, forecast, round(safety_stock, 4) AS safety_stock, round(order_up_to, 4) AS order_up_to FROM sst")
def safety_stock(spark, sf):
    return safety(spark, sf).select("series_id", F.col("q").alias("service_level"), "forecast", r("safety_stock").alias("safety_stock"), r("order_up_to").alias("order_up_to"))


@query("SELECT series_id, q AS service_level, round(1 - (SELECT count(*) FROM cal_scores c WHERE c.cat_id = t.cat_id AND c.score <= t.th) / (SELECT count(*) FROM cal_scores c WHERE c.cat_id = t.cat_id), 6) AS stockout_risk FROM (SELECT *, (round(order_up_to, 3) + 0.0005 - forecast) / scale AS th FROM sst) t")
def stockout_risk(spark, sf):
    """P(demand > stock) at a stock of the target rounded to a thousandth, which lies between scores."""
    points = safety(spark, sf).withColumn("threshold", (F.round("order_up_to", 3) + 0.0005 - F.col("forecast")) / F.col("scale"))
    share = un.share_at_most(cal_scores(spark, sf).select("cat_id", "score"), points, ["cat_id"], ["series_id", "q"])
    return share.select("series_id", F.col("q").alias("service_level"), r(1 - F.col("share"), 6).alias("stockout_risk"))


define("gridq", "SELECT quantile_cont(score, " + str(un.grid(25)) + ") AS quantiles FROM cal_scores")
define("scen", "SELECT p.*, list_transform(quantiles, lambda q: greatest(forecast + scale * q, 0)) AS scenarios FROM wkpoint p CROSS JOIN gridq")


def scen(spark, sf):
    return un.scenarios(week_points(spark, sf), un.score_grid(cal_scores(spark, sf), [], un.SCENARIOS), [])


@query("SELECT series_id, CAST(k AS INTEGER) AS scenario, round(scenarios[k], 4) AS demand FROM scen CROSS JOIN range(1, 26) t(k)")
def demand_scenarios(spark, sf):
    return scen(spark, sf).select("series_id", F.posexplode("scenarios").alias("scenario", "demand")).select("series_id", (F.col("scenario") + 1).alias("scenario"), r("demand").alias("demand"))


@query("SELECT series_id, round(list_avg(list_transform(scenarios, lambda d: least(d, forecast))) / list_avg(scenarios), 6) AS expected_fill FROM scen")
def expected_fill(spark, sf):
    """Of a stock that equals the forecast."""
    return scen(spark, sf).select("series_id", r(un.expected_fill(F.col("forecast")), 6).alias("expected_fill"))


_REV = terms.SQL_DAYS
SHELF_LEAST = 2.0  # units that a shelf shows at least
SUPPLY_RATIO = 0.9  # of the forecast, what there is to allocate
define("mean56", "SELECT series_id, avg(sales) AS m FROM p1 CROSS JOIN bounds WHERE date > hi - 84 AND date <= hi - 28 GROUP BY 1")
define("wsum", f"SELECT fold, series_id, cat_id, {_REV} AS protection_days, (step - 1) // {_REV} AS win, sum(actual) AS actual, sum(forecast) AS forecast FROM srows WHERE (step - 1) // {_REV} < 28 // {_REV} GROUP BY ALL")
define("wscore", "SELECT protection_days, (actual - forecast) / greatest(m * protection_days, 1) AS score FROM wsum JOIN mean56 USING (series_id) WHERE fold <> 'holdout'")
define("abc1", "SELECT series_id, CASE WHEN b / t < 0.8 THEN 'A' WHEN b / t < 0.95 THEN 'B' ELSE 'C' END AS abc FROM (SELECT series_id, coalesce(sum(revenue) OVER (ORDER BY revenue DESC, series_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(revenue) OVER () AS t FROM (SELECT series_id, round(sum(revenue), 2) AS revenue FROM p1 CROSS JOIN bounds WHERE date <= hi - 28 GROUP BY 1))")
define("isq", _sqlq("wscore", "protection_days, ", "[0.98, 0.96, 0.93]"))


@query("SELECT series_id, CAST(protection_days AS INTEGER) AS protection_days, abc, q AS service_level, forecast, round(greatest(value * greatest(m * protection_days, 1), 0), 4) AS safety_stock, CAST(ceil(greatest(forecast + greatest(value * greatest(m * protection_days, 1), 0), 2) - 1e-9) AS DOUBLE) AS order_up_to FROM wsum JOIN mean56 USING (series_id) JOIN abc1 USING (series_id) JOIN isq USING (protection_days) WHERE fold = 'holdout' AND win = 0 AND q = CASE abc WHEN 'A' THEN 0.98 WHEN 'B' THEN 0.96 ELSE 0.93 END")
def item_safety_stock(spark, sf):
    """Stock targets over each series' protection window at its value class's service level, in whole units."""
    days = terms.protection_days()
    rows = srows(spark, sf).withColumn("protection_days", days)
    sums = metrics.window_sums(rows, F.col("protection_days"), 28, ["actual", "forecast"], ["fold", "series_id", "protection_days"])
    p = p1(spark, sf)
    mean = p.crossJoin(F.broadcast(retail.bounds(spark, sf))).where((F.col("date") > F.date_sub("hi", 84)) & (F.col("date") <= F.date_sub("hi", 28))).groupBy("series_id").agg(F.avg("sales").alias("m"))
    known = p.crossJoin(F.broadcast(retail.bounds(spark, sf))).where(F.col("date") <= F.date_sub("hi", 28))
    abc = stockouts.abc_class(known.groupBy("series_id").agg(r(F.sum("revenue"), 2).alias("revenue"))).select("series_id", "abc")
    s = sums.join(mean, "series_id").withColumn("scale", F.greatest(F.col("m") * F.col("protection_days"), F.lit(1.0)))
    scores = s.where("fold <> 'holdout'").withColumn("score", (F.col("actual") - F.col("forecast")) / F.col("scale"))
    target = lookup({"A": 0.98, "B": 0.96}, F.col("abc"), 0.93)
    points = s.where("fold = 'holdout' and window = 0").join(abc, "series_id").withColumn("q", target)
    q = un.conformal_quantiles(scores, ["protection_days"], points.select("protection_days", "q"))
    out = un.safety_stock(points, q, ["protection_days"])
    return out.select("series_id", "protection_days", "abc", F.col("q").alias("service_level"), "forecast", r("safety_stock").alias("safety_stock"), round_to_case(F.greatest("order_up_to", F.lit(SHELF_LEAST))).alias("order_up_to"))


_MARGIN = terms.SQL_MARGIN
define("anodes", f"SELECT s.series_id AS node, s.forecast, scenarios, unit_price * {_MARGIN} AS weight, greatest(h.held + h.allocated - h.actual, 0) AS held FROM scen s JOIN uprice USING (series_id) JOIN pw11 h ON h.node = s.series_id")
define("aprep", "SELECT *, greatest(0.5 * forecast - held, 0) AS flo, held + greatest(0.5 * forecast - held, 0) AS start FROM anodes")
define("aseg", "SELECT node, j, weight * (25 - j + 1) / 25 AS marginal, greatest(s[j] - greatest(start, coalesce(s[j - 1], 0)), 0) AS length FROM (SELECT *, list_sort(scenarios) AS s FROM aprep) CROSS JOIN range(1, 26) t(j)")
define("atake", "SELECT node, sum(greatest(least(budget - before, length), 0)) AS take FROM (SELECT *, coalesce(sum(length) OVER (ORDER BY marginal DESC, node, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT 0.9 * sum(forecast) - sum(flo) FROM aprep) AS budget FROM aseg WHERE length > 0) GROUP BY 1")
define("alp", "SELECT node, forecast, held, scenarios, flo + coalesce(take, 0) AS allocated FROM aprep LEFT JOIN atake USING (node)")


def alloc_nodes(spark, sf):
    return retail.once(spark, sf, ("alloc_nodes",), lambda: _alloc_nodes(spark, sf))


def _alloc_nodes(spark, sf):
    """The holdout's first week; on hand is what the twelve allocated weeks before it leave."""
    p = p1(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf)))
    price = p.where(F.col("date") > F.date_sub("hi", 28)).groupBy("series_id").agg(F.coalesce(F.try_divide(F.sum("revenue"), F.sum("sales")), F.lit(1.0)).alias("unit_price"))
    left = F.greatest(F.col("held") + F.col("allocated") - F.col("actual"), F.lit(0.0))
    held = carried(spark, sf, "pro_rata").where(F.col("week") == WEEKS - 1).select(F.col("node").alias("series_id"), left.alias("held"))
    n = scen(spark, sf).join(price, "series_id").join(held, "series_id")
    return n.select(F.lit("next").alias("run"), F.col("series_id").alias("node"), "forecast", (F.col("unit_price") * terms.margin()).alias("weight"), "held", "scenarios")


def _supply():
    return F.lit(SUPPLY_RATIO) * F.col("t_forecast")


@query("SELECT node, forecast, held, round(allocated, 4) AS allocated, round(list_avg(list_transform(scenarios, lambda d: least(d, allocated + held))) / list_avg(scenarios), 6) AS expected_fill_rate, round(list_avg(list_transform(scenarios, lambda d: (d > allocated + held + 1e-9)::INT)), 6) AS stockout_risk FROM alp")
def allocate_lp(spark, sf):
    out = al.allocate(alloc_nodes(spark, sf), ["run"], _supply(), al.MIN_FILL)
    return out.select("node", "forecast", "held", r("allocated").alias("allocated"), r("expected_fill_rate", 6).alias("expected_fill_rate"), r("stockout_risk", 6).alias("stockout_risk"))


@query("SELECT node, forecast, held, round(greatest(forecast - held, 0) / sum(greatest(forecast - held, 0)) OVER () * least(0.9 * sum(forecast) OVER (), sum(greatest(forecast - held, 0)) OVER ()), 4) AS allocated FROM anodes")
def allocate_pro_rata(spark, sf):
    return al.pro_rata(alloc_nodes(spark, sf), ["run"], _supply()).select("node", "forecast", "held", r("allocated").alias("allocated"))


WEEKS = 4 * retail.BACKTESTS
define("upb", "SELECT series_id, coalesce(sum(revenue) / nullif(sum(sales), 0), 1) AS price FROM p1 CROSS JOIN bounds WHERE date > hi - 140 AND date <= hi - 112 GROUP BY 1")
define("wk0", f"SELECT node, w.week, w.forecast, w.actual, price, price * margin AS weight, list_transform(quantiles, lambda q: greatest(w.forecast + scale * q, 0)) AS scenarios FROM (SELECT series_id AS node, CAST(4 * (ascii(right(fold, 1)) - 49) + (step - 1) // 7 AS INTEGER) AS week, sum(forecast) AS forecast, sum(actual) AS actual, any_value(scale) AS scale, any_value({_MARGIN}) AS margin FROM srows WHERE fold <> 'holdout' GROUP BY ALL) w JOIN upb ON upb.series_id = node CROSS JOIN gridq")
_carry = lambda p, k: f"SELECT w.*, {f'greatest(p.held + p.allocated - p.actual, 0)' if k else '0.0'} AS held FROM wk0 w {f'JOIN {p}{k - 1} p ON p.node = w.node' if k else ''} WHERE w.week = {k}"
for _k in range(WEEKS):
    define(f"pw{_k}", f"SELECT node, week, forecast, actual, price, held, greatest(forecast - held, 0) / sum(greatest(forecast - held, 0)) OVER () * least(0.9 * sum(forecast) OVER (), sum(greatest(forecast - held, 0)) OVER ()) AS allocated FROM ({_carry('pw', _k)})")
    define(f"lprep{_k}", f"SELECT *, greatest(0.5 * forecast - held, 0) AS flo, held + greatest(0.5 * forecast - held, 0) AS start FROM ({_carry('lw', _k)})")
    define(f"lseg{_k}", f"SELECT node, j, weight * (25 - j + 1) / 25 AS marginal, greatest(s[j] - greatest(start, coalesce(s[j - 1], 0)), 0) AS length FROM (SELECT *, list_sort(scenarios) AS s FROM lprep{_k}) CROSS JOIN range(1, 26) t(j)")
    define(f"ltake{_k}", f"SELECT node, sum(greatest(least(budget - before, length), 0)) AS take FROM (SELECT *, coalesce(sum(length) OVER (ORDER BY marginal DESC, node, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT 0.9 * sum(forecast) - sum(flo) FROM lprep{_k}) AS budget FROM lseg{_k} WHERE length > 0) GROUP BY 1")
    define(f"lw{_k}", f"SELECT node, week, forecast, actual, price, held, flo + coalesce(take, 0) AS allocated FROM lprep{_k} LEFT JOIN ltake{_k} USING (node)")
define("pwall", " UNION ALL ".join(f"SELECT * FROM pw{k}" for k in range(WEEKS)))
define("lwall", " UNION ALL ".join(f"SELECT * FROM lw{k}" for k in range(WEEKS)))


def _weeks(spark, sf):
    """The backtests' weeks in order: node, week, forecast, actual, price, weight, scenarios; prices from before the first of them."""
    p = p1(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf)))  # one row
    price = p.where((F.col("date") > F.date_sub("hi", 140)) & (F.col("date") <= F.date_sub("hi", 112))).groupBy("series_id").agg(F.coalesce(F.try_divide(F.sum("revenue"), F.sum("sales")), F.lit(1.0)).alias("price"))
    week = (4 * (F.substring("fold", -1, 1).cast("int") - 1) + F.floor((F.col("step") - 1) / 7)).cast("int")
    rows = cal_scores(spark, sf).groupBy("series_id", "cat_id", week.alias("week")).agg(F.sum("forecast").alias("forecast"), F.sum("actual").alias("actual"), F.first("scale").alias("scale")).join(price, "series_id")
    with_scenarios = un.scenarios(rows, un.score_grid(cal_scores(spark, sf), [], un.SCENARIOS), [])
    return with_scenarios.select(F.col("series_id").alias("node"), "week", "forecast", "actual", "price", (F.col("price") * terms.margin()).alias("weight"), "scenarios")


def _carried(spark, sf, policy: str):
    weeks = retail.once(spark, sf, ("weeks",), lambda: _weeks(spark, sf))
    held, out = None, []
    for k in range(WEEKS):
        now = weeks.where(F.col("week") == k)
        now = now.withColumn("held", F.lit(0.0)) if held is None else now.join(held, "node")
        if policy == "lp":
            done = al.allocate(now, ["week"], _supply(), al.MIN_FILL).select("node", "week", "forecast", "held", "allocated").join(now.select("node", "actual", "price"), "node")
        else:
            done = al.pro_rata(now, ["week"], _supply())
        done = materialised(done.select("node", "week", "forecast", "actual", "price", "held", "allocated"), "week")
        held = done.select("node", F.greatest(F.col("held") + F.col("allocated") - F.col("actual"), F.lit(0.0)).alias("held"))
        out.append(done)
    return reduce(lambda a, b: a.unionByName(b), out)


def carried(spark, sf, policy: str):
    """The backtests' weeks of allocation, unsold stock carried from week to week: node, week, forecast, actual, price, held, allocated."""
    return retail.once(spark, sf, ("carried", policy), lambda: _carried(spark, sf, policy))


@query("SELECT week, round(sum(allocated), 4) AS allocated, round(sum(least(actual, held + allocated)) / nullif(sum(actual), 0), 6) AS fill_rate, sum(actual) AS demand FROM pwall GROUP BY 1")
def allocation_backtest_pro_rata(spark, sf):
    c = carried(spark, sf, "pro_rata")
    return c.groupBy("week").agg(r(F.sum("allocated")).alias("allocated"), r(F.try_divide(F.sum(F.least(F.col("actual"), F.col("held") + F.col("allocated"))), F.sum("actual")), 6).alias("fill_rate"), F.sum("actual").alias("demand"))


@query("SELECT week, round(sum(allocated), 4) AS allocated, round(sum(least(actual, held + allocated)) / nullif(sum(actual), 0), 6) AS fill_rate, sum(actual) AS demand FROM lwall GROUP BY 1")
def allocation_backtest_lp(spark, sf):
    c = carried(spark, sf, "lp")
    return c.groupBy("week").agg(r(F.sum("allocated")).alias("allocated"), r(F.try_divide(F.sum(F.least(F.col("actual"), F.col("held") + F.col("allocated"))), F.sum("actual")), 6).alias("fill_rate"), F.sum("actual").alias("demand"))


@query("SELECT node, week, round(least(actual, held + allocated) / nullif(actual, 0), 6) AS fill_rate FROM pwall")
def allocation_node_fill(spark, sf):
    return carried(spark, sf, "pro_rata").select("node", "week", r(F.try_divide(F.least(F.col("actual"), F.col("held") + F.col("allocated")), F.col("actual")), 6).alias("fill_rate"))


@query("SELECT node, max(n)::BIGINT AS longest_short_run FROM (SELECT node, island, count(*) AS n FROM (SELECT *, week - row_number() OVER (PARTITION BY node ORDER BY week) AS island FROM (SELECT node, week FROM pwall WHERE least(actual, held + allocated) / nullif(actual, 0) < 0.5 - 1e-9)) GROUP BY ALL) GROUP BY 1 HAVING max(n) > 2")
def fairness_runs(spark, sf):
    fill = carried(spark, sf, "pro_rata").select("node", F.col("week").alias("period"), F.try_divide(F.least(F.col("actual"), F.col("held") + F.col("allocated")), F.col("actual")).alias("fill_rate"))
    return al.longest_short_runs(fill, 0.5, 2)


define("ords", "SELECT cat_id AS product, w.series_id AS row, w.forecast AS quantity, 0.7 * sum(w.forecast) OVER (PARTITION BY cat_id) AS available, held / greatest(w.forecast / 7, 0.001) AS cover, unit_price AS value FROM wkpoint w JOIN (SELECT node AS series_id, held FROM anodes) USING (series_id) JOIN uprice USING (series_id)")


def orders(spark, sf):
    p = p1(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf)))
    price = p.where(F.col("date") > F.date_sub("hi", 28)).groupBy("series_id").agg(F.coalesce(F.try_divide(F.sum("revenue"), F.sum("sales")), F.lit(1.0)).alias("value"))
    held = alloc_nodes(spark, sf).select(F.col("node").alias("series_id"), "held")
    points = week_points(spark, sf)
    there = points.groupBy("cat_id").agg((0.7 * F.sum("forecast")).alias("available"))
    o = points.join(price, "series_id").join(held, "series_id").join(there, "cat_id")
    return o.select(F.col("cat_id").alias("product"), F.col("series_id").alias("row"), F.col("forecast").alias("quantity"), "available", (F.col("held") / F.greatest(F.col("forecast") / 7, F.lit(0.001))).alias("cover"), "value")


@query("SELECT product, row, quantity, round(quantity * least(coalesce(available / nullif(sum(quantity) OVER (PARTITION BY product), 0), 1), 1), 4) AS shipped FROM ords")
def ration_proportional(spark, sf):
    return al.ration(orders(spark, sf), "proportional").select("product", "row", "quantity", r("shipped").alias("shipped"))


_RATION = "SELECT product, row, quantity, round(greatest(least(quantity, available - coalesce(sum(quantity) OVER (PARTITION BY product ORDER BY {key}, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0), 4) AS shipped FROM ords"


@query(_RATION.format(key="cover"))
def ration_cover(spark, sf):
    return al.ration(orders(spark, sf), "days_of_cover").select("product", "row", "quantity", r("shipped").alias("shipped"))


@query(_RATION.format(key="value DESC"))
def ration_value(spark, sf):
    return al.ration(orders(spark, sf), "value").select("product", "row", "quantity", r("shipped").alias("shipped"))


define("hold", f"SELECT series_id, cat_id, step, forecast, {_REV} AS cover FROM srows WHERE fold = 'holdout'")


@query("SELECT a.series_id, a.step, CAST(a.cover AS INTEGER) AS cover, round(coalesce((SELECT sum(b.forecast) FROM hold b WHERE b.series_id = a.series_id AND b.step > a.step AND b.step <= a.step + a.cover), 0) + greatest(a.step + a.cover - 28, 0) * (SELECT avg(b.forecast) FROM hold b WHERE b.series_id = a.series_id AND b.step > 21), 4) AS target FROM hold a")
def cover_targets(spark, sf):
    h = srows(spark, sf).where("fold = 'holdout'").select("series_id", "step", "forecast", (terms.protection_days()).alias("cover"))
    return al.cover_targets(h).withColumn("target", r("target"))


@query(f"SELECT cat_id AS product, round(sqrt(sum((greatest(safety_stock, 0) * sqrt(14.0 / {_REV})) ** 2) + (1.65 * sum(forecast / 7)) ** 2), 4) AS dc_safety FROM sst WHERE q = 0.95 GROUP BY cat_id")
def dc_safety(spark, sf):
    cover = terms.protection_days()
    rows = safety(spark, sf).where("q = 0.95").select(F.col("cat_id").alias("product"), F.col("safety_stock").alias("safety"), cover.alias("cover"), (F.col("forecast") / 7).alias("mean_daily"))
    return al.dc_safety(rows, 14).withColumn("dc_safety", r("dc_safety"))


_U = "CAST(('0x' || substr(md5({k}), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0"
define("draws", f"SELECT rep, block, CAST(floor({_U.format(k=chr(39) + '7|' + chr(39) + ' || rep || ' + chr(39) + '|' + chr(39) + ' || block')} * 12) AS INTEGER) AS pick FROM range(0, 20) t(rep) CROSS JOIN range(0, 4) u(block)")
define("pastw", "SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY fold, win) - 1 AS INTEGER) AS pick, actual, forecast FROM (SELECT fold, series_id, (step - 1) // 7 AS win, sum(actual) AS actual, sum(forecast) AS forecast FROM srows WHERE fold <> 'holdout' GROUP BY ALL)")
define("nowf", "SELECT series_id, (step - 1) // 7 AS block, sum(forecast) AS forecast FROM srows WHERE fold = 'holdout' GROUP BY ALL")


@query("SELECT CAST(rep AS INTEGER) AS rep, CAST(d.block AS INTEGER) AS block, n.series_id, d.pick, round(p.actual * least(greatest((n.forecast + 0.5) / (p.forecast + 0.5), 0.25), 4.0), 4) AS demand FROM draws d JOIN nowf n ON n.block = d.block JOIN pastw p ON p.series_id = n.series_id AND p.pick = d.pick")
def demand_bootstrap(spark, sf):
    """Futures made of past weeks, the same week for every series of a replication, scaled by forecast now over forecast then."""
    weeks = srows(spark, sf).groupBy("fold", "series_id", F.floor((F.col("step") - 1) / 7).cast("int").alias("block")).agg(F.sum("actual").alias("actual"), F.sum("forecast").alias("forecast"))
    past = weeks.where("fold <> 'holdout'").select("series_id", (F.row_number().over(W.partitionBy("series_id").orderBy("fold", "block")) - 1).alias("pick"), "actual", F.col("forecast").alias("then"))
    now = weeks.where("fold = 'holdout'").select("series_id", "block", "forecast")
    draws = spark.range(20).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("block")).withColumn("pick", F.floor(uniform(7, F.col("rep"), F.col("block")) * 12).cast("int"))
    ratio = F.least(F.greatest((F.col("forecast") + 0.5) / (F.col("then") + 0.5), F.lit(0.25)), F.lit(4.0))
    return now.join(F.broadcast(draws), "block").join(past, ["series_id", "pick"]).select("rep", "block", "series_id", "pick", r(F.col("actual") * ratio).alias("demand"))  # a row for each replication and week


define("fpage", "SELECT fold, series_id, date, forecast FROM fc1 WHERE method = 'seasonal_naive' AND fold = 'holdout'")


@query("SELECT * FROM fpage ORDER BY series_id, date LIMIT 100 OFFSET 200")
def page_forecasts(spark, sf):
    """The third page of a hundred rows."""
    from ..plans.serve import page

    f = forecast.floors(p1(spark, sf), fold_table(spark, sf)).where("method = 'seasonal_naive' and fold = 'holdout'").select("fold", "series_id", "date", "forecast")
    return page(f, {}, ["series_id", "date"], 100, 200)[0]


@query("SELECT user_id, event_id, n::BIGINT AS n, n > 2 AS limited FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events)")
def rate_limited_requests(spark, sf):
    """Requests of the last hour by user, and those beyond two."""
    e = retail.table(spark, sf, "events")
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3600 * 1000000, 0)
    n = F.count("*").over(w)
    return e.select("user_id", "event_id", n.alias("n"), (n > 2).alias("limited"))
