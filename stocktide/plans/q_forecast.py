"""Forecast floors, metrics, drift and reconciliation as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import bias, r, wmape
from ..operators import drift, forecast, metrics, reconcile
from ..sources import retail
from ..sources.store import shared_folder
from ..sources.retail import P1
from . import terms
from .q_panel import p2
from .registry import define, query

FOLDS = retail.folds()

define("foldt", "SELECT fold, hi - back AS origin FROM bounds CROSS JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in FOLDS.items()) + ") t(fold, back)")
_FLOORS = """SELECT o.fold, s.*, h::INTEGER AS step, CAST(o.origin + h::INTEGER AS DATE) AS date, m.method, CASE m.method WHEN 'naive' THEN n.sales ELSE w.sales END AS forecast
FROM foldt o CROSS JOIN (SELECT DISTINCT {keys} FROM {panel}) s CROSS JOIN range(1, 29) t(h) CROSS JOIN (VALUES ('naive'), ('seasonal_naive')) m(method)
JOIN {panel} n ON n.series_id = s.series_id AND n.date = o.origin JOIN {panel} w ON w.series_id = s.series_id AND w.date = o.origin - 6 + CAST((h - 1) % 7 AS INTEGER)"""
define("fc1", _FLOORS.format(keys="series_id, cat_id, state_id", panel="p1"))
define("fca", "SELECT f.*, p.sales AS actual FROM fc1 f JOIN p1 p ON p.series_id = f.series_id AND p.date = f.date")
define("fc2", _FLOORS.format(keys="series_id, dept_id, cat_id, state_id", panel="p2"))


def p1(spark, sf):
    return retail.panel(spark, sf, P1)


def fold_table(spark, sf):
    return forecast.origins(retail.bounds(spark, sf), FOLDS)


def fc1(spark, sf):
    return forecast.floors(p1(spark, sf), fold_table(spark, sf))


def fca(spark, sf):
    return forecast.with_actuals(fc1(spark, sf), p1(spark, sf))


@query("SELECT fold, series_id, step, date, forecast FROM fc1 WHERE method = 'naive'")
def naive_forecast(spark, sf):
    return fc1(spark, sf).where("method = 'naive'").select("fold", "series_id", "step", "date", "forecast")


@query("SELECT fold, series_id, step, date, forecast FROM fc1 WHERE method = 'seasonal_naive'")
def seasonal_naive(spark, sf):
    return fc1(spark, sf).where("method = 'seasonal_naive'").select("fold", "series_id", "step", "date", "forecast")


@query("SELECT f.fold, f.series_id, p.date, p.sales AS actual, round(avg(h.sales), 6) AS forecast FROM foldt f0 JOIN (SELECT fold, origin, series_id FROM foldt CROSS JOIN (SELECT DISTINCT series_id FROM p1)) f ON f.fold = f0.fold JOIN p1 p ON p.series_id = f.series_id AND p.date > f.origin AND p.date <= f.origin + 28 JOIN p1 h ON h.series_id = f.series_id AND h.date <= f.origin AND h.date > f.origin - 28 GROUP BY ALL")
def rolling_origin(spark, sf):
    """A caller's model, the mean of the last 28 days, evaluated at every fold."""

    def mean28(seen, folds):
        last = seen.where(F.col("date") > F.date_sub("origin", 28)).groupBy("fold", "origin", "series_id").agg(F.avg("sales").alias("forecast"))
        return last.select("fold", "series_id", F.explode(F.sequence(F.date_add("origin", 1), F.date_add("origin", 28))).alias("date"), "forecast")

    return forecast.rolling_origin(p1(spark, sf), fold_table(spark, sf), mean28).select("fold", "series_id", "date", "actual", r("forecast", 6).alias("forecast"))


_WM = "round(coalesce(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0), 0), 6) AS wmape"
_BIAS = "round(coalesce(sum(forecast - actual) / nullif(sum(abs(actual)), 0), 0), 6) AS bias"


@query(f"SELECT method, cat_id, {_WM}, round(coalesce(avg(CASE WHEN actual <> 0 THEN abs((actual - forecast) / actual) END), 0), 6) AS mape, round(avg(greatest(0.5 * (actual - forecast), -0.5 * (actual - forecast))), 6) AS pinball, {_BIAS}, count(*) AS n FROM fca GROUP BY ALL")
def scorecard(spark, sf):
    s = metrics.scorecard(fca(spark, sf), ["method", "cat_id"])
    return s.select("method", "cat_id", *(r(c, 6).alias(c) for c in ("wmape", "mape", "pinball", "bias")), "n")


_LEVELS1 = {"series": ["cat_id", "state_id"], "category": ["cat_id"], "state": ["state_id"], "total": []}
define("lev", "SELECT fold, method, date, CASE WHEN grouping(cat_id) + grouping(state_id) = 0 THEN 'series' WHEN grouping(state_id) = 1 AND grouping(cat_id) = 0 THEN 'category' WHEN grouping(cat_id) = 1 AND grouping(state_id) = 0 THEN 'state' ELSE 'total' END AS level, cat_id, state_id, sum(forecast) AS forecast, sum(actual) AS actual FROM fca GROUP BY GROUPING SETS ((fold, method, date, cat_id, state_id), (fold, method, date, cat_id), (fold, method, date, state_id), (fold, method, date))")


def levels(spark, sf):
    by = ["fold", "method", "date"]
    g = fca(spark, sf).groupingSets([[*by, *v] for v in _LEVELS1.values()], *by, "cat_id", "state_id").agg(F.grouping("cat_id").alias("gc"), F.grouping("state_id").alias("gs"), F.sum("forecast").alias("forecast"), F.sum("actual").alias("actual"))
    level = F.when((F.col("gc") == 0) & (F.col("gs") == 0), "series").when(F.col("gc") == 0, "category").when(F.col("gs") == 0, "state").otherwise("total")
    return g.withColumn("level", level).drop("gc", "gs")


@query(f"SELECT fold, method, level, {_WM}, {_BIAS}, count(*) AS n FROM lev GROUP BY ALL")
def level_metrics(spark, sf):
    return levels(spark, sf).groupBy("fold", "method", "level").agg(r(wmape("actual", "forecast"), 6).alias("wmape"), r(bias("actual", "forecast"), 6).alias("bias"), F.count("*").alias("n"))


define("nscale", "SELECT series_id, avg(step * step) AS scale FROM (SELECT series_id, max(sales) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) > 0 AS started, lead(sales) OVER (PARTITION BY series_id ORDER BY date) - sales AS step FROM p1) WHERE started AND step IS NOT NULL GROUP BY 1")


@query("SELECT series_id, round(scale, 4) AS scale FROM nscale")
def naive_scale(spark, sf):
    return metrics.naive_scale(p1(spark, sf)).select("series_id", r("scale").alias("scale"))


define("mscale", "SELECT series_id, greatest(avg(change), 0.1) AS scale FROM (SELECT series_id, date, abs(sales - lag(sales, 7) OVER (PARTITION BY series_id ORDER BY date)) AS change FROM p2) CROSS JOIN bounds WHERE date > hi - 56 GROUP BY 1")


@query("SELECT series_id, round(scale, 4) AS scale FROM mscale")
def mad_scale(spark, sf):
    return metrics.mad_scale(p2(spark, sf)).select("series_id", r("scale").alias("scale"))


define("wts", "SELECT series_id, sum(revenue) AS weight FROM p1 CROSS JOIN bounds WHERE date > hi - 140 AND date <= hi - 112 GROUP BY 1")
define("wr", "SELECT fold, method, round(sum(weight * sqrt(mse / scale)) / sum(weight), 6) AS wrmsse FROM (SELECT fold, method, series_id, avg((actual - forecast) ** 2) AS mse FROM fca GROUP BY ALL) JOIN nscale USING (series_id) JOIN wts USING (series_id) WHERE scale > 0 GROUP BY ALL")


def wr(spark, sf):
    p = p1(spark, sf)
    weights = p.crossJoin(F.broadcast(retail.bounds(spark, sf))).where((F.col("date") > F.date_sub("hi", 140)) & (F.col("date") <= F.date_sub("hi", 112))).groupBy("series_id").agg(F.sum("revenue").alias("weight"))
    return metrics.wrmsse(fca(spark, sf), metrics.naive_scale(p), weights, ["fold", "method"])


@query("SELECT fold, method, wrmsse FROM wr")
def wrmsse(spark, sf):
    return wr(spark, sf).withColumn("wrmsse", r("wrmsse", 6))


@query("SELECT fold, method, series_id, (step - 1) // 5 AS \"window\", sum(actual) AS actual, sum(forecast) AS forecast FROM fca WHERE (step - 1) // 5 < 5 GROUP BY ALL")
def window_sums(spark, sf):
    return metrics.window_sums(fca(spark, sf), 5, 28, ["actual", "forecast"], ["fold", "method", "series_id"])


define("dacc", f"SELECT fold, method, {terms.SQL_DAYS} AS window_days, cat_id, series_id, (step - 1) // {terms.SQL_DAYS} AS win, sum(actual) AS actual, sum(forecast) AS forecast FROM fca WHERE (step - 1) // {terms.SQL_DAYS} < 28 // {terms.SQL_DAYS} GROUP BY ALL")


@query("SELECT fold, method, CAST(window_days AS INTEGER) AS window_days, cat_id, velocity, round(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0), 6) AS wmape, round(sum(forecast - actual) / nullif(sum(abs(actual)), 0), 6) AS bias, sum(actual) AS units FROM dacc JOIN (SELECT series_id, CASE WHEN avg(sales) >= 2 THEN 'fast' WHEN avg(sales) >= 0.5 THEN 'medium' WHEN avg(sales) >= 0.1 THEN 'slow' ELSE 'sporadic' END AS velocity FROM p1 CROSS JOIN bounds WHERE date <= hi - 112 GROUP BY 1) USING (series_id) GROUP BY ALL")
def decision_accuracy(spark, sf):
    from ..functions.exprs import velocity

    rows = fca(spark, sf).withColumn("window_days", terms.protection_days())
    sums = metrics.window_sums(rows, F.col("window_days"), 28, ["actual", "forecast"], ["fold", "method", "window_days", "cat_id", "series_id"])
    known = p1(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf))).where(F.col("date") <= F.date_sub("hi", 112))  # before the first fold
    speed = known.groupBy("series_id").agg(velocity(F.avg("sales")).alias("velocity"))
    out = metrics.wmape_bias(sums.join(speed, "series_id"), ["fold", "method", "window_days", "cat_id", "velocity"])
    return out.withColumns({"wmape": r("wmape", 6), "bias": r("bias", 6)})


@query(f"SELECT fold, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(date)] AS weekday, {_BIAS} FROM fca WHERE method = 'seasonal_naive' GROUP BY ALL")
def weekday_bias(spark, sf):
    return fca(spark, sf).where("method = 'seasonal_naive'").groupBy("fold", F.date_format("date", "E").alias("weekday")).agg(r(bias("actual", "forecast"), 6).alias("bias"))


@query(f"SELECT fold, method, CASE WHEN event_name IS NULL THEN 'normal' ELSE 'event' END AS kind, {_WM}, {_BIAS}, count(*) AS n FROM fca JOIN cal USING (date) GROUP BY ALL")
def event_accuracy(spark, sf):
    j = fca(spark, sf).join(F.broadcast(retail.calendar(spark, sf).select("date", "event_name")), "date")
    return j.groupBy("fold", "method", F.when(F.col("event_name").isNull(), "normal").otherwise("event").alias("kind")).agg(r(wmape("actual", "forecast"), 6).alias("wmape"), r(bias("actual", "forecast"), 6).alias("bias"), F.count("*").alias("n"))


define("wk", "SELECT fold, method, series_id, (step - 1) // 7 AS win, sum(actual) AS actual, sum(forecast) AS forecast FROM fca GROUP BY ALL")
define("sig", "SELECT method, series_id, coalesce(CASE WHEN stddev_samp(actual - forecast) > 0 THEN avg(actual - forecast) * sqrt(count(*)) / stddev_samp(actual - forecast) ELSE 0 END, 0) AS tracking_signal, avg(actual - forecast) AS per_week, avg(actual) AS ma, avg(forecast) AS mf FROM wk WHERE fold <> 'holdout' GROUP BY ALL")
define("uprice", "SELECT series_id, coalesce(sum(revenue) / nullif(sum(sales), 0), 1) AS unit_price FROM p1 CROSS JOIN bounds WHERE date > hi - 28 GROUP BY 1")


def weeks(spark, sf):
    return metrics.window_sums(fca(spark, sf), 7, 28, ["actual", "forecast"], ["fold", "method", "series_id"])


def signals(spark, sf):
    return metrics.tracking_signal(weeks(spark, sf).where("fold <> 'holdout'"), ["method", "series_id"])


@query("SELECT method, series_id, round(tracking_signal, 4) AS tracking_signal, round(per_week, 4) AS per_week FROM sig")
def tracking_signal(spark, sf):
    return signals(spark, sf).select("method", "series_id", r("tracking_signal").alias("tracking_signal"), r("per_week").alias("per_week"))


@query("SELECT series_id, round(tracking_signal, 4) AS tracking_signal, round(-per_week, 4) AS bias_units_per_week, CASE WHEN tracking_signal > 0 THEN 'under-forecast' ELSE 'over-forecast' END AS direction, round(abs(per_week) * unit_price, 2) AS weekly_impact FROM sig JOIN uprice USING (series_id) WHERE method = 'seasonal_naive' AND abs(tracking_signal) > 4 ORDER BY abs(per_week) * unit_price DESC, series_id LIMIT 200")
def bias_exceptions(spark, sf):
    """A report of 200 rows at most. The test series are stationary, so it can be empty there; planted biases are in the tests."""
    price = p1(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf))).where(F.col("date") > F.date_sub("hi", 28)).groupBy("series_id").agg(F.coalesce(F.try_divide(F.sum("revenue"), F.sum("sales")), F.lit(1.0)).alias("unit_price"))
    out = metrics.bias_exceptions(signals(spark, sf).where("method = 'seasonal_naive'"), price)
    return out.withColumns({"tracking_signal": r("tracking_signal"), "bias_units_per_week": r("bias_units_per_week"), "weekly_impact": r("weekly_impact", 2)})


define("corr", "SELECT series_id, abs(tracking_signal) > 4 AS flagged, CASE WHEN abs(tracking_signal) > 4 THEN least(greatest(1 + 0.5 * (CASE WHEN mf > 0 THEN ma / mf ELSE 1 END - 1), 0.6), 1.6) ELSE 1 END AS multiplier FROM sig WHERE method = 'naive'")


@query("SELECT series_id, flagged, round(multiplier, 6) AS multiplier FROM corr")
def bias_correction(spark, sf):
    return metrics.bias_correction(signals(spark, sf).where("method = 'naive'")).withColumn("multiplier", r("multiplier", 6))


@query("SELECT scope, round(sum(abs(actual - forecast)) / sum(actual), 6) AS base_wmape, round(sum(abs(actual - forecast * multiplier)) / sum(actual), 6) AS adjusted_wmape, count(*) AS n, round(sum(abs(actual - forecast)) / sum(actual) - sum(abs(actual - forecast * multiplier)) / sum(actual), 6) AS fva FROM fca JOIN corr USING (series_id) CROSS JOIN (VALUES ('all'), ('flagged')) t(scope) WHERE method = 'naive' AND fold = 'holdout' AND (scope = 'all' OR flagged) GROUP BY 1")
def forecast_value_added(spark, sf):
    c = metrics.bias_correction(signals(spark, sf).where("method = 'naive'"))
    rows = fca(spark, sf).where("method = 'naive' and fold = 'holdout'").join(c, "series_id").withColumn("adjusted", F.col("forecast") * F.col("multiplier"))
    scoped = rows.withColumn("scope", F.explode(F.when(F.col("flagged"), F.array(F.lit("all"), F.lit("flagged"))).otherwise(F.array(F.lit("all")))))
    return metrics.value_added(scoped, ["scope"]).select("scope", r("base_wmape", 6).alias("base_wmape"), r("adjusted_wmape", 6).alias("adjusted_wmape"), "n", r("fva", 6).alias("fva"))


_WEEKS = {f"week_{k}": 28 + 7 * (4 - k) for k in range(5)}
define("runt", "SELECT fold, hi - back AS origin, k FROM bounds CROSS JOIN (VALUES " + ", ".join(f"('{n}', {v}, {i})" for i, (n, v) in enumerate(_WEEKS.items())) + ") t(fold, back, k)")
define("runs", "SELECT o.fold, o.k, s.series_id, h::INTEGER AS step, CAST(o.origin + h::INTEGER AS DATE) AS date, w.sales AS forecast, a.sales AS actual FROM runt o CROSS JOIN (SELECT DISTINCT series_id FROM p1) s CROSS JOIN range(1, 29) t(h) JOIN p1 w ON w.series_id = s.series_id AND w.date = o.origin - 6 + CAST((h - 1) % 7 AS INTEGER) JOIN p1 a ON a.series_id = s.series_id AND a.date = o.origin + h::INTEGER")


def weekly_runs(spark, sf, weeks=_WEEKS):
    runs = forecast.origins(retail.bounds(spark, sf), weeks)
    f = forecast.floors(p1(spark, sf), runs).where("method = 'seasonal_naive'").drop("method")
    return forecast.with_actuals(f, p1(spark, sf)).withColumn("k", F.substring_index("fold", "_", -1).cast("int"))


def _stability(runs):
    old = runs.select("series_id", "date", (F.col("k") + 1).alias("k"), "forecast")
    return metrics.stability(old, runs, ["series_id", "date", "k"], ["fold"]).select("fold", r("stability", 6).alias("stability"))


@query("SELECT a.fold, round(sum(abs(b.forecast - a.forecast)) / sum(abs(b.forecast)), 6) AS stability FROM runs a JOIN runs b ON b.series_id = a.series_id AND b.date = a.date AND b.k = a.k - 1 GROUP BY 1")
def stability(spark, sf):
    return _stability(weekly_runs(spark, sf))


define("stab", "SELECT a.fold, sum(abs(b.forecast - a.forecast)) / sum(abs(b.forecast)) AS st FROM runs a JOIN runs b ON b.series_id = a.series_id AND b.date = a.date AND b.k = a.k - 1 GROUP BY 1")


@query("SELECT fold, round(sum(CASE WHEN step <= 7 THEN abs(actual - forecast) END) / sum(CASE WHEN step <= 7 THEN actual END), 6) AS next_week_wmape, round(sum(abs(actual - forecast)) / sum(actual), 6) AS four_week_wmape, round(sum(forecast - actual) / sum(actual), 6) AS four_week_bias, round(any_value(st), 6) AS stability FROM runs LEFT JOIN stab USING (fold) GROUP BY 1")
def planning_cycle(spark, sf):
    """A row for each weekly re-run of the forecast."""
    return replay(spark, sf)


def replay(spark, sf, weeks: int = len(_WEEKS)):
    """The floor made anew at each of the last `weeks` weekly origins that have four weeks after them: its errors and how far it moved."""
    runs = weekly_runs(spark, sf, {f"week_{k}": retail.HORIZON + 7 * (weeks - 1 - k) for k in range(weeks)})
    near = lambda c: F.sum(F.when(F.col("step") <= 7, c))
    g = runs.groupBy("fold").agg(r(near(F.abs(F.col("actual") - F.col("forecast"))) / near(F.col("actual")), 6).alias("next_week_wmape"), r(wmape("actual", "forecast"), 6).alias("four_week_wmape"), r(bias("actual", "forecast"), 6).alias("four_week_bias"))
    return g.join(_stability(runs), "fold", "left")


define("drx", "SELECT state_id, date > hi - 28 AS recent, ln(1 + sales) AS x FROM p1 CROSS JOIN bounds")
define("dre", "SELECT state_id, fold = 'holdout' AS recent, actual - forecast AS x FROM fca WHERE method = 'seasonal_naive'")
_PSI = "SELECT state_id, CASE WHEN max(na) > 0 AND max(ne) > 0 THEN sum((a - e) * ln(a / e)) ELSE 0 END AS psi FROM (SELECT state_id, na, ne, greatest(ca / na, 1e-6) AS a, greatest(ce / ne, 1e-6) AS e FROM (SELECT state_id, bin, sum(recent::INT) AS ca, sum((NOT recent)::INT) AS ce, sum(sum(recent::INT)) OVER (PARTITION BY state_id) AS na, sum(sum((NOT recent)::INT)) OVER (PARTITION BY state_id) AS ne FROM (SELECT v.state_id, recent, len(list_filter(list_distinct(q), lambda e: e <= x)) AS bin FROM {v} v JOIN (SELECT state_id, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM {v} WHERE NOT recent GROUP BY 1) qq USING (state_id)) GROUP BY state_id, bin)) GROUP BY 1"
define("psid", _PSI.format(v="drx"))
define("psie", _PSI.format(v="dre"))


def drift_values(spark, sf):
    demand = p1(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf))).select("state_id", (F.col("date") > F.date_sub("hi", 28)).alias("recent"), F.log1p("sales").alias("x"))
    residual = fca(spark, sf).where("method = 'seasonal_naive'").select("state_id", (F.col("fold") == "holdout").alias("recent"), (F.col("actual") - F.col("forecast")).alias("x"))
    return demand, residual


@query("SELECT state_id, round(psi, 4) AS psi FROM psid")
def psi_by_store(spark, sf):
    return drift.psi(drift_values(spark, sf)[0], ["state_id"]).select("state_id", r("psi").alias("psi"))


@query("SELECT state_id, round(d.psi, 4) AS demand_psi, round(e.psi, 4) AS residual_psi, round(greatest(d.psi, e.psi), 4) AS psi, greatest(d.psi, e.psi) >= 0.2 AS drift, round(m.a, 4) AS reference_mean, round(m.b, 4) AS recent_mean FROM psid d JOIN psie e USING (state_id) JOIN (SELECT state_id, avg(CASE WHEN NOT recent THEN exp(x) - 1 END) AS a, avg(CASE WHEN recent THEN exp(x) - 1 END) AS b FROM drx GROUP BY 1) m USING (state_id)")
def drift_table(spark, sf):
    t = drift.drift_table(*drift_values(spark, sf), ["state_id"])
    return t.select("state_id", *(r(c).alias(c) for c in ("demand_psi", "residual_psi", "psi", "reference_mean", "recent_mean")), "drift")


_TOTAL_ERROR = "sum(CASE WHEN fold {f} 'holdout' THEN abs(actual - forecast) END) / sum(CASE WHEN fold {f} 'holdout' THEN actual END)"
@query()
def drift_sketches(spark, sf):
    """PSI of the states' demand from a table of day sketches: the last four weeks against all days before, and against the four weeks before."""
    import uuid

    path = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    drift.add_sketches(p1(spark, sf).select("state_id", "date", F.log1p("sales").alias("x")), path, ["state_id"])
    s = spark.read.parquet(path).crossJoin(F.broadcast(retail.bounds(spark, sf)))  # one row
    ago = F.datediff("hi", "date")
    all_before = drift.psi_of_sketches(s, ["state_id"], ago >= 28, ago < 28).withColumnRenamed("psi", "psi_all")
    month = drift.psi_of_sketches(s, ["state_id"], (ago >= 28) & (ago < 56), ago < 28).withColumnRenamed("psi", "psi_month")
    return all_before.join(month, "state_id").select("state_id", r("psi_all").alias("psi_all"), r("psi_month").alias("psi_month"))


define("decay", f"SELECT now / before - 1 AS decay FROM (SELECT {_TOTAL_ERROR.format(f='=')} AS now, {_TOTAL_ERROR.format(f='<>')} AS before FROM fca WHERE method = 'seasonal_naive')")


@query("SELECT reasons <> '' AS retrain, round(decay, 4) AS wmape_decay, CASE WHEN reasons = '' THEN 'stable' ELSE reasons END AS reasons FROM (SELECT decay, concat_ws('; ', CASE WHEN n > 0 THEN 'PSI >= 0.2 for ' || n || ' node(s): ' || names END, CASE WHEN decay > 0.1 THEN 'WMAPE is worse than before by over 0.1 of it' END) AS reasons FROM decay CROSS JOIN (SELECT count(*) AS n, string_agg(state_id, ', ' ORDER BY state_id) AS names FROM psid WHERE psi >= 0.2))")
def retrain_flag(spark, sf):
    """Drift of the states' demand, and the holdout's error against the backtests'."""
    f = fca(spark, sf).where("method = 'seasonal_naive'")
    part = lambda now: F.try_divide(F.sum(F.when((F.col("fold") == "holdout") == now, F.abs(F.col("actual") - F.col("forecast")))), F.sum(F.when((F.col("fold") == "holdout") == now, F.col("actual"))))
    decay = f.agg(part(True).alias("recent"), part(False).alias("reference"))
    return drift.retrain_flag(drift.psi(drift_values(spark, sf)[0], ["state_id"]), "state_id", decay).withColumn("wmape_decay", r("wmape_decay"))


@query("SELECT arg_min(method, w) AS method, round(min(w), 6) AS wmape FROM (SELECT method, avg(w) AS w FROM (SELECT fold, method, sum(abs(actual - forecast)) / sum(actual) AS w FROM fca WHERE fold LIKE 'backtest%' GROUP BY ALL) GROUP BY 1)")
def model_select(spark, sf):
    """The method with the least mean error over the backtests; the holdout has no say."""
    e = fca(spark, sf).where("fold like 'backtest%'").groupBy("fold", "method").agg(wmape("actual", "forecast").alias("w")).groupBy("method").agg(F.avg("w").alias("w"))
    return e.agg(F.min_by("method", F.struct("w", "method")).alias("method"), r(F.min("w"), 6).alias("wmape"))


@query("SELECT series_id, round(coalesce(sum(revenue) / nullif(sum(sales), 0), 1), 4) AS unit_price FROM p2 CROSS JOIN bounds WHERE date > hi - 28 GROUP BY 1")
def dept_prices(spark, sf):
    """What a unit of each department cost in the last four weeks, 1 where nothing was sold."""
    p = p2(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf))).where(F.col("date") > F.date_sub("hi", 28))
    return p.groupBy("series_id").agg(r(F.coalesce(F.try_divide(F.sum("revenue"), F.sum("sales")), F.lit(1.0))).alias("unit_price"))


@query(f"SELECT DISTINCT cat_id, {terms.SQL_MARGIN}::DOUBLE AS margin FROM fact")
def margin_weights(spark, sf):
    return retail.table(spark, sf, "part").select(F.col("p_type").alias("cat_id")).distinct().select("cat_id", terms.margin().alias("margin"))


@query("SELECT series_id, round(coalesce(var_samp(actual - forecast), 0), 4) AS variance FROM fca WHERE method = 'seasonal_naive' AND fold = 'holdout' GROUP BY 1")
def residual_variance(spark, sf):
    return fca(spark, sf).where("method = 'seasonal_naive' and fold = 'holdout'").groupBy("series_id").agg(r(F.coalesce(F.var_samp(F.col("actual") - F.col("forecast")), F.lit(0.0))).alias("variance"))


define("props", "SELECT series_id, share / sum(share) OVER () AS proportion FROM (SELECT series_id, avg(sales / d) AS share FROM (SELECT series_id, sales, sum(sales) OVER (PARTITION BY date) AS d FROM p2 CROSS JOIN bounds WHERE date > hi - 119 AND date <= hi - 28) WHERE d > 0 GROUP BY 1)")


def props(spark, sf):
    h = p2(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf))).where((F.col("date") > F.date_sub("hi", 119)) & (F.col("date") <= F.date_sub("hi", 28)))
    return reconcile.proportions(h)


@query("SELECT series_id, round(proportion, 8) AS proportion FROM props")
def historical_proportions(spark, sf):
    return props(spark, sf).select("series_id", r("proportion", 8).alias("proportion"))


define("tot", "SELECT date, step, sum(forecast) AS forecast FROM fc2 WHERE fold = 'holdout' AND method = 'seasonal_naive' GROUP BY ALL")


def fc2(spark, sf, fold="holdout"):
    return forecast.floors(p2(spark, sf), fold_table(spark, sf).where(F.col("fold") == fold)).where("method = 'seasonal_naive'").drop("method")


@query("SELECT series_id, date, round(proportion * forecast, 6) AS forecast FROM props CROSS JOIN tot")
def top_down(spark, sf):
    total = fc2(spark, sf).groupBy("date").agg(F.sum("forecast").alias("forecast"))
    return reconcile.top_down(props(spark, sf), F.broadcast(total)).select("series_id", "date", r("forecast", 6).alias("forecast"))  # one row a day


@query("SELECT 'state' AS level, state_id AS node, date, sum(forecast) AS forecast FROM fc2 WHERE fold = 'holdout' AND method = 'seasonal_naive' GROUP BY ALL UNION ALL SELECT 'category', cat_id || '|' || state_id, date, sum(forecast) FROM fc2 WHERE fold = 'holdout' AND method = 'seasonal_naive' GROUP BY ALL UNION ALL SELECT 'total', 'total', date, sum(forecast) FROM fc2 WHERE fold = 'holdout' AND method = 'seasonal_naive' GROUP BY ALL")
def bottom_up(spark, sf):
    lv = {"category": ["cat_id", "state_id"], "state": ["state_id"], "total": []}
    g = reconcile.clip_and_add_up(fc2(spark, sf), lv, ["date"])
    level = F.when(F.col("cat_id").isNotNull(), "category").when(F.col("state_id").isNotNull(), "state").otherwise("total")
    return g.select(level.alias("level"), F.when(level == "total", "total").otherwise(F.concat_ws("|", "cat_id", "state_id")).alias("node"), "date", "forecast")
