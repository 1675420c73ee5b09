"""Learned models, reports and extracts as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import bias, r, wmape
from ..operators import additive, boosting, features, forecast, metrics, models, reconcile, sarima, stockouts
from ..sources import retail
from ..sources.retail import NATION
from ..sources.store import columnar_json, json_records, materialised, shared_folder
from . import terms
from .q_forecast import FOLDS, fc1, fca, levels, p1
from .q_stock import banded
from .registry import query


HISTORY_DAYS, NODE_DAYS = 548, 364
TREES, DEPTH, RATE = 24, 4, 0.2  # of the registered models, which serve as a floor of quality; see README for 300 trees
CATEGORIES = ["cat_id", "store_id"]


def _features(spark, sf):
    p = retail.panel(spark, sf, NATION)
    cal = features.event_distance(retail.calendar(spark, sf)).select("date", "snap", "days_to_next", "days_since", "event_name")
    # a day's own price is known only where something was sold, so models get the last one from before the horizon
    before = W.partitionBy("series_id").orderBy("date").rowsBetween(W.unboundedPreceding, -features.MIN_LAG)
    f = features.add_features(p.withColumn("price", F.last("price", ignorenulls=True).over(before))).join(F.broadcast(cal), "date").crossJoin(F.broadcast(retail.bounds(spark, sf)))  # a row a day
    f = materialised(f.where(F.col("date") > F.date_sub("hi", HISTORY_DAYS)), "features")
    ok = features.training_rows(f, stockouts.probable_stockouts(p).where("flagged")).select("series_id", "date", F.lit(True).alias("learn"))
    f = f.join(ok, ["series_id", "date"], "left").withColumns({"learn": F.coalesce("learn", F.lit(False)), "price_ratio": F.coalesce("price_ratio", F.lit(1.0)), "price_change_7": F.coalesce("price_change_7", F.lit(0.0)), "price": F.coalesce("price", F.lit(0.0))})
    return f.withColumn("ago", F.datediff("hi", "date"))


def frame(spark, sf):
    """Features of the last HISTORY_DAYS of categories in nations; learn: rows to fit on (training_rows); ago: days before the last one."""
    return retail.once(spark, sf, ("features",), lambda: _features(spark, sf))


def _ahead(f, fold):
    """The four weeks after a fold's origin."""
    return f.where((F.col("ago") < FOLDS[fold]) & (F.col("ago") >= FOLDS[fold] - retail.HORIZON) & F.col("rolling_mean_56").isNotNull())


_forests: dict[tuple, boosting.Forest] = {}


def forest(spark, sf, trees: int = TREES) -> boosting.Forest:
    """For each fold one pooled Tweedie model and one for each nation, and for the holdout pooled quantiles: all grown together, once a session."""
    key = (spark.sparkContext.applicationId, trees, retail.state(spark, sf))
    if key not in _forests:
        f, nations = frame(spark, sf), [x[0] for x in retail.table(spark, sf, "nation").select("n_name").orderBy("n_name").collect()]
        models = [boosting.Wanted(f"{kind}|{fold}|{n or ''}", fold, n) for fold in FOLDS for kind, names in (("gbt_global", [None]), ("gbt_local", nations)) for n in names]
        models += [boosting.Wanted(f"q{level}", "holdout", None, "pinball", level) for level in (0.1, 0.9)]
        learn = {fold: F.col("learn") & (F.col("ago") >= back) for fold, back in FOLDS.items()}
        _forests.clear()
        _forests[key] = boosting.fit(f.where("learn"), "sales", learn, models, [c for c in models_see(f)], CATEGORIES, trees=trees, depth=DEPTH, rate=RATE)
    return _forests[key]


def models_see(f) -> list[str]:
    return [c for c in models.feature_columns(f) if c not in CATEGORIES]


def _candidates(spark, sf, trees: int = TREES):
    f, grown = frame(spark, sf), forest(spark, sf, trees)
    keep = ["series_id", "cat_id", "store_id", "state_id", "date", "sales"]
    out = None
    for fold in FOLDS:
        names = [m.name for m in grown.models if m.fold == fold and m.loss == "tweedie"]
        p = boosting.predict(grown, _ahead(f, fold), names, keep).withColumn("method", F.split_part("model", F.lit("|"), F.lit(1))).drop("model").withColumn("fold", F.lit(fold))
        out = p if out is None else out.unionByName(p)
    keys = F.concat_ws("|", *NATION)
    floor = forecast.floors(retail.panel(spark, sf, NATION), forecast.origins(retail.bounds(spark, sf), FOLDS)).withColumn("series_id", keys)
    actual = f.select("series_id", "date", "sales")
    return out.unionByName(floor.join(actual, ["series_id", "date"]).select(*out.columns))


def candidates(spark, sf):
    """Each fold's four weeks by four methods: two floors, the pooled trees and a nation's own."""
    return retail.once(spark, sf, ("candidates",), lambda: _candidates(spark, sf))


def _scored(rows):
    return rows.groupBy("state_id").agg(r(wmape("sales", "forecast"), 6).alias("wmape"), r(bias("sales", "forecast"), 6).alias("bias"), F.min("forecast").alias("least"), F.count("*").alias("n"))


@query()
def gbt_global(spark, sf):
    """One pooled Tweedie model, scored on the holdout."""
    return _scored(candidates(spark, sf).where("method = 'gbt_global' and fold = 'holdout'"))


@query()
def gbt_local(spark, sf):
    """One model for each nation, grown in the same aggregates as all others."""
    return _scored(candidates(spark, sf).where("method = 'gbt_local' and fold = 'holdout'"))


@query()
def candidate_errors(spark, sf):
    """Four candidate models on every fold."""
    g = candidates(spark, sf).groupBy("fold", "method").agg(wmape("sales", "forecast").alias("wmape"), bias("sales", "forecast").alias("bias"), F.count("*").alias("n"))
    return g.select("fold", "method", r("wmape", 6).alias("wmape"), r("bias", 6).alias("bias"), "n")


@query()
def candidate_select(spark, sf):
    """The candidate with the least mean error over the backtests; the holdout has no say."""
    e = candidate_errors(spark, sf).where("fold like 'backtest%'").groupBy("method").agg(F.avg("wmape").alias("w"))
    return e.agg(F.min_by("method", F.struct("w", "method")).alias("method"), r(F.min("w"), 6).alias("wmape"))


@query()
def gbt_quantiles(spark, sf):
    """Pooled trees with pinball loss: what share of the holdout lies under each level, and the loss."""
    p = boosting.predict(forest(spark, sf), _ahead(frame(spark, sf), "holdout"), ["q0.1", "q0.9"], ["state_id", "sales"])
    level = F.substring("model", 2, 9).cast("double")
    e = F.col("sales") - F.col("forecast")
    return p.groupBy("state_id", level.alias("level")).agg(r(F.avg((e <= 0).cast("double")), 6).alias("share_below"), r(F.avg(F.greatest(level * e, (level - 1) * e)), 6).alias("pinball"), F.count("*").alias("n"))


@query()
def tweedie_glm(spark, sf):
    f = frame(spark, sf)
    cols = models_see(f)
    model = models.fit_tweedie(f.where(F.col("learn") & (F.col("ago") >= retail.HORIZON)), cols)
    rows = model.transform(models._assembled(_ahead(f, "holdout"), cols)).withColumn("forecast", F.greatest("prediction", F.lit(0.0)))
    return _scored(rows)


FIRST_TREES, MORE_TREES = 12, 2


def learned_runs(spark, sf, weeks: int = 5, store: str | None = None):
    """fold, series_id, cat_id, step, date, forecast, actual, k: the pooled model at each of the last weekly origins, each week's going on where the
    stored one of the week before stopped, with the rows that are new by then."""
    f, path, cols = frame(spark, sf), store or f"{shared_folder(spark)}/models-{uuid.uuid4().hex}", models_see(frame(spark, sf))
    out = None
    for k in range(weeks):
        back = retail.HORIZON + 7 * (weeks - 1 - k)
        warm = boosting.load(spark, path, f"week_{k - 1}") if k else None
        learn = {"week": F.col("learn") & (F.col("ago") >= back)}
        grown = boosting.fit(f.where("learn"), "sales", learn, [boosting.Wanted("pooled", "week")], cols, CATEGORIES, trees=MORE_TREES if k else FIRST_TREES, depth=DEPTH, rate=RATE, warm=warm)
        boosting.save(spark, path, f"week_{k}", grown, f"week_{k - 1}" if k else None, f"origin {back} days before the last day")
        ahead = f.where((F.col("ago") < back) & (F.col("ago") >= back - retail.HORIZON) & F.col("rolling_mean_56").isNotNull())
        p = boosting.predict(grown, ahead, ["pooled"], ["series_id", "cat_id", "date", "ago", "sales"])
        p = p.select(F.lit(f"week_{k}").alias("fold"), "series_id", "cat_id", (F.lit(back) - F.col("ago")).alias("step"), "date", "forecast", F.col("sales").alias("actual"), F.lit(k).alias("k"))
        out = p if out is None else out.unionByName(p)
    return out


def learned_replay(spark, sf, weeks: int = 5, store: str | None = None):
    """A row a week, of the learned model and the floor: next week's and four weeks' error, bias, the error of decision windows, and how far the forecast moved."""
    runs = materialised(learned_runs(spark, sf, weeks, store), "replay")
    panel = retail.panel(spark, sf, NATION)
    floor = forecast.floors(panel, forecast.origins(retail.bounds(spark, sf), {f"week_{k}": retail.HORIZON + 7 * (weeks - 1 - k) for k in range(weeks)})).where("method = 'seasonal_naive'")
    floor = forecast.with_actuals(floor, panel).withColumn("k", F.substring_index("fold", "_", -1).cast("int"))
    both = runs.withColumn("model", F.lit("gbt_global")).unionByName(floor.withColumn("model", F.lit("seasonal_naive")).select(*runs.columns, "model"))
    near = lambda c: F.sum(F.when(F.col("step") <= 7, c))
    g = both.groupBy("model", "fold").agg(r(near(F.abs(F.col("actual") - F.col("forecast"))) / near(F.col("actual")), 6).alias("next_week_wmape"), r(wmape("actual", "forecast"), 6).alias("four_week_wmape"), r(bias("actual", "forecast"), 6).alias("four_week_bias"))
    days = both.withColumn("window_days", terms.protection_days())
    sums = metrics.window_sums(days, F.col("window_days"), retail.HORIZON, ["actual", "forecast"], ["model", "fold", "window_days", "series_id"])
    decided = sums.groupBy("model", "fold").agg(r(wmape("actual", "forecast"), 6).alias("decision_wmape"))
    old = both.select("model", "series_id", "date", (F.col("k") + 1).alias("k"), "forecast")
    moved = metrics.stability(old, both, ["model", "series_id", "date", "k"], ["model", "fold"]).select("model", "fold", r("stability", 6).alias("stability"))
    return g.join(decided, ["model", "fold"]).join(moved, ["model", "fold"], "left")


@query()
def planning_cycle_learned(spark, sf):
    """The weekly re-fit with carried model state, beside the floor at the same grain."""
    return learned_replay(spark, sf)


def _tree(df, *keep):
    """Each row of a category in a nation once for every node above it: level (0 the total), node, parent, keep."""
    leaf = F.concat_ws("|", *NATION)
    places = ((0, F.lit("total"), F.lit("")), (1, F.col("state_id"), F.lit("total")), (2, F.col("store_id"), F.col("state_id")), (3, leaf, F.col("store_id")))
    return df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("level"), n.alias("node"), p.alias("parent")) for k, n, p in places))).alias("_n"), *keep).select("_n.*", *keep)


def _node_days(spark, sf, weekly=False, fold="holdout"):
    """Daily (or whole-week) sums of every node above the leaves, and of them, in the NODE_DAYS up to a fold's origin."""
    back = FOLDS[fold]
    p = retail.panel(spark, sf, NATION).crossJoin(F.broadcast(retail.bounds(spark, sf))).withColumn("ago", F.datediff(F.date_sub("hi", back), "date"))  # one row
    p = p.where((F.col("ago") >= 0) & (F.col("ago") < NODE_DAYS))
    day = F.date_sub(F.date_sub("hi", back), (F.floor(F.col("ago") / 7) * 7).cast("int")) if weekly else F.col("date")
    leaves = p.groupBy(*NATION, day.alias("date")).agg(F.sum("sales").alias("sales"))
    return _tree(leaves, "date", "sales").groupBy("level", "node", "parent", "date").agg(F.sum("sales").alias("sales"))


def node_forecasts(spark, sf, weekly=False):
    """level, node, parent, step, forecast, variance of all nodes, for the holdout."""
    how = {"horizon": 4, "season": 0} if weekly else {}
    return retail.once(spark, sf, ("sarima", weekly), lambda: sarima.nodes(_node_days(spark, sf, weekly), ["level", "node", "parent"], **how))


@query()
def sarima_nodes(spark, sf):
    """Daily seasonal ARIMA of the total, every region, nation and category in a nation."""
    return node_forecasts(spark, sf).select("level", "node", "step", r("forecast").alias("forecast"), r("variance").alias("variance"))


@query()
def weekly_arima_nodes(spark, sf):
    """ARIMA of whole-week totals of the same nodes."""
    return node_forecasts(spark, sf, weekly=True).select("level", "node", "step", r("forecast").alias("forecast"), r("variance").alias("variance"))


def _base(spark, sf):
    """y and w of every node: leaves by the candidate chosen on the backtests with their squared error there, nodes above by their ARIMA and its variance."""
    c = candidates(spark, sf)
    best = F.broadcast(candidate_select(spark, sf).select("method"))  # one row
    mine = c.join(best, "method").withColumn("node", F.concat_ws("|", *NATION))
    spread = mine.where("fold like 'backtest%'").groupBy("node").agg(F.avg((F.col("sales") - F.col("forecast")) ** 2).alias("w"))
    leaf = mine.where("fold = 'holdout'").crossJoin(F.broadcast(retail.bounds(spark, sf))).withColumn("step", F.datediff("date", F.date_sub("hi", FOLDS["holdout"])))
    leaf = leaf.join(spread, "node").select("step", "node", F.col("store_id").alias("parent"), F.lit(3).alias("level"), F.col("forecast").alias("y"), "w")
    upper = node_forecasts(spark, sf).where("level < 3").select("step", "node", "parent", "level", F.col("forecast").alias("y"), F.greatest("variance", F.lit(1e-9)).alias("w"))
    return upper.unionByName(leaf)


def learned_tree(spark, sf):
    return retail.once(spark, sf, ("learned_tree",), lambda: _base(spark, sf))


def _errors(spark, sf):
    """Of each leaf, the chosen candidate's errors on the backtests' days."""
    best = F.broadcast(candidate_select(spark, sf).select("method"))
    e = candidates(spark, sf).join(best, "method").where("fold like 'backtest%'")
    return e.select(*NATION, "date", (F.col("sales") - F.col("forecast")).alias("error"))


@query()
def reconcile_learned(spark, sf):
    """Learned leaves and ARIMA above them, made coherent: by their sums, by variances, and by the full shrunk covariance of their errors."""
    base = learned_tree(spark, sf)
    leaves = {"bottom_up": base.where("level = 3").select("step", "node", F.col("y").alias("forecast")), "mint_variance": reconcile.mint_tree(base, 3, ["step"]).where("level = 3").select("step", "node", "forecast")}
    errors = _tree(_errors(spark, sf), "date", "error").groupBy("node", "date").agg(F.sum("error").alias("error"))
    leaves["mint_shrunk"] = reconcile.mint_shrunk(base, errors).where("level = 3").select("step", "node", "forecast")
    out = base.select(F.lit("base").alias("method"), "level", "node", "step", F.col("y").alias("forecast"))
    for method, rows in leaves.items():
        parts = F.split("node", r"\|")
        keyed = rows.select("step", *(parts[k].alias(c) for k, c in enumerate(NATION)), F.greatest("forecast", F.lit(0.0)).alias("forecast"))
        sums = _tree(keyed, "step", "forecast").groupBy("level", "node", "step").agg(F.sum("forecast").alias("forecast"))
        out = out.unionByName(sums.select(F.lit(method).alias("method"), "level", "node", "step", "forecast"))
    ahead = retail.panel(spark, sf, NATION).crossJoin(F.broadcast(retail.bounds(spark, sf))).withColumn("step", F.datediff("date", F.date_sub("hi", FOLDS["holdout"]))).where("step between 1 and 28")
    actual = _tree(ahead, "step", "sales").groupBy("level", "node", "step").agg(F.sum("sales").alias("sales"))
    return out.join(actual, ["level", "node", "step"]).groupBy("method", "level").agg(r(wmape("sales", "forecast"), 6).alias("wmape"), r(bias("sales", "forecast"), 6).alias("bias"), F.count("*").alias("n"))


@query()
def temporal_learned(spark, sf):
    """Every node's daily ARIMA against that of its whole weeks, each by its variance."""
    d = node_forecasts(spark, sf).where("level < 3").withColumn("week", F.floor((F.col("step") - 1) / 7))
    spread = d.groupBy("level", "node", "week").agg(F.avg("variance").alias("vd"))
    daily = d.join(spread, ["level", "node", "week"]).select("level", "node", "week", "step", "forecast", "vd")
    weekly = node_forecasts(spark, sf, weekly=True).select("level", "node", (F.col("step") - 1).cast("long").alias("week"), F.col("forecast").alias("total"), F.col("variance").alias("vw"))
    return reconcile.temporal(daily, weekly, ["level", "node"]).select("level", "node", "week", "step", r("forecast").alias("forecast"))


@query()
def seasonal_regression(spark, sf):
    """Trend with change points, weekly and yearly waves and holidays of the total, every region and every nation, with intervals, after the last day."""
    cal = retail.calendar(spark, sf, ahead=retail.HORIZON).select("date", F.col("event_name").isNotNull().cast("double").alias("holiday"))
    sums = retail.daily(spark, sf, NATION)
    # days without a sale count as zero: the spine of every node's days
    days = _tree(sums, "date", "sales").where("level < 3").groupBy("level", "node", "date").agg(F.sum("sales").alias("sales"))
    known = cal.join(F.broadcast(retail.bounds(spark, sf)), F.col("date") <= F.col("hi")).select("date", "holiday")  # one row
    spine = days.select("level", "node").distinct().crossJoin(F.broadcast(known))  # nodes above the leaves times days
    history = spine.join(days, ["level", "node", "date"], "left").withColumn("sales", F.coalesce("sales", F.lit(0.0)))
    future = cal.join(F.broadcast(retail.bounds(spark, sf)), F.col("date") > F.col("hi")).select("date", "holiday")
    out = additive.forecasts(history, future, ["level", "node"])
    return out.select(F.col("level").cast("int").alias("level"), "node", "date", *(r(c).alias(c) for c in ("forecast", "lower", "upper")))


@query("SELECT fold, method, round(max(CASE WHEN level = 'series' THEN w END), 4) AS series, round(max(CASE WHEN level = 'category' THEN w END), 4) AS category, round(max(CASE WHEN level = 'state' THEN w END), 4) AS state, round(max(CASE WHEN level = 'total' THEN w END), 4) AS total FROM (SELECT fold, method, level, sum(abs(actual - forecast)) / sum(actual) AS w FROM lev GROUP BY ALL) GROUP BY ALL")
def summary_pivot(spark, sf):
    """Error by level, levels as columns."""
    g = levels(spark, sf).groupBy("fold", "method", "level").agg(wmape("actual", "forecast").alias("w"))
    p = g.groupBy("fold", "method").pivot("level", ["series", "category", "state", "total"]).agg(F.first("w"))
    return p.select("fold", "method", *(r(c).alias(c) for c in ("series", "category", "state", "total")))


@query("SELECT series_id, date, max(actual) AS actual, max(CASE WHEN method = 'naive' THEN forecast END) AS naive, max(CASE WHEN method = 'seasonal_naive' THEN forecast END) AS seasonal_naive FROM fca WHERE fold = 'holdout' GROUP BY ALL")
def forecast_alignment(spark, sf):
    """Methods side by side for each day, the actual taken once."""
    f = fca(spark, sf).where("fold = 'holdout'")
    return f.groupBy("series_id", "date").pivot("method", ["naive", "seasonal_naive"]).agg(F.first("forecast")).join(f.select("series_id", "date", "actual").distinct(), ["series_id", "date"])


_LABEL = {"naive": "Last value", "seasonal_naive": "Last week"}


@query("SELECT CASE method WHEN 'naive' THEN 'Last value' ELSE 'Last week' END AS method_label, split_part(series_id, '|', 1) AS category, split_part(series_id, '|', 2) AS state, fold, date, actual, forecast, NULL::DOUBLE AS upper_95 FROM fca UNION ALL SELECT 'Interval', split_part(series_id, '|', 1), split_part(series_id, '|', 2), 'holdout', date, NULL, forecast, round(upper_95, 4) FROM ivp")
def bi_extract(spark, sf):
    """Backtest and interval timelines in one flat table with labels."""
    label = F.create_map(*(F.lit(x) for kv in _LABEL.items() for x in kv))
    part = lambda i: F.regexp_extract("series_id", r"^(.*)\|(.*)$", i)
    a = fca(spark, sf).select(label[F.col("method")].alias("method_label"), part(1).alias("category"), part(2).alias("state"), "fold", "date", "actual", "forecast")
    b = banded(spark, sf, False).select(F.lit("Interval").alias("method_label"), part(1).alias("category"), part(2).alias("state"), "fold", "date", "forecast", r("upper_95").alias("upper_95"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT series_id, count(*) AS n, CAST(max(date) AS DATE) AS last_date FROM fc1 WHERE method = 'naive' GROUP BY 1")
def json_extract(spark, sf):
    """Records written as JSON and read again."""
    f = fc1(spark, sf).where("method = 'naive'").select("series_id", "date", "forecast")
    back = json_records(f).select(F.from_json("json", "series_id string, date date, forecast double").alias("x"))
    return back.groupBy("x.series_id").agg(F.count("*").alias("n"), F.max("x.date").alias("last_date"))


@query("SELECT series_id AS id, count(*) AS n, sum(sales) AS sales FROM p1 CROSS JOIN bounds WHERE date > hi - 28 GROUP BY 1")
def columnar_extract(spark, sf):
    """Series as columns of dates and values in JSON, read again."""
    p = p1(spark, sf).crossJoin(F.broadcast(retail.bounds(spark, sf))).where(F.col("date") > F.date_sub("hi", 28))
    x = columnar_json(p, "series_id", "date", ["sales"]).select(F.from_json("json", "id string, dates array<string>, sales array<double>").alias("x"))
    return x.select("x.id", F.size("x.dates").cast("long").alias("n"), F.aggregate("x.sales", F.lit(0.0), lambda a, v: a + v).alias("sales"))


@query("SELECT series_id, sales FROM (SELECT series_id, sum(sales) AS sales FROM p1 GROUP BY 1) WHERE contains(lower(series_id), 'asia') ORDER BY series_id LIMIT 300")
def search_nodes(spark, sf):
    """Case-insensitive search, the first 300: a report."""
    return p1(spark, sf).where(F.lower("series_id").contains("asia")).groupBy("series_id").agg(F.sum("sales").alias("sales")).orderBy("series_id").limit(300)


@query("SELECT fold, count(DISTINCT series_id) AS series, count(*) AS n, CAST(min(date) AS DATE) AS first_day, CAST(max(date) AS DATE) AS last_day FROM fc1 GROUP BY 1")
def fold_calendar(spark, sf):
    return fc1(spark, sf).groupBy("fold").agg(F.countDistinct("series_id").alias("series"), F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
