"""Ingest, hierarchy, features, stock-outs and classes as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import r, velocity
from ..operators import features, hierarchy, stockouts
from ..sources import retail
from ..sources.retail import P1, P2
from .registry import define, query

_NODE = {"item": "'item:item_id=' || item_id || '|store_id=' || store_id", "department": "'department:dept_id=' || dept_id || '|store_id=' || store_id", "category": "'category:cat_id=' || cat_id || '|store_id=' || store_id", "store": "'store:store_id=' || store_id", "state": "'state:state_id=' || state_id", "total": "'total:total'"}
_UNION = " UNION ALL ".join(f"SELECT '{lv}' AS level, {n} AS node_id, * FROM fact" for lv, n in _NODE.items())
define("nodes", _UNION)


@query("SELECT level, node_id, sum(sales) AS sales, round(sum(revenue), 2) AS revenue, count(*) AS n_lines FROM nodes GROUP BY level, node_id")
def hierarchy_rollup(spark, sf):
    out = hierarchy.roll_up(retail.fact(spark, sf), [F.sum("sales").alias("sales"), r(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("n_lines")])
    return out


@query("SELECT level, node_id, CAST(date AS DATE) AS date, sum(sales) AS sales FROM nodes GROUP BY level, node_id, date")
def hierarchy_daily(spark, sf):
    return hierarchy.roll_up(retail.fact(spark, sf), [F.sum("sales").alias("sales")], by=["date"])


@query("SELECT date, sum(sales) AS sales FROM fact WHERE cat_id = 'PROMO' AND store_id = (SELECT min(store_id) FROM fact) GROUP BY date")
def node_select(spark, sf):
    store = retail.table(spark, sf, "supplier").join(retail.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).agg(F.min("n_name")).first()[0]
    return hierarchy.select_node(retail.fact(spark, sf), f"category:cat_id=PROMO|store_id={store}")


@query("SELECT cat_id || '|' || store_id AS node_id, date, sum(sales) AS sales FROM fact GROUP BY ALL")
def bottom_up_level(spark, sf):
    out = hierarchy.aggregate_level(retail.fact(spark, sf), "category")
    return out.select(F.regexp_replace("node_id", r"category:cat_id=|store_id=", "").alias("node_id"), "date", "sales")


@query("SELECT DISTINCT item_id || '|' || store_id AS series_id, item_id, dept_id, cat_id, store_id, state_id FROM fact")
def series_keys(spark, sf):
    return hierarchy.series_keys(retail.fact(spark, sf))


@query("SELECT item_id, store_id, count(*) AS n, sum(sales) AS sales FROM fact WHERE item_id IN (SELECT DISTINCT item_id FROM fact ORDER BY item_id LIMIT 300) GROUP BY ALL")
def item_subsample(spark, sf):
    return hierarchy.first_items(retail.fact(spark, sf), 300).groupBy("item_id", "store_id").agg(F.count("*").alias("n"), F.sum("sales").alias("sales"))


@query("SELECT store_id, item_id, sum(sales) AS sales FROM fact WHERE state_id IN ('ASIA', 'EUROPE') AND date >= DATE '2000-01-01' GROUP BY ALL")
def state_date_filter(spark, sf):
    f = retail.fact(spark, sf).where(F.col("state_id").isin("ASIA", "EUROPE") & (F.col("date") >= F.lit("2000-01-01").cast("date")))
    return f.groupBy("store_id", "item_id").agg(F.sum("sales").alias("sales"))


_MONTHS = [f"m{m:02d}" for m in range(1, 13)]


@query("SELECT cat_id, state_id, CAST(year(date) AS INTEGER) AS year, printf('m%02d', month(date)) AS month, sum(sales) AS sales FROM fact GROUP BY ALL")
def unpivot_wide(spark, sf):
    """Wide by month, then back to long."""
    return _wide(spark, sf).unpivot(["cat_id", "state_id", "year"], _MONTHS, "month", "sales").where("sales is not null")


def _wide(spark, sf):
    f = retail.fact(spark, sf).withColumn("month", F.date_format("date", "'m'MM"))
    return f.groupBy("cat_id", "state_id", F.year("date").alias("year")).pivot("month", _MONTHS).agg(F.sum("sales"))


@query("SELECT date, day_idx, d, wm_yr_wk, dow, day, month, week, year, event_name, snap FROM cal")
def calendar_table(spark, sf):
    return hierarchy.number_days(retail.calendar(spark, sf))


@query("SELECT event_name, snap, wm_yr_wk, count(*) AS n_lines, sum(sales) AS sales FROM fact JOIN cal USING (date) GROUP BY ALL")
def calendar_join(spark, sf):
    cal = retail.calendar(spark, sf).select("date", "event_name", "snap", "wm_yr_wk")
    return retail.fact(spark, sf).join(cal, "date", "left").groupBy("event_name", "snap", "wm_yr_wk").agg(F.count("*").alias("n_lines"), F.sum("sales").alias("sales"))


define("weekprice", "SELECT store_id, item_id, wm_yr_wk, median(sell_price) AS sell_price FROM fact JOIN cal USING (date) GROUP BY ALL")


def week_prices(spark, sf):
    """The price dimension: one price for each store, item and week."""
    cal = retail.calendar(spark, sf).select("date", "wm_yr_wk")
    return retail.fact(spark, sf).join(cal, "date").groupBy("store_id", "item_id", "wm_yr_wk").agg(F.median("sell_price").alias("sell_price"))


@query("SELECT f.store_id, f.item_id, round(sum(sales * p.sell_price) + 1e-6, 2) AS list_revenue, sum(CASE WHEN p.sell_price IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_price FROM fact f JOIN cal USING (date) LEFT JOIN weekprice p ON p.store_id = f.store_id AND p.item_id = f.item_id AND p.wm_yr_wk = cal.wm_yr_wk GROUP BY ALL")
def price_join(spark, sf):
    """Revenue at list prices; a millionth is added because half cents are common and sums differ in their last bits."""
    cal = retail.calendar(spark, sf).select("date", "wm_yr_wk")
    j = retail.fact(spark, sf).drop("sell_price").join(cal, "date").join(week_prices(spark, sf), ["store_id", "item_id", "wm_yr_wk"], "left")
    return j.groupBy("store_id", "item_id").agg(r(F.sum(F.col("sales") * F.col("sell_price")) + 1e-6, 2).alias("list_revenue"), F.count_if(F.col("sell_price").isNull()).alias("no_price"))


@query("SELECT store_id, item_id, sum(CASE WHEN sell_price < med THEN 1 ELSE 0 END)::BIGINT AS promo_weeks, count(*) AS weeks FROM (SELECT *, median(sell_price) OVER (PARTITION BY store_id, item_id) AS med FROM weekprice) GROUP BY ALL")
def promo_flag(spark, sf):
    p = week_prices(spark, sf)
    promo = F.col("sell_price") < F.median("sell_price").over(W.partitionBy("store_id", "item_id"))
    return p.withColumn("promo", promo).groupBy("store_id", "item_id").agg(F.count_if("promo").alias("promo_weeks"), F.count("*").alias("weeks"))


@query("SELECT s.series_id, CAST(b.hi + CAST(h AS INTEGER) AS DATE) AS date, h::INTEGER AS step, round(m.price, 4) AS price FROM (SELECT DISTINCT series_id FROM p1) s CROSS JOIN bounds b CROSS JOIN range(1, 29) t(h) LEFT JOIN (SELECT series_id, median(price) AS price FROM p1 GROUP BY 1) m ON m.series_id = s.series_id")
def future_grid(spark, sf):
    p = retail.panel(spark, sf, P1)
    ahead = retail.bounds(spark, sf).select("hi", F.explode(F.sequence(F.lit(1), F.lit(28))).alias("step"))
    price = p.groupBy("series_id").agg(F.median("price").alias("price"))
    return p.select("series_id").distinct().crossJoin(ahead).join(price, "series_id", "left").select("series_id", F.date_add("hi", F.col("step")).alias("date"), "step", r("price").alias("price"))


@query("SELECT series_id, date, day_idx, sales, round(revenue, 2) AS revenue, price IS NOT NULL AS on_shelf FROM p1")
def dense_panel(spark, sf):
    return retail.panel(spark, sf, P1).select("series_id", "date", "day_idx", "sales", r("revenue", 2).alias("revenue"), F.col("price").isNotNull().alias("on_shelf"))


_LAG = "lag(sales, {n}) OVER s AS lag_{n}"
_ROLL = "CASE WHEN count(sales) OVER r{w} = {w} THEN round(avg(sales) OVER r{w}, 6) END AS rolling_mean_{w}"


@query("SELECT series_id, date, " + ", ".join(_LAG.format(n=n) for n in (28, 35, 42, 56)) + " FROM p1 WINDOW s AS (PARTITION BY series_id ORDER BY date)")
def lag_features(spark, sf):
    f = features.add_features(retail.panel(spark, sf, P1))
    return f.select("series_id", "date", "lag_28", "lag_35", "lag_42", "lag_56")


@query("SELECT series_id, date, " + ", ".join(_ROLL.format(w=w) for w in (7, 28, 56)) + " FROM p1 WINDOW " + ", ".join(f"r{w} AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN {27 + w} PRECEDING AND 28 PRECEDING)" for w in (7, 28, 56)))
def rolling_mean(spark, sf):
    f = features.add_features(retail.panel(spark, sf, P1))
    return f.select("series_id", "date", *(r(f"rolling_mean_{w}", 6).alias(f"rolling_mean_{w}") for w in (7, 28, 56)))


@query("SELECT series_id, date, CASE WHEN count(sales) OVER r = 28 THEN round(stddev_samp(sales) OVER r, 4) END AS rolling_std_28 FROM p1 WINDOW r AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 55 PRECEDING AND 28 PRECEDING)")
def rolling_std(spark, sf):
    return features.add_features(retail.panel(spark, sf, P1)).select("series_id", "date", r("rolling_std_28").alias("rolling_std_28"))


@query("SELECT series_id, date, dow AS dayofweek, day, month, week AS weekofyear, CASE WHEN dow >= 5 THEN 1 ELSE 0 END AS weekend, coalesce(event_name = 'Christmas', false) AS closed FROM p1 JOIN cal USING (date)")
def date_features(spark, sf):
    f = features.add_features(retail.panel(spark, sf, P1)).join(retail.calendar(spark, sf).select("date", "event_name"), "date")
    return f.select("series_id", "date", "dayofweek", "day", "month", "weekofyear", "weekend", F.col("event_name").eqNullSafe("Christmas").alias("closed"))


@query("SELECT series_id, date, round(price / median(price) OVER (PARTITION BY series_id), 4) AS price_ratio, round(price / lag(price, 7) OVER (PARTITION BY series_id ORDER BY date) - 1, 4) AS price_change_7 FROM p1")
def price_features(spark, sf):
    return features.add_features(retail.panel(spark, sf, P1)).select("series_id", "date", r("price_ratio").alias("price_ratio"), r("price_change_7").alias("price_change_7"))


@query("SELECT c.date, CAST(least(coalesce((SELECT min(e.date) FROM cal e WHERE e.event_name IS NOT NULL AND e.date >= c.date) - c.date, 15), 15) AS INTEGER) AS days_to_next, CAST(least(coalesce(c.date - (SELECT max(e.date) FROM cal e WHERE e.event_name IS NOT NULL AND e.date < c.date), 15), 15) AS INTEGER) AS days_since FROM cal c")
def event_distance(spark, sf):
    return features.event_distance(retail.calendar(spark, sf)).select("date", "days_to_next", "days_since")


define("zruns", "SELECT *, CASE WHEN sales = 0 THEN count(*) FILTER (WHERE sales = 0) OVER (PARTITION BY series_id, island) ELSE 0 END AS run_length FROM (SELECT *, sum(CASE WHEN sales <> 0 THEN 1 ELSE 0 END) OVER s AS island, max(sales) OVER s > 0 AS started FROM p2 WINDOW s AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING))")
define("sflags", "SELECT *, sales = 0 AND started AND run_length >= 2 AND exp(-rate * run_length) < 0.001 AND rate >= 1 AS flagged FROM (SELECT *, sum(sales) OVER (PARTITION BY series_id) / greatest(sum(CASE WHEN started THEN 1 ELSE 0 END) OVER (PARTITION BY series_id), 1) AS rate FROM zruns)")


def p2(spark, sf):
    return retail.panel(spark, sf, P2, last_days=retail.MATRIX_DAYS)


@query("SELECT series_id, date, sales, run_length::BIGINT AS run_length, started FROM zruns")
def zero_runs(spark, sf):
    return stockouts.zero_runs(p2(spark, sf)).select("series_id", "date", "sales", "run_length", "started")


@query("SELECT series_id, date, run_length::BIGINT AS run_length, round(rate, 4) AS rate FROM sflags WHERE flagged")
def probable_stockouts(spark, sf):
    return stockouts.probable_stockouts(p2(spark, sf)).where("flagged").select("series_id", "date", "run_length", r("rate").alias("rate"))


@query("SELECT state_id, cat_id, sum(flagged::INT)::BIGINT AS flagged_days, sum(started::INT)::BIGINT AS observed_days, round(sum(flagged::INT) / greatest(sum(started::INT), 1), 6) AS censored_share FROM sflags GROUP BY ALL")
def censoring_summary(spark, sf):
    out = stockouts.censoring_summary(stockouts.probable_stockouts(p2(spark, sf)), ["state_id", "cat_id"])
    return out.withColumn("censored_share", r("censored_share", 6))


@query("SELECT f.series_id, f.date, round(f.rm, 6) AS rolling_mean_56 FROM (SELECT *, CASE WHEN count(sales) OVER r = 56 THEN avg(sales) OVER r END AS rm FROM p2 WINDOW r AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 83 PRECEDING AND 28 PRECEDING)) f JOIN cal USING (date) ANTI JOIN (SELECT * FROM sflags WHERE flagged) x ON x.series_id = f.series_id AND x.date = f.date WHERE f.price IS NOT NULL AND f.rm IS NOT NULL AND event_name IS DISTINCT FROM 'Christmas'")
def training_filter(spark, sf):
    p = p2(spark, sf)
    f = features.add_features(p).join(retail.calendar(spark, sf).select("date", "event_name"), "date")
    return features.training_rows(f, stockouts.probable_stockouts(p).where("flagged")).select("series_id", "date", r("rolling_mean_56", 6).alias("rolling_mean_56"))


@query("SELECT series_id, round(avg(sales), 4) AS mean_daily, CASE WHEN avg(sales) >= 2 THEN 'fast' WHEN avg(sales) >= 0.5 THEN 'medium' WHEN avg(sales) >= 0.1 THEN 'slow' ELSE 'sporadic' END AS velocity FROM p2 GROUP BY 1")
def velocity_class(spark, sf):
    return p2(spark, sf).groupBy("series_id").agg(r(F.avg("sales")).alias("mean_daily"), velocity(F.avg("sales")).alias("velocity"))


define("abcs", "SELECT series_id, revenue, CASE WHEN b / t < 0.8 THEN 'A' WHEN b / t < 0.95 THEN 'B' ELSE 'C' END AS abc FROM (SELECT series_id, revenue, coalesce(sum(revenue) OVER (ORDER BY revenue DESC, series_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(revenue) OVER () AS t FROM (SELECT series_id, round(sum(revenue), 2) AS revenue FROM p2 GROUP BY 1))")
define("weekly", "SELECT series_id, day_idx // 7 AS week, sum(sales) AS sales FROM (SELECT series_id, sales, day_idx - (SELECT min(day_idx) FROM p2) - 364 AS day_idx FROM p2) WHERE day_idx >= 0 GROUP BY ALL")
define("xyzs", "SELECT series_id, CASE WHEN avg(sales) > 0 THEN stddev_pop(sales) / avg(sales) END AS cv, CASE WHEN avg(sales) > 0 AND stddev_pop(sales) / avg(sales) < 0.5 THEN 'X' WHEN avg(sales) > 0 AND stddev_pop(sales) / avg(sales) < 1 THEN 'Y' ELSE 'Z' END AS xyz FROM weekly GROUP BY 1")


def abc(spark, sf):
    return stockouts.abc_class(p2(spark, sf).groupBy("series_id").agg(r(F.sum("revenue"), 2).alias("revenue")))


def xyz(spark, sf):
    """From the last eight weeks."""
    hi = retail.bounds(spark, sf)
    last = p2(spark, sf).crossJoin(hi).where(F.col("date") > F.date_sub("hi", 56))
    return stockouts.xyz_class(last.groupBy("series_id", F.floor(F.datediff("date", F.date_sub("hi", 55)) / 7)).agg(F.sum("sales").alias("sales")))


@query("SELECT * FROM abcs")
def abc_class(spark, sf):
    return abc(spark, sf)


@query("SELECT series_id, round(cv, 4) AS cv, xyz FROM xyzs")
def xyz_class(spark, sf):
    return xyz(spark, sf).withColumn("cv", r("cv"))


@query("SELECT series_id, abc, xyz, CASE abc || xyz WHEN 'AX' THEN 0.98 WHEN 'AY' THEN 0.97 WHEN 'AZ' THEN 0.95 WHEN 'BX' THEN 0.96 WHEN 'BY' THEN 0.95 WHEN 'BZ' THEN 0.92 WHEN 'CX' THEN 0.93 WHEN 'CY' THEN 0.9 ELSE 0.85 END::DOUBLE AS service_level FROM abcs JOIN xyzs USING (series_id)")
def service_target(spark, sf):
    return stockouts.service_target(abc(spark, sf).join(xyz(spark, sf), "series_id")).select("series_id", "abc", "xyz", "service_level")
