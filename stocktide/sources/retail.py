"""The canonical sales fact, calendar and panels, from the warehouse tables.

An item is a part, its category the part's type, its department type and brand; a store is the supplier's nation, a state its
region. Small dimensions are broadcast by Spark's own size check; the fact keeps only the columns that are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialised

#: Month-day of the calendar's events (fixed values of the test calendar).
EVENTS = {"01-01": "NewYear", "02-14": "ValentinesDay", "07-04": "IndependenceDay", "10-31": "Halloween", "12-25": "Christmas"}
HORIZON, BACKTESTS = 28, 3
MATRIX_DAYS = 420  # of the panels at department grain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, dept_id, cat_id, store_id, state_id, date, sales, revenue, sell_price of each line."""
    t = lambda n: table(spark, sf_dir, n)
    stores = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("n_name").alias("store_id"), F.col("r_name").alias("state_id"))
    items = t("part").select("p_partkey", F.col("p_type").alias("cat_id"), F.concat("p_type", F.lit("_"), "p_brand").alias("dept_id"))
    lines = t("lineitem").select("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("sales"), F.col("l_extendedprice").alias("revenue"))
    return lines.join(items, F.col("l_partkey") == F.col("p_partkey")).join(stores, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("P"), "l_partkey").alias("item_id"), "dept_id", "cat_id", "store_id", "state_id", "date", "sales", "revenue", (F.col("revenue") / F.col("sales")).alias("sell_price")
    )


SOURCES = ("lineitem", "part", "supplier", "nation", "region")
_silver: dict[tuple, DataFrame] = {}


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, times and sizes of all files of the source tables: equal as long as the sources are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in SOURCES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return tuple(sorted(out))


def once(spark: SparkSession, sf_dir: str, name: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of the shared folder, built where it is missing: once for each session, name and state of the sources."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, *name, state(spark, sf_dir))
    if key not in _silver:
        for old in [k for k in _silver if k[0] != app or k[:-1] == key[:-1]]:  # of ended sessions and older sources
            del _silver[old]
        _silver[key] = materialised(make(), "silver")
    return _silver[key]


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lo and hi, the first and last day: one row."""
    lines = table(spark, sf_dir, "lineitem")
    return once(spark, sf_dir, ("bounds",), lambda: lines.agg(F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi")))


def _event(date: Column) -> Column:
    out = F.lit(None).cast("string")
    for day, name in EVENTS.items():
        out = F.when(F.date_format(date, "MM-dd") == day, name).otherwise(out)
    return out


def calendar(spark: SparkSession, sf_dir: str, ahead: int = 0) -> DataFrame:
    """One row a day: day_idx, d, wm_yr_wk, weekday parts, event, snap."""
    days = bounds(spark, sf_dir).select(F.explode(F.sequence("lo", F.date_add("hi", ahead))).alias("date"), "lo")
    c = days.select("date", F.datediff("date", "lo").alias("day_idx")).withColumn("event_name", _event(F.col("date")))
    return c.select(
        "date", "day_idx", F.concat(F.lit("d_"), F.col("day_idx") + 1).alias("d"), (F.lit(11101) + F.floor(F.col("day_idx") / 7)).cast("int").alias("wm_yr_wk"),
        F.weekday("date").alias("dow"), F.dayofmonth("date").alias("day"), F.month("date").alias("month"), F.weekofyear("date").alias("week"), F.year("date").alias("year"), "event_name", (F.dayofmonth("date") <= 10).cast("int").alias("snap"),
    )


def daily(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    """keys, date, sales, revenue of days with sales: the silver table that all panels read."""
    return once(spark, sf_dir, tuple(keys), lambda: fact(spark, sf_dir).groupBy(*keys, "date").agg(F.sum("sales").alias("sales"), F.sum("revenue").alias("revenue")))


def panel(spark: SparkSession, sf_dir: str, keys: list[str], last_days: int | None = None) -> DataFrame:
    """A dense row for each series (of keys) and day: series_id, keys, date, day_idx, sales (0 where none), revenue, price (NULL where none)."""
    sums = daily(spark, sf_dir, keys)
    cal = calendar(spark, sf_dir).select("date", "day_idx")
    series = sums.select(*keys).distinct()
    if last_days:
        cal = cal.crossJoin(bounds(spark, sf_dir)).where(F.col("date") >= F.date_sub("hi", last_days - 1)).select("date", "day_idx")
    grid = series.crossJoin(cal)  # the spine: every series on every day of the calendar
    return grid.join(sums, [*keys, "date"], "left").select(F.concat_ws("|", *keys).alias("series_id"), *keys, "date", "day_idx", F.coalesce("sales", F.lit(0.0)).alias("sales"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"), (F.col("revenue") / F.col("sales")).alias("price"))


P1, P2 = ["cat_id", "state_id"], ["dept_id", "cat_id", "state_id"]
NATION = ["cat_id", "store_id", "state_id"]  # the grain of learned models and of intervals by segment


def folds() -> dict[str, int]:
    """Fold name -> days from the last day back to the fold's origin."""
    back = {f"backtest_{k + 1}": HORIZON * (BACKTESTS + 1 - k) for k in range(BACKTESTS)}
    return back | {"holdout": HORIZON}
