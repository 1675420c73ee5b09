"""Raw M5-shaped files to the silver fact: typed reads, wide days to long, joins, promo flag, partitioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.hierarchy import number_days
from .store import exists

IDS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
CALENDAR = "date string, wm_yr_wk int, weekday string, wday int, month int, year int, d string, event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string, snap_CA int, snap_TX int, snap_WI int"
PRICES = "store_id string, item_id string, wm_yr_wk int, sell_price double"
SALES_FILES = ("sales_train_evaluation.csv", "sales_train_validation.csv")


def sales_file(spark: SparkSession, folder: str) -> str:
    """The evaluation file where there is one."""
    return next((f for f in SALES_FILES if exists(spark, f"{folder}/{f}")), SALES_FILES[0])


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wide sales, calendar, prices); an error names every missing file."""
    name = sales_file(spark, folder)
    missing = [f for f in (name, "calendar.csv", "sell_prices.csv") if not exists(spark, f"{folder}/{f}")]
    if missing:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(missing)}")
    header = spark.read.option("header", True).csv(f"{folder}/{name}").columns
    schema = ", ".join(f"`{c}` {'string' if c in IDS else 'short'}" for c in header)
    cal_header = spark.read.option("header", True).csv(f"{folder}/calendar.csv").columns
    types = dict(x.strip().split(" ") for x in CALENDAR.split(","))
    read = lambda f, s: spark.read.option("header", True).schema(s).csv(f"{folder}/{f}")
    calendar = read("calendar.csv", ", ".join(f"`{c}` {types.get(c, 'string')}" for c in cal_header)).withColumn("date", F.to_date("date"))
    return read(name, schema), calendar, read("sell_prices.csv", PRICES)


def validate(sales: DataFrame, calendar: DataFrame, prices: DataFrame) -> list[str]:
    """What is wrong with the shapes and keys; empty if nothing is."""
    problems = []
    if sales.groupBy("item_id", "store_id").count().where("count > 1").limit(1).count():
        problems.append("an item and store has several rows")
    if calendar.groupBy("date").count().where("count > 1").limit(1).count():
        problems.append("a date has several calendar rows")
    if prices.groupBy("store_id", "item_id", "wm_yr_wk").count().where("count > 1").limit(1).count():
        problems.append("a store, item and week has several prices")
    days = {c for c in sales.columns if c not in IDS}
    if "d" in calendar.columns and calendar.where(F.col("d").isin(*days)).count() != len(days):
        problems.append("a day of the sales has no calendar row")
    return problems


def melt(sales: DataFrame) -> DataFrame:
    days = [c for c in sales.columns if c not in IDS]
    return sales.unpivot([c for c in IDS if c in sales.columns], days, "d", "sales")


def prepare(sales: DataFrame, calendar: DataFrame, prices: DataFrame, states: list[str] | None = None) -> DataFrame:
    """The silver fact; states are filtered before anything is widened or joined."""
    if states:
        sales, prices = sales.where(F.col("state_id").isin(states)), prices.where(F.substring("store_id", 1, 2).isin(states))
    long = melt(sales).drop("id").join(number_days(calendar), "d", "left").join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")
    median = F.median("sell_price").over(W.partitionBy("store_id", "item_id"))
    return long.withColumn("promo", F.coalesce((F.col("sell_price") < median).cast("tinyint"), F.lit(0).cast("tinyint")))


def write_silver(fact: DataFrame, path: str) -> None:
    """One folder a state; a rerun replaces only the states it holds."""
    fact.repartition("state_id", "store_id").sortWithinPartitions("store_id", "item_id", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state_id").parquet(path)


def read_silver(spark: SparkSession, path: str, states: list[str] | None = None, columns: list[str] | None = None, start: str | None = None) -> DataFrame:
    """Pruned to states, columns and days at the scan."""
    df = spark.read.parquet(path)
    if states:
        df = df.where(F.col("state_id").isin(states))
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df.select(*columns) if columns else df


def build_if_missing(spark: SparkSession, raw: str, silver: str, states: list[str]) -> list[str]:
    """Builds the states that the silver table lacks, in one job; returns them."""
    lacking = [s for s in states if not exists(spark, f"{silver}/state_id={s}")]
    if lacking:
        write_silver(prepare(*load(spark, raw), lacking), silver)
    return lacking


def states(spark: SparkSession, raw: str) -> list[str]:
    """The states of the raw sales file: a short list."""
    return sorted(r[0] for r in load(spark, raw)[0].select("state_id").distinct().collect())


def snap_flag(df: DataFrame) -> DataFrame:
    """The SNAP flag of each row's own state."""
    out = F.lit(0)
    for c in df.columns:
        if c.startswith("snap_"):
            out = F.when(F.col("state_id") == c[5:], F.col(c)).otherwise(out)
    return df.withColumn("snap", out)


def holidays(calendar: DataFrame) -> DataFrame:
    """Distinct (ds, holiday) of both event columns."""
    both = calendar.select("date", F.explode(F.array("event_name_1", "event_name_2")).alias("holiday"))
    return both.where("holiday is not null").select(F.col("date").alias("ds"), "holiday").distinct()
