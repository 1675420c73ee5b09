"""Six-level roll-ups, node selection, series keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = {
    "item": ["item_id", "dept_id", "cat_id", "store_id", "state_id"],
    "department": ["dept_id", "cat_id", "store_id", "state_id"],
    "category": ["cat_id", "store_id", "state_id"],
    "store": ["store_id", "state_id"],
    "state": ["state_id"],
    "total": [],
}
#: The columns that name a node of each level.
NODE_COLUMNS = {"item": ["item_id", "store_id"], "department": ["dept_id", "store_id"], "category": ["cat_id", "store_id"], "store": ["store_id"], "state": ["state_id"], "total": []}
_ALL = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]


def node_id(level: str) -> Column:
    """level:col=val|col=val, or total:total."""
    cols = NODE_COLUMNS[level]
    return F.concat(F.lit(f"{level}:"), F.concat_ws("|", *(F.concat(F.lit(f"{c}="), c) for c in cols))) if cols else F.lit("total:total")


def roll_up(fact: DataFrame, aggs: list[Column], by: list[str] | None = None) -> DataFrame:
    """All six levels in one pass with grouping sets: level, node_id and the aggregates, for each combination of `by`."""
    by = by or []
    out = fact.groupingSets([[*by, *cols] for cols in LEVELS.values()], *by, *_ALL).agg(F.grouping_id().alias("_g"), *aggs)
    width = len(by) + len(_ALL)
    level, node = F.lit("total"), node_id("total")
    for name, cols in LEVELS.items():
        if cols:
            g = sum(1 << (width - 1 - len(by) - _ALL.index(c)) for c in _ALL if c not in cols)
            level, node = F.when(F.col("_g") == g, name).otherwise(level), F.when(F.col("_g") == g, node_id(name)).otherwise(node)
    return out.select(level.alias("level"), node.alias("node_id"), *by, *(c for c in out.columns if c not in {*by, *_ALL, "_g"}))


def aggregate_level(fact: DataFrame, level: str, value: str = "sales", by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Bottom-up sums to one level."""
    return fact.groupBy(node_id(level).alias("node_id"), *by).agg(F.sum(value).alias(value))


def select_node(fact: DataFrame, node: str) -> DataFrame:
    """The daily series of one node, its id parsed into filters that reach the scan."""
    level, _, rest = node.partition(":")
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    if level != "total":
        parts = dict(p.split("=", 1) for p in rest.split("|"))
        if set(parts) != set(NODE_COLUMNS[level]):
            raise ValueError(f"{node!r} does not name a {level}")
        for c, v in parts.items():
            fact = fact.where(F.col(c) == v)
    return fact.groupBy("date").agg(F.sum("sales").alias("sales"))


def series_keys(fact: DataFrame) -> DataFrame:
    """Distinct item and store with their parents; series_id is the key."""
    return fact.select(F.concat_ws("|", "item_id", "store_id").alias("series_id"), *_ALL).distinct()


def first_items(fact: DataFrame, n: int) -> DataFrame:
    """The rows of the first n item ids."""
    return fact.join(fact.select("item_id").distinct().orderBy("item_id").limit(n), "item_id", "left_semi")


def number_days(calendar: DataFrame) -> DataFrame:
    """A calendar without day labels gets d_1, d_2, ... in order of date."""
    return calendar if "d" in calendar.columns else calendar.withColumn("d", F.concat(F.lit("d_"), F.row_number().over(W.orderBy("date"))))
