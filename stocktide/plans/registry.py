"""Named queries with their SQL. CTES are the shared parts of the SQL; each oracle gets those that it names, in order."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.retail import EVENTS, MATRIX_DAYS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BODIES: dict[str, str] = {}  # SQL of queries, without its CTEs

_EVENT = "CASE strftime(date, '%m-%d') " + " ".join(f"WHEN '{d}' THEN '{n}'" for d, n in EVENTS.items()) + " END"
CTES = {
    "fact": "SELECT 'P' || l_partkey AS item_id, p_type || '_' || p_brand AS dept_id, p_type AS cat_id, n_name AS store_id, r_name AS state_id, CAST(l_shipdate AS DATE) AS date, l_quantity AS sales, l_extendedprice AS revenue, l_extendedprice / l_quantity AS sell_price FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "bounds": "SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem",
    "day_list": "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date, lo, hi FROM bounds",
    "cal": f"SELECT date, CAST(date - lo AS INTEGER) AS day_idx, 'd_' || (date - lo + 1) AS d, CAST(11101 + (date - lo) // 7 AS INTEGER) AS wm_yr_wk, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(day(date) AS INTEGER) AS day, CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS week, CAST(year(date) AS INTEGER) AS year, {_EVENT} AS event_name, CASE WHEN day(date) <= 10 THEN 1 ELSE 0 END AS snap FROM day_list",
    "p1": "SELECT s.cat_id || '|' || s.state_id AS series_id, s.cat_id, s.state_id, c.date, c.day_idx, coalesce(f.sales, 0) AS sales, coalesce(f.revenue, 0) AS revenue, f.revenue / f.sales AS price FROM (SELECT DISTINCT cat_id, state_id FROM fact) s CROSS JOIN cal c LEFT JOIN (SELECT cat_id, state_id, date, sum(sales) AS sales, sum(revenue) AS revenue FROM fact GROUP BY ALL) f ON f.cat_id = s.cat_id AND f.state_id = s.state_id AND f.date = c.date",
    "pn": "SELECT s.cat_id || '|' || s.store_id || '|' || s.state_id AS series_id, s.cat_id, s.store_id, s.state_id, c.date, c.day_idx, coalesce(f.sales, 0) AS sales FROM (SELECT DISTINCT cat_id, store_id, state_id FROM fact) s CROSS JOIN cal c LEFT JOIN (SELECT cat_id, store_id, state_id, date, sum(sales) AS sales FROM fact GROUP BY ALL) f ON f.cat_id = s.cat_id AND f.store_id = s.store_id AND f.state_id = s.state_id AND f.date = c.date",
    "p2": f"SELECT s.dept_id || '|' || s.cat_id || '|' || s.state_id AS series_id, s.dept_id, s.cat_id, s.state_id, c.date, c.day_idx, coalesce(f.sales, 0) AS sales, coalesce(f.revenue, 0) AS revenue, f.revenue / f.sales AS price FROM (SELECT DISTINCT dept_id, cat_id, state_id FROM fact) s CROSS JOIN (SELECT cal.date, cal.day_idx FROM cal, bounds WHERE cal.date >= hi - {MATRIX_DAYS - 1}) c LEFT JOIN (SELECT dept_id, cat_id, state_id, date, sum(sales) AS sales, sum(revenue) AS revenue FROM fact GROUP BY ALL) f ON f.dept_id = s.dept_id AND f.cat_id = s.cat_id AND f.state_id = s.state_id AND f.date = c.date",
}


def define(name: str, sql: str) -> None:
    CTES[name] = sql


def oracle(body: str) -> str:
    """body with every CTE that it or its CTEs name."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for n in CTES:
            if n not in need and re.search(rf"(?<![\w.']){n}\b(?!['(])", text):
                need.add(n)
                visit(CTES[n])

    visit(body)
    ordered: list[str] = []

    def put(n: str) -> None:
        if n in ordered:
            return
        for m in CTES:
            if m != n and m in need and re.search(rf"(?<![\w.']){m}\b(?!['(])", CTES[n]):
                put(m)
        ordered.append(n)

    for n in CTES:
        if n in need:
            put(n)
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" if ordered else "") + body


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            BODIES[f.__name__] = sql
        return f

    return add
