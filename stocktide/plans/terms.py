"""Trading terms by category: what a unit earns and how often a shelf is looked after. Fixed values of the test catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import lookup

_MARGIN = {"ECONOMY": 0.25, "STANDARD": 0.30, "PROMO": 0.40}
_REVIEW = {"ECONOMY": 2}
LEAD_DAYS = 1


def margin(category: str = "cat_id") -> Column:
    """Of the price."""
    return lookup(_MARGIN, F.col(category), 0.30)


def protection_days(category: str = "cat_id") -> Column:
    """Days that a stock must last: until the next look and its delivery."""
    return F.lit(LEAD_DAYS) + lookup(_REVIEW, F.col(category), 7)


#: The same in SQL.
SQL_MARGIN = "CASE cat_id WHEN 'ECONOMY' THEN 0.25 WHEN 'STANDARD' THEN 0.30 WHEN 'PROMO' THEN 0.40 ELSE 0.30 END"
SQL_DAYS = "(1 + CASE cat_id WHEN 'ECONOMY' THEN 2 ELSE 7 END)"
