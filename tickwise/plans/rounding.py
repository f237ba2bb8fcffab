"""Doubles as results show them.

Two engines add in different orders, so the last bits of a sum differ. Single precision
keeps seven digits of any size of number and no short decimal lies between two of
its values; nine places cut what is left where differences cancel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 9


def shown(column: Column) -> Column:
    return F.round(column, PLACES).cast("float").cast("double")


def shown_sql(expression: str) -> str:
    """The same in SQL, without a negative zero."""
    return f"(CAST(CAST(round({expression}, {PLACES}) AS FLOAT) AS DOUBLE) + 0.0)"
