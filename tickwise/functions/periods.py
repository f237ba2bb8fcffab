"""Report periods: ``2023A``, ``2023Q1``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickwise.functions.scalar import _c

FIRST_FISCAL_YEAR = 2016


def period_label(year: Column | str, period: Column | str) -> Column:
    """``(2023, "Q1")`` → ``2023Q1``."""
    return F.concat(_c(year).cast("string"), _c(period))


def parse_period(label: Column | str) -> Column:
    """``2023Q1`` → ``(fiscal_year, period)``; NULL fields when malformed."""
    label = _c(label)
    shaped = label.rlike("^[0-9]{4}(A|Q[1-4])$")
    return F.struct(
        F.when(shaped, F.substring(label, 1, 4).cast("int")).alias("fiscal_year"),
        F.when(shaped, F.substring(label, 5, 2)).alias("period"),
    )


def statement_key(year: Column | str, period: Column | str) -> Column:
    """Key of a period inside the line-item maps: ``2023`` or ``2023-Q1``."""
    year = _c(year).cast("string")
    return F.when(_c(period) == "A", year).otherwise(F.concat(year, F.lit("-"), _c(period)))


def latest_annual(as_of: Column) -> Column:
    return period_label(F.year(as_of) - 1, F.lit("A"))


def latest_quarter(as_of: Column) -> Column:
    """The last quarter that has ended before ``as_of``'s quarter."""
    ended = F.add_months(F.trunc(as_of, "quarter"), -3)
    return period_label(F.year(ended), F.concat(F.lit("Q"), F.quarter(ended)))


def annual_periods(as_of: Column, first_year: int = FIRST_FISCAL_YEAR) -> Column:
    """Array of ``(fiscal_year, period)`` for all ended fiscal years."""
    last = F.year(as_of) - 1
    years = F.filter(F.sequence(F.lit(first_year), F.greatest(last, F.lit(first_year))), lambda y: y <= last)
    return F.transform(years, lambda y: F.struct(y.alias("fiscal_year"), F.lit("A").alias("period")))


def quarter_periods(as_of: Column, first_year: int = FIRST_FISCAL_YEAR) -> Column:
    """Array of ``(fiscal_year, period)`` for all ended quarters."""
    ended = F.year(as_of) * 4 + F.quarter(as_of) - 2
    first = F.lit(first_year * 4)
    numbers = F.filter(F.sequence(first, F.greatest(ended, first)), lambda n: n <= ended)
    return F.transform(
        numbers,
        lambda n: F.struct(
            F.floor(n / 4).cast("int").alias("fiscal_year"),
            F.concat(F.lit("Q"), (n % 4 + 1).cast("string")).alias("period"),
        ),
    )
