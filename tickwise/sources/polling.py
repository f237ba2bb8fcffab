"""Re-reading a stored series from where the last results end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.calendar import NEW_YORK, is_weekend

# New York hours between which polling runs, and its pace.
FIRST_HOUR, LAST_HOUR = 4, 21
PACE = "20 minutes"


def in_polling_hours(ts: Column | str) -> Column:
    """Weekdays from 4 to 21 o'clock in New York."""
    local = F.from_utc_timestamp(ts, NEW_YORK)
    return ~is_weekend(F.to_date(local)) & F.hour(local).between(FIRST_HOUR, LAST_HOUR)


def rows_to_process(series: DataFrame, results: DataFrame, earliest: str, ts: str = "ts") -> DataFrame:
    """Series rows at or after the newest result; all from ``earliest`` when there is none.

    The newest result is a scalar subquery, so its value prunes the series scan.
    """
    newest = results.select(F.max(ts)).scalar()
    return series.filter(F.col(ts) >= F.coalesce(newest, F.lit(earliest).cast("timestamp")))
