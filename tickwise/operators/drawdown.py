"""Drawdown levels and the labels derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SERIES = ("measurement", "ticker")
FIELDS = ["low", "avg", "high"]

# Dip size in percent → level at or below which the dip counts.
DIP_LEVELS = {3: 97, 5: 95, 8: 92, 13: 87}


def _by(keys: list[str], ts: str):
    return Window.partitionBy(*keys).orderBy(ts)


def drawdown(df: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", as_of: str | None = None) -> DataFrame:
    """Percentage of the running maximum for the low, average and high change.

    The maximum starts at zero, so a series that has never been positive has no level.
    Rows on or after ``as_of`` (today) are provisional: they are measured against the
    maximum but do not raise it for later rows.
    """
    before = _by(keys, ts).rowsBetween(Window.unboundedPreceding, -1)
    final = F.col(ts) < F.lit(as_of).cast("timestamp") if as_of else F.lit(True)

    def level(column: str) -> Column:
        earlier = F.max(F.when(final, F.col(column))).over(before)
        top = F.greatest(F.lit(0.0), earlier, F.col(column))
        return F.try_divide(F.col(column), top) * 100

    return df.select(
        *keys,
        ts,
        *[f"price_change_{f}" for f in FIELDS],
        *[level(f"price_change_{f}").alias(f"drawdown_{f}") for f in FIELDS],
    )


def days_since_dip(level: str, keys: list[str], ts: str = "ts") -> list[Column]:
    """Rows since the level was last at or below each dip; zero on a dip row."""
    by = _by(keys, ts)
    row = F.row_number().over(by)
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for size, limit in DIP_LEVELS.items():
        last_dip = F.max(F.when(F.col(level) <= limit, F.col("_row"))).over(running)
        out.append((row - F.coalesce(last_dip, F.lit(0))).alias(f"days_since_dip_of_{size}"))
    return out


def forward_extreme(level: str, rows: int, keys: list[str], ts: str = "ts") -> Column:
    """Deepest level over the next ``rows`` rows; the own level where there are none."""
    if rows == 0:
        return F.col(level)
    return F.coalesce(F.min(level).over(_by(keys, ts).rowsBetween(1, rows)), F.col(level))


def drawdown_labels(levels: DataFrame, forward_rows: int = 0, level: str = "drawdown_low", keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Current level, next row's level (0.0 on the last), dip ages and forward extreme."""
    by = _by(keys, ts)
    numbered = levels.select(*keys, ts, level, F.row_number().over(by).alias("_row"))
    return numbered.select(
        *keys,
        ts,
        F.col(level).alias("current_drawdown"),
        F.lead(level, 1, 0.0).over(by).alias("drawdown_next_bank_day"),
        *days_since_dip(level, keys, ts),
        forward_extreme(level, forward_rows, keys, ts).alias("forward_max_drawdown"),
    )
