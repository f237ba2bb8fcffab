"""Landed pages of price bars and volatility observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.functions.calendar import is_regular_hours, new_york_instant
from tickwise.operators.quality import bar_checks, split
from tickwise.operators.series import forward_fill

# Keys of a bar inside a page.
BAR_KEYS = {
    "c": "closing_price",
    "h": "high_price",
    "l": "low_price",
    "o": "opening_price",
    "t": "market_ts",
    "v": "volume",
    "vw": "volume_weighted_avg_price",
}
PAGE_SCHEMA = (
    "bars MAP<STRING, ARRAY<STRUCT<c: DOUBLE, h: DOUBLE, l: DOUBLE, o: DOUBLE, t: TIMESTAMP, v: BIGINT, vw: DOUBLE>>>, "
    "next_page_token STRING"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).json(path)


def bars_from_pages(pages: DataFrame) -> DataFrame:
    """One row per bar of every ticker of every page."""
    per_ticker = pages.select(F.explode("bars").alias("ticker", "_bars"))
    return per_ticker.select("ticker", F.inline("_bars")).withColumnsRenamed(BAR_KEYS)


def enrich(bars: DataFrame) -> DataFrame:
    """Traded value and the regular-hours flag."""
    return bars.withColumns(
        {
            "total_trading_value": F.col("volume_weighted_avg_price") * F.col("volume"),
            "regular_trading_hours": is_regular_hours("market_ts"),
        }
    )


def validated(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(enriched good bars, rejected bars with reasons)``: all prices and volumes must be positive."""
    good, bad = split(bars, bar_checks())
    return enrich(good), bad


def scan_starts(universe: DataFrame, stored: DataFrame, earliest: str) -> DataFrame:
    """Where to read each ticker from: its last stored time, else New York midnight of ``earliest``."""
    latest = stored.groupBy("ticker").agg(F.max("market_ts").alias("_latest"))
    default = new_york_instant(F.lit(earliest).cast("date"))
    return universe.select("ticker").join(latest, "ticker", "left").select(
        "ticker", F.coalesce("_latest", default).alias("start")
    )


def parse_observation(text: Column | str) -> Column:
    """Number of a text observation; blank, ``.`` and unreadable text are missing."""
    trimmed = F.trim(text)
    return F.when(~trimmed.isin("", "."), trimmed.try_cast("double"))


def volatility(observations: DataFrame) -> DataFrame:
    """Daily volatility values, gaps filled from the last valid day."""
    parsed = observations.select("ticker", "day", parse_observation("value").alias("value"))
    return forward_fill(parsed, "value", ["ticker"])
