"""Dashboards over the index and its members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.scalar import annualised_rate, attribution, in_scope, pct_change, positive_log, signed_value, spread_emphasis
from tickwise.operators.series import (
    cumulative_sum,
    kaufman_average,
    moving_average,
    resample,
    resample_aliased,
    time_shift,
)

KEYS = ["measurement", "ticker"]
WEEK = "7 days"

# Index moves in percent below which a day counts as flat.
FLAT_LIMIT = 0.2


def _labelled(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return df.select("ticker", "ts", F.lit(name).alias("field"), value.alias("value"))


def index_level(index: DataFrame, every: str = WEEK, fn: str = "mean") -> DataFrame:
    return resample(index, every, [("price_change_avg", fn, "value")], KEYS).select("ticker", "ts", "value")


def index_trend(index: DataFrame, every: str = WEEK, fn: str = "mean", n: int = 42, weekly_base: bool = False) -> DataFrame:
    """Log index with its moving and Kaufman averages, shifted back to their centre.

    ``weekly_base`` averages over resampled rows instead of days.
    """
    logs = index.select(*KEYS, "ts", positive_log("price_change_avg").alias("value"))
    base = logs
    average_shift, adaptive_shift = 0.5, 0.15
    if weekly_base:
        base = resample(index, every, [("price_change_avg", "last", "value")], KEYS).withColumn("value", positive_log("value"))
        trend = base
        average_shift = adaptive_shift = 1.5
    else:
        trend = resample(logs, every, [("value", fn, "value")], KEYS)
    average = moving_average(base, "value", n, KEYS).withColumn("ts", time_shift("ts", n, average_shift))
    adaptive = kaufman_average(base, "value", n, KEYS).withColumn("ts", time_shift("ts", n, adaptive_shift))
    return (
        _labelled(trend, "price_change_avg", "value")
        .unionByName(_labelled(average, "moving_average", "moving_average"))
        .unionByName(_labelled(adaptive, "kaufman_average", "kaufman_average"))
    )


def _bands(prefix: str, fn: str) -> list[tuple[str, str, str]]:
    return [(f"{prefix}_low", "min", "a_low"), (f"{prefix}_high", "max", "b_high"), (f"{prefix}_avg", fn, "c_avg")]


def index_bands(index: DataFrame, every: str = WEEK, fn: str = "mean", log: bool = True) -> DataFrame:
    """Index with the band of its lows and highs."""
    bands = resample_aliased(index, every, _bands("price_change", fn), KEYS)
    if log:
        bands = bands.withColumn("value", positive_log("value"))
    return bands.select("ticker", "ts", "field", "value")


def index_change(index: DataFrame) -> DataFrame:
    """Daily and weekly mean change in percent."""
    changes = index.select(*KEYS, "ts", pct_change("price_change_avg", "prev_price_change_avg").alias("value"))
    daily = resample(changes, "1 day", [("value", "mean", "value")], KEYS)
    weekly = resample(changes, WEEK, [("value", "mean", "value")], KEYS)
    return _labelled(daily, "a_daily", "value").unionByName(_labelled(weekly, "b_weekly", "value"))


def index_volume(index: DataFrame, every: str = WEEK, fn: str = "mean", n: int = 42) -> DataFrame:
    """Unit volume, dollar value and its coarse average.

    Volume and price lie in one row, so the join on time is a division.
    """
    rows = index.withColumn("units", F.try_divide("total_trading_value", "price_change_avg"))
    both = resample_aliased(rows, every, [("units", fn, "volume"), ("total_trading_value", fn, "dollar_value")], KEYS)
    coarse = resample(index, f"{n} days", [("total_trading_value", "mean", "value")], KEYS).withColumn(
        "ts", time_shift("ts", n, 0.2)
    )
    return both.select("ticker", "ts", "field", "value").unionByName(_labelled(coarse, "custom_moving_average", "value"))


def index_volume_by_month(index: DataFrame, months: int = 4, n: int = 33) -> DataFrame:
    """Weekly dollar value averaged over month steps, shifted back."""
    weekly = resample(index, WEEK, [("total_trading_value", "mean", "value")], KEYS)
    coarse = resample(weekly, f"{months} months", [("value", "mean", "value")], KEYS)
    return coarse.select("ticker", time_shift("ts", n, 1.5).alias("ts"), "value")


def weekly_unit_volume(index: DataFrame) -> DataFrame:
    """Weekly mean value over weekly mean price; weeks without rows stay, without a value."""
    weekly = resample(
        index, WEEK, [("total_trading_value", "mean", "volume"), ("price_change_avg", "mean", "price")], KEYS, create_empty=True
    )
    return weekly.select("ticker", "ts", F.try_divide("volume", "price").alias("value"))


def flow(changes: DataFrame, included: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Traded value signed by the direction of the day, for the index or its members."""
    value = signed_value("total_trading_value", "price_change_avg", "prev_price_change_avg")
    return changes.filter(in_scope("ticker", included, excluded)).select("ticker", "company", "ts", value.alias("value"))


def annualised_gain(index: DataFrame, base_date: str = "2016-01-01", results_from: str = "2017-01-01") -> DataFrame:
    """Two-week median of the index as a yearly rate since ``base_date``."""
    rows = index.filter((F.col("ts") > F.lit(results_from).cast("timestamp")) & (F.col("price_change_avg") > 1.0))
    medians = resample(rows, "14 days", [("price_change_avg", "median", "value")], KEYS, create_empty=True)
    return medians.select("ticker", "ts", annualised_rate("value", "ts", base_date).alias("value"))


def drawdown_bands(levels: DataFrame, every: str = WEEK, fn: str = "mean") -> DataFrame:
    return resample_aliased(levels, every, _bands("drawdown", fn), KEYS).select("ticker", "ts", "field", "value")


def trend_analysis(segments: DataFrame, fields: tuple[str, ...] = ("regression_variance", "growth"), every: str = WEEK, fn: str = "mean") -> DataFrame:
    """Segment properties over time."""
    return resample_aliased(segments, every, [(f, fn, f) for f in fields], KEYS).select("ticker", "ts", "field", "value")


def member_trends(members: DataFrame, every: str = WEEK, fn: str = "mean", threshold: float = 0.667, included: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Log level of members above a threshold."""
    kept = members.filter(in_scope("ticker", included, excluded))
    levels = resample(kept, every, [("price_change_avg", fn, "value")], [*KEYS, "company"])
    return levels.filter(F.col("value") > threshold).select("ticker", "company", "ts", F.ln("value").alias("value"))


def member_daily_change(members: DataFrame, emphasise: bool = False, included: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Daily change of each member in percent."""
    change = pct_change("price_change_avg", "prev_price_change_avg")
    return members.filter(in_scope("ticker", included, excluded)).select(
        "ticker", "company", "ts", (spread_emphasis(change) if emphasise else change).alias("value")
    )


def member_volumes(members: DataFrame, every: str = WEEK, fn: str = "last", excluded: list[str] | None = None) -> DataFrame:
    kept = members.filter(in_scope("ticker", None, excluded))
    return resample(kept, every, [("total_trading_value", fn, "value")], [*KEYS, "company"]).select(
        "ticker", "company", "ts", "value"
    )


def member_attribution(
    index: DataFrame,
    members: DataFrame,
    relevance: float = 0.5,
    direction: str = "all",
    included: list[str] | None = None,
    excluded: list[str] | None = None,
) -> DataFrame:
    """Each member's share in the index moves, summed up over time.

    ``direction`` keeps days on which the index rose (``bull``), fell (``bear``) or
    stayed ``flat``; anything else keeps all.  The index has one row per day, so the
    join side that may be broadcast is bounded by the calendar.
    """
    rate = pct_change("price_change_avg", "prev_price_change_avg")
    moves = index.select("ts", rate.alias("index"))
    if direction == "bull":
        moves = moves.filter(F.col("index") > FLAT_LIMIT)
    elif direction == "bear":
        moves = moves.filter(F.col("index") < -FLAT_LIMIT)
    elif direction == "flat":
        moves = moves.filter(F.col("index").between(-FLAT_LIMIT, FLAT_LIMIT))
    rows = members.filter(in_scope("ticker", included, excluded)).select("ts", "ticker", "company", rate.alias("member"))
    joined = rows.join(moves, "ts").select(
        "ts", "ticker", "company", attribution("index", "member", relevance).alias("value")
    )
    return joined.withColumn("value", cumulative_sum("value", ["ticker"]))
