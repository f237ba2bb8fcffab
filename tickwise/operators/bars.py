"""Price bars: daily roll-up, traded value, scan bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.calendar import is_bank_day, is_regular_hours, is_session_time, new_york_instant, trading_day
from tickwise.session import fresh_path
from tickwise.sources import store

PRICES = ["opening_price", "closing_price", "high_price", "low_price", "volume_weighted_avg_price"]


def _order(order: list[str]) -> Column:
    return F.struct(*order) if len(order) > 1 else F.col(order[0])


def daily_bars(bars: DataFrame, regular_hours: bool = True, order: list[str] | None = None, weighted: bool = False) -> DataFrame:
    """One bar per ticker and New York bank day.

    Open is the first bar's open, close the last bar's close, the average price the
    plain mean of the bars' averages (``weighted`` weighs by volume instead).  All
    parts combine on the map side.
    """
    order = order or ["market_ts"]
    open_now = is_regular_hours("market_ts") if regular_hours else is_bank_day(trading_day("market_ts"))
    mean = F.avg("volume_weighted_avg_price")
    if weighted:
        mean = F.try_divide(F.sum(F.col("volume_weighted_avg_price") * F.col("volume")), F.sum("volume"))
    return (
        bars.filter(open_now)
        .groupBy("ticker", trading_day("market_ts").alias("day"))
        .agg(
            F.min("company").alias("company"),
            F.min("market_ts").alias("market_ts"),
            F.min_by("opening_price", _order(order)).alias("opening_price"),
            F.max_by("closing_price", _order(order)).alias("closing_price"),
            F.max("high_price").alias("high_price"),
            F.min("low_price").alias("low_price"),
            mean.alias("volume_weighted_avg_price"),
            F.sum("total_trading_value").alias("total_trading_value"),
        )
    )


FLAVOURS = ("regular", "extended")


def daily_bars_both(bars: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Regular and extended bars of each ticker and bank day: columns ``regular`` (null where there is none) and ``extended``.

    A first pass aggregates by hash, and its small result is stored. First and last prices need the whole ``order``, whose first
    column is the bars' time: a second pass reads the bars at each day's first and last times and sorts only these.
    """
    order = order or ["market_ts"]
    days = store.staged(_day_groups(bars), fresh_path(bars.sparkSession, "days"))
    return _both_flavours(days, _end_prices(bars, _end_times(days), order))


def _day_groups(bars: DataFrame) -> DataFrame:
    """Sums and bounds per ticker, company and bank day, by hash: names are keys, all else has a fixed width.

    A group lies within a New York day, so the calendar is asked once a group, of its first time.
    """
    marked = bars.select("*", trading_day("market_ts").alias("_day"), is_session_time("market_ts").alias("_regular"))

    def of(name: str) -> list[Column]:
        mine = (lambda c: F.when(F.col("_regular"), F.col(c))) if name == "regular" else F.col
        return [
            F.min(mine("market_ts")).alias(f"{name}_market_ts"),
            F.max(mine("market_ts")).alias(f"{name}_latest"),
            F.max(mine("high_price")).alias(f"{name}_high_price"),
            F.min(mine("low_price")).alias(f"{name}_low_price"),
            F.sum(mine("volume_weighted_avg_price")).alias(f"{name}_prices"),
            F.count(mine("volume_weighted_avg_price")).alias(f"{name}_priced"),
            F.sum(mine("total_trading_value")).alias(f"{name}_total_trading_value"),
        ]

    grouped = marked.groupBy("ticker", "company", "_day").agg(*[c for name in FLAVOURS for c in of(name)])
    day = trading_day("extended_market_ts")
    return grouped.filter(is_bank_day(day)).withColumn("day", day).drop("_day")


def _end_times(days: DataFrame) -> DataFrame:
    """The first and last times of each ticker's day, of regular hours and of all."""
    ends = [end for name in FLAVOURS for end in (F.min(f"{name}_market_ts"), F.max(f"{name}_latest"))]
    bounds = days.groupBy("ticker", "day").agg(*[end.alias(f"_end{i}") for i, end in enumerate(ends)])
    times = F.array_distinct(F.array_compact(F.array(*[f"_end{i}" for i in range(len(ends))])))
    return bounds.select(F.col("ticker").alias("_ticker"), F.explode(times).alias("_at"))


def _end_prices(bars: DataFrame, times: DataFrame, order: list[str]) -> DataFrame:
    """First open and last close per ticker and day, of regular hours and of all, from the bars of the given times."""
    held = bars.join(times, F.col("ticker").eqNullSafe(F.col("_ticker")) & (F.col("market_ts") == F.col("_at")))
    by = _order(order)
    ends = held.groupBy("ticker", "market_ts").agg(F.min_by("opening_price", by).alias("opening_price"), F.max_by("closing_price", by).alias("closing_price"))
    regular = F.when(is_session_time("market_ts"), F.col("market_ts"))
    return ends.groupBy(F.col("ticker").alias("_ticker"), trading_day("market_ts").alias("_day")).agg(
        F.min_by("opening_price", regular).alias("regular_opening_price"),
        F.max_by("closing_price", regular).alias("regular_closing_price"),
        F.min_by("opening_price", "market_ts").alias("extended_opening_price"),
        F.max_by("closing_price", "market_ts").alias("extended_closing_price"),
    )


def _both_flavours(days: DataFrame, prices: DataFrame) -> DataFrame:
    def of(name: str) -> list[Column]:
        return [
            F.min(F.when(F.col(f"{name}_market_ts").isNotNull(), F.col("company"))).alias(f"{name}_company"),
            F.min(f"{name}_market_ts").alias(f"{name}_market_ts"),
            F.max(f"{name}_high_price").alias(f"{name}_high_price"),
            F.min(f"{name}_low_price").alias(f"{name}_low_price"),
            F.try_divide(F.sum(f"{name}_prices"), F.sum(f"{name}_priced")).alias(f"{name}_volume_weighted_avg_price"),
            F.sum(f"{name}_total_trading_value").alias(f"{name}_total_trading_value"),
        ]

    columns = ["company", "market_ts", *PRICES[:4], "volume_weighted_avg_price", "total_trading_value"]
    grouped = days.groupBy("ticker", "day").agg(*[c for name in FLAVOURS for c in of(name)])
    grouped = grouped.join(prices, F.col("ticker").eqNullSafe(F.col("_ticker")) & F.col("day").eqNullSafe(F.col("_day")))
    row = lambda name: F.struct("ticker", "day", *[F.col(f"{name}_{c}").alias(c) for c in columns])
    return grouped.select(F.when(F.col("regular_market_ts").isNotNull(), row("regular")).alias("regular"), row("extended").alias("extended"))


def price_change_rollup(changes: DataFrame, step: Column, ts: str = "ts") -> DataFrame:
    """The roll-up of bars applied to price-change rows, per ticker and ``step``."""
    return changes.groupBy("measurement", "ticker", step.alias("period")).agg(
        F.min("company").alias("company"),
        F.min(ts).alias(ts),
        F.min_by("price_change_open", ts).alias("price_change_open"),
        F.max_by("price_change_close", ts).alias("price_change_close"),
        F.max("price_change_high").alias("price_change_high"),
        F.min("price_change_low").alias("price_change_low"),
        F.avg("price_change_avg").alias("price_change_avg"),
        F.avg("prev_price_change_avg").alias("prev_price_change_avg"),
        F.sum("total_trading_value").alias("total_trading_value"),
    )


def time_bounds(df: DataFrame, ts: str = "market_ts") -> DataFrame:
    """Earliest and latest time per ticker."""
    return df.groupBy("ticker").agg(F.min(ts).alias("earliest"), F.max(ts).alias("latest"))


def first_since(df: DataFrame, value: str, since: str | None = None, ts: str = "market_ts", order: list[str] | None = None) -> DataFrame:
    """First row's value per ticker at or after ``since``."""
    kept = df.filter(F.col(ts) >= F.lit(since).cast("timestamp")) if since else df
    return kept.groupBy("ticker").agg(F.min(ts).alias(ts), F.min_by(value, _order(order or [ts])).alias(value))


def monthly_traded_value(bars: DataFrame, include_last_day: bool = False, digits: int | None = 2) -> DataFrame:
    """Traded value per ticker and month (``YYYY-MM``), rounded half up to ``digits`` places.

    The stored totals stop at the New York midnight that begins the month's last
    day; ``include_last_day`` covers the whole month.
    """
    local_day = trading_day("market_ts")
    kept = bars if include_last_day else bars.filter(F.col("market_ts") < new_york_instant(F.last_day(local_day)))
    total = F.sum("total_trading_value")
    return kept.groupBy("ticker", F.date_format(local_day, "yyyy-MM").alias("month")).agg(
        (total if digits is None else F.round(total, digits)).alias("total_trading_value")
    )


def top_by_value(totals: DataFrame, n: int, value: str = "total_trading_value") -> DataFrame:
    """The ``n`` tickers of largest value; ties by ticker."""
    return totals.orderBy(F.desc(value), "ticker").limit(n)


def top_tickers(df: DataFrame, n: int, days: int | None = None, as_of: Column | None = None, day: str = "day") -> DataFrame:
    """Tickers with the largest traded value over the last ``days`` before ``as_of``.

    ``as_of`` defaults to the last day of the data, read as a scalar subquery.
    """
    if days is not None:
        if as_of is None:
            as_of = df.select(F.max(day)).scalar()
        df = df.filter(F.col(day) >= F.date_sub(as_of, days))
    return top_by_value(df.groupBy("ticker").agg(F.sum("total_trading_value").alias("total_trading_value")), n)


def earliest_touched(starts: DataFrame, start: str = "start") -> DataFrame:
    """The earliest date any ticker was read from: where stored results turn stale."""
    return starts.agg(F.to_date(F.min(start)).alias("stale_from"))
