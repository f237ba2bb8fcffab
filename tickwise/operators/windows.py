"""Tumbling-window aggregates over quotes and trades, and window-to-window deltas.

Quotes are first reduced to *price levels* (one row per window, symbol, side and
price).  That reduction combines on the map side and spreads a hot symbol over its
prices, so what reaches the per-window step is bounded by the distinct prices of
one window and not by the number of quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickwise.functions.scalar import measure_id
from tickwise.operators.series import packed_order

QUOTE_WINDOWS = "quotation-aggregates-tumbling-window"
TRADE_WINDOWS = "trade-aggregates-tumbling-window"
QUOTE_DELTAS = "quotation-deltas"
TRADE_DELTAS = "trade-deltas"

QUOTE_METRICS = [
    "record_count",
    "min_ask_price",
    "min_bid_price",
    "max_ask_price",
    "max_bid_price",
    "sum_ask_quantity",
    "sum_bid_quantity",
    "sum_ask_notional",
    "sum_bid_notional",
    "volume_weighted_avg_ask_price",
    "volume_weighted_avg_bid_price",
    "bid_ask_spread",
    "spread_midpoint",
    "order_imbalance",
]
TRADE_METRICS = [
    "record_count",
    "min_price",
    "max_price",
    "sum_quantity",
    "sum_notional",
    "volume_weighted_avg_price",
]

# Outlier width and the factor that scales a median deviation to a standard deviation.
OUTLIER_WIDTH = 4.0
DEVIATION_SCALE = 1.4826


def _window(ts: str, every: str | Column, slide: str | None) -> Column:
    if isinstance(every, Column):
        return every
    return F.window(ts, every, slide) if slide else F.window(ts, every)


# --- trades ----------------------------------------------------------------


def trade_windows(
    trades: DataFrame, every: str | Column = "5 minutes", slide: str | None = None, tie_break: str | None = "trade_id"
) -> DataFrame:
    """Aggregates per symbol and window; first and last price by event time. ``every`` is a length or a window column.

    Time and trade id are packed into one number, so the raw trades are aggregated by
    hash. With ``tie_break=None`` trades of one symbol are taken to have distinct times.
    """
    order = F.col("market_ts")
    if tie_break:
        packed = packed_order(trades, ["market_ts", tie_break])
        order = F.struct("market_ts", tie_break) if packed is None else packed
    grouped = trades.groupBy(F.col("symbol").alias("ticker"), _window("market_ts", every, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min_by("price", order).alias("price_at_window_start"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.max_by("price", order).alias("price_at_window_end"),
        F.sum("lot_size").alias("sum_quantity"),
        F.sum(F.col("price") * F.col("lot_size")).alias("sum_notional"),
    )
    vwap = F.when(F.col("sum_quantity") == 0, 0.0).otherwise(F.try_divide("sum_notional", "sum_quantity"))
    return grouped.select(
        measure_id(TRADE_WINDOWS, "ticker", F.col("w.start")).alias("measure_id"),
        "ticker",
        F.col("w.start").alias("window_start_time"),
        F.col("w.end").alias("window_end_time"),
        "record_count",
        "price_at_window_start",
        "min_price",
        "max_price",
        "price_at_window_end",
        "sum_quantity",
        "sum_notional",
        vwap.alias("volume_weighted_avg_price"),
    )


# --- quotes ----------------------------------------------------------------


def quote_levels(quotes: DataFrame, every: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Quotes reduced to one row per symbol, window, side and price."""
    sides = F.array(
        F.struct(F.lit("ask").alias("side"), F.col("ask_price").alias("price"), F.col("ask_lot").alias("lot")),
        F.struct(F.lit("bid").alias("side"), F.col("bid_price").alias("price"), F.col("bid_lot").alias("lot")),
    )
    return (
        quotes.select("symbol", "market_ts", F.inline(sides))
        .groupBy(F.col("symbol").alias("ticker"), _window("market_ts", every, slide).alias("w"), "side", "price")
        .agg(
            F.count(F.lit(1)).alias("quotes"),
            F.sum("lot").alias("lots"),
            F.max("market_ts").alias("last_ts"),
        )
    )


def weighted_median(value: str, weight: str, keys: list[str]) -> tuple[Column, Column, Column]:
    """Exact median of ``value`` repeated ``weight`` times, per ``keys``.

    Returns ``(running, total, median)``: put the first two in one projection as
    ``_running`` and ``_total``, the third (over the same keys) in the next.  An even
    count averages the two middle values.
    """
    by = Window.partitionBy(*keys)
    running = F.sum(weight).over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(by)
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    median = (
        F.min(F.when(F.col("_running") >= low, F.col(value))).over(by)
        + F.min(F.when(F.col("_running") >= high, F.col(value))).over(by)
    ) / 2
    return running, total, median


def flag_outliers(levels: DataFrame, keys: list[str], value: str = "price", weight: str = "quotes") -> DataFrame:
    """Add ``median``, ``deviation`` (scaled median absolute deviation) and ``kept``.

    A value is kept while its distance to the median is at most four scaled
    deviations; with a deviation of zero only the median itself is kept.
    """
    running, total, median = weighted_median(value, weight, keys)
    centred = levels.select("*", running.alias("_running"), total.alias("_total")).select(
        *levels.columns, median.alias("median")
    )
    centred = centred.withColumn("_distance", F.abs(F.col(value) - F.col("median")))
    running, total, spread = weighted_median("_distance", weight, keys)
    return (
        centred.select("*", running.alias("_running"), total.alias("_total"))
        .select(*levels.columns, "median", "_distance", (spread * DEVIATION_SCALE).alias("deviation"))
        .withColumn("kept", F.col("_distance") <= F.lit(OUTLIER_WIDTH) * F.col("deviation"))
        .drop("_distance")
    )


def quote_windows_from_levels(levels: DataFrame, closing: bool = False) -> DataFrame:
    """Second half of ``quote_windows``: outlier rule and per-window metrics.

    The outlier rule limits min and max only; counts and sums cover every quote.
    ``closing`` adds the last bid and ask of the window (ties in time: the higher price).
    """
    # One distribution serves the outlier windows and the aggregate below.
    flagged = flag_outliers(levels.repartition("ticker", "w"), ["ticker", "w", "side"])

    def side(name: str, expr: Column) -> Column:
        return F.when(F.col("side") == name, expr)

    price, kept = F.col("price"), F.when(F.col("kept"), F.col("price"))
    aggregates = [F.sum(side("ask", F.col("quotes"))).alias("record_count")]
    for name in ("ask", "bid"):
        aggregates += [
            F.min(side(name, kept)).alias(f"min_{name}_price"),
            F.max(side(name, kept)).alias(f"max_{name}_price"),
            F.sum(side(name, F.col("lots"))).alias(f"sum_{name}_quantity"),
            F.sum(side(name, price * F.col("lots"))).alias(f"sum_{name}_notional"),
        ]
        if closing:
            last = F.max(side(name, F.struct("last_ts", "price")))
            aggregates.append(last["price"].alias(f"{name}_price_at_window_end"))
    grouped = flagged.groupBy("ticker", "w").agg(*aggregates)

    ask_qty, bid_qty = F.col("sum_ask_quantity"), F.col("sum_bid_quantity")
    with_vwap = grouped.select(
        "*",
        F.when(ask_qty > 0, F.try_divide("sum_ask_notional", ask_qty)).otherwise(0.0).alias("volume_weighted_avg_ask_price"),
        F.when(bid_qty > 0, F.try_divide("sum_bid_notional", bid_qty)).otherwise(0.0).alias("volume_weighted_avg_bid_price"),
    )
    ask, bid = F.col("volume_weighted_avg_ask_price"), F.col("volume_weighted_avg_bid_price")
    total = ask_qty + bid_qty
    return with_vwap.select(
        measure_id(QUOTE_WINDOWS, "ticker", F.col("w.start")).alias("measure_id"),
        "ticker",
        F.col("w.start").alias("window_start_time"),
        F.col("w.end").alias("window_end_time"),
        "record_count",
        "min_ask_price",
        "min_bid_price",
        "max_ask_price",
        "max_bid_price",
        "sum_ask_quantity",
        "sum_bid_quantity",
        "sum_ask_notional",
        "sum_bid_notional",
        ask.alias("volume_weighted_avg_ask_price"),
        bid.alias("volume_weighted_avg_bid_price"),
        (ask - bid).alias("bid_ask_spread"),
        ((bid + ask) / 2).alias("spread_midpoint"),
        F.when(total > 0, F.try_divide(bid_qty - ask_qty, total)).otherwise(0.0).alias("order_imbalance"),
        *(["ask_price_at_window_end", "bid_price_at_window_end"] if closing else []),
    )


def quote_windows(
    quotes: DataFrame, every: str = "5 minutes", slide: str | None = None, closing: bool = False
) -> DataFrame:
    """Aggregates per symbol and window over both sides of the book."""
    return quote_windows_from_levels(quote_levels(quotes, every, slide), closing)


def all_assets(stocks: DataFrame, crypto: DataFrame) -> DataFrame:
    """Window results of both asset classes in one table."""
    return stocks.unionByName(crypto)


# --- deltas ----------------------------------------------------------------


def window_deltas(windows: DataFrame, metrics: list[str], measurement: str, dedupe: bool = False) -> DataFrame:
    """Each metric minus its value in the ticker's previous window; first windows emit nothing.

    Windows come out of the aggregates once per ticker and end, so repeated ones
    only occur when stored results are unioned: ``dedupe`` drops them first.
    """
    if dedupe:
        windows = windows.dropDuplicates(["ticker", "window_end_time"])
    by = Window.partitionBy("ticker").orderBy("window_end_time")
    return (
        windows.select(
            "ticker",
            F.col("window_end_time").alias("timestamp"),
            F.lag("window_end_time").over(by).alias("_previous"),
            *[(F.col(m) - F.lag(m).over(by)).alias(f"{m}_delta") for m in metrics],
        )
        .filter(F.col("_previous").isNotNull())
        .select(
            measure_id(measurement, "ticker", "timestamp").alias("measure_id"),
            "ticker",
            "timestamp",
            *[f"{m}_delta" for m in metrics],
        )
    )


def quote_deltas(windows: DataFrame, dedupe: bool = False) -> DataFrame:
    return window_deltas(windows, QUOTE_METRICS, QUOTE_DELTAS, dedupe)


def trade_deltas(windows: DataFrame, dedupe: bool = False) -> DataFrame:
    return window_deltas(windows, TRADE_METRICS, TRADE_DELTAS, dedupe)
