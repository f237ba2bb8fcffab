"""Live dashboards over window results: pressure, totals, microstructure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickwise.functions.scalar import in_scope, non_zero, pct_change, rename_by, sign, symmetric_rate
from tickwise.operators.series import cumulative_sum, difference, first_value, fixed_lag, live_step

# Field of the window results → name on the dashboard.
QUOTE_FIELDS = {
    "volume_weighted_avg_ask_price": "vwap_ask",
    "volume_weighted_avg_bid_price": "vwap_bid",
    "sum_ask_notional": "ask_notional",
    "sum_bid_notional": "bid_notional",
    "sum_ask_quantity": "ask_quantity",
    "sum_bid_quantity": "bid_quantity",
}
TRADE_FIELDS = {
    "volume_weighted_avg_price": "vwap_price",
    "sum_notional": "trade_notional",
    "sum_quantity": "trade_quantity",
}
VWAPS = ["vwap_ask", "vwap_bid", "vwap_price"]
RATES = ["agree_score", "ask_change_rate", "bid_change_rate", "concession", "imbalance", "mid_change", "spread_change", "trade_position"]
MOVES = ["ask_change", "bid_change", "spread"]
AMOUNTS = ["ask_notional", "bid_notional", "trade_notional", "ask_quantity", "bid_quantity", "trade_quantity"]


def merged_windows(
    quotes: DataFrame,
    trades: DataFrame,
    quote_fields: dict[str, str] = QUOTE_FIELDS,
    trade_fields: dict[str, str] = TRADE_FIELDS,
    look_back: str | None = None,
    included: list[str] | None = None,
    excluded: list[str] | None = None,
    skip_zero: bool = True,
) -> DataFrame:
    """Quote and trade windows side by side per ticker and time.

    The two results are unioned and distributed by ticker once; the merge per time and
    every later per-ticker window reuse that distribution.  Zero values count as
    missing, and longer look-backs are averaged over coarser steps.
    """

    def fields(df: DataFrame, names: dict[str, str]) -> DataFrame:
        kept = df.filter(in_scope("ticker", included, excluded))
        return kept.select(
            "ticker",
            F.col("window_end_time").alias("ts"),
            *[(non_zero(c) if skip_zero else F.col(c)).alias(n) for c, n in names.items()],
        )

    both = fields(quotes, quote_fields).unionByName(fields(trades, trade_fields), allowMissingColumns=True)
    names = [*quote_fields.values(), *trade_fields.values()]
    step = live_step(look_back) if look_back else None
    both = both.repartition("ticker")
    if step is None:
        return both.groupBy("ticker", "ts").agg(*[F.max(n).alias(n) for n in names])
    stepped = both.groupBy("ticker", F.window("ts", step).alias("w")).agg(*[F.avg(n).alias(n) for n in names])
    return stepped.select("ticker", F.col("w.end").alias("ts"), *names)


def _with_previous(df: DataFrame, columns: list[str]) -> DataFrame:
    by = Window.partitionBy("ticker").orderBy("ts")
    previous = df.select("*", *[F.lag(c).over(by).alias(f"prev_{c}") for c in columns])
    moved = F.col("vwap_price") - F.col("prev_vwap_price") != 0
    usable = [F.col(f"prev_{c}") != 0 for c in columns]
    for condition in [moved, *usable]:
        previous = previous.filter(condition)
    return previous


def _metrics(df: DataFrame) -> DataFrame:
    a, b, p = F.col("vwap_ask"), F.col("vwap_bid"), F.col("vwap_price")
    rates = df.select(
        "*",
        symmetric_rate(a, b).alias("_spread_rate"),
        symmetric_rate("prev_vwap_ask", "prev_vwap_bid").alias("_prev_spread_rate"),
        symmetric_rate("prev_vwap_ask", a).alias("ask_change_rate"),
        symmetric_rate(b, "prev_vwap_bid").alias("bid_change_rate"),
        ((a + b) / 2).alias("_mid"),
        (F.col("bid_notional") + F.col("ask_notional")).alias("_quoted"),
    )
    spread = F.col("_spread_rate")
    moves = rates.select(
        "*",
        (F.col("bid_change_rate") - F.col("ask_change_rate")).alias("concession"),
        F.when(F.col("_quoted") > 0, F.try_divide(F.col("bid_notional") - F.col("ask_notional"), F.col("_quoted")))
        .otherwise(0.0)
        .alias("imbalance"),
        (F.col("_prev_spread_rate") - spread).alias("spread_change"),
        F.when(spread > 0, F.try_divide(symmetric_rate(p, "_mid"), F.greatest(spread, F.lit(0.01))))
        .otherwise(0.0)
        .alias("trade_position"),
    )
    return moves.select(
        "ts",
        "ticker",
        "ask_change_rate",
        "bid_change_rate",
        "concession",
        "imbalance",
        (F.col("concession") * 0.5).alias("mid_change"),
        "spread_change",
        "trade_position",
        F.when(sign("concession") == sign("trade_position"), 1).otherwise(0).alias("agree"),
        ((F.lit(1.0) + F.col("concession")) * F.col("trade_position")).alias("agree_score"),
        *AMOUNTS,
    )


def microstructure_metrics(quotes: DataFrame, trades: DataFrame, **options) -> DataFrame:
    """How quotes move between windows and whether trades follow.

    Needs all nine inputs; rows without a change in the trade price are left out.
    """
    wide = merged_windows(quotes, trades, **options).dropna(subset=VWAPS + AMOUNTS)
    return _metrics(_with_previous(wide, VWAPS))


def microstructure_lagged(quotes: DataFrame, trades: DataFrame, step_seconds: int = 180, **options) -> DataFrame:
    """The metrics against the window exactly ``step_seconds`` earlier."""
    wide = merged_windows(quotes, trades, skip_zero=False, **options)
    has_quote, has_trade = F.col("vwap_ask").isNotNull(), F.col("vwap_price").isNotNull()
    lagged = wide.filter(has_quote).select(
        "*", *[fixed_lag(c, step_seconds, ["ticker"]).alias(f"prev_{c}") for c in ("vwap_ask", "vwap_bid")]
    )
    for column in ("vwap_ask", "vwap_bid", "prev_vwap_ask", "prev_vwap_bid"):
        lagged = lagged.filter(F.col(column) != 0)
    return _metrics(lagged.filter(has_trade))


def microstructure_primitives(quotes: DataFrame, trades: DataFrame, **options) -> DataFrame:
    """Average prices as percent from their first value, and their moves."""
    quote_fields = {k: v for k, v in QUOTE_FIELDS.items() if v in VWAPS}
    trade_fields = {k: v for k, v in TRADE_FIELDS.items() if v in VWAPS}
    wide = merged_windows(quotes, trades, quote_fields, trade_fields, **options)
    from_open = wide.select("ticker", "ts", *[pct_change(c, first_value(c, ["ticker"])).alias(c) for c in VWAPS])
    moved = _with_previous(from_open.dropna(subset=VWAPS), VWAPS)
    return moved.select(
        "ts",
        "ticker",
        *VWAPS,
        *[f"prev_{c}" for c in VWAPS],
        (F.col("prev_vwap_ask") - F.col("vwap_ask")).alias("ask_change"),
        (F.col("vwap_bid") - F.col("prev_vwap_bid")).alias("bid_change"),
        (F.col("vwap_ask") - F.col("vwap_bid")).alias("spread"),
        ((F.col("vwap_bid") + F.col("vwap_ask")) / 2).alias("mid"),
    )


def metric_series(metrics: DataFrame, name: str, cumulative: bool = False) -> DataFrame:
    """One metric as a long series; rates and moves may be summed up over time per ticker, levels and amounts may not."""
    value = cumulative_sum(name, ["ticker"]) if cumulative and name in RATES + MOVES else F.col(name)
    return metrics.select("ts", "ticker", F.lit(name).alias("field"), value.cast("double").alias("value"))


def basket(df: DataFrame, value: str) -> DataFrame:
    """Mean over tickers per time, under the name ``BASKET``."""
    return df.groupBy("ts").agg(F.avg(value).alias(value)).select("ts", F.lit("BASKET").alias("ticker"), value)


def bid_ask_ratio(quotes: DataFrame, by_ticker: bool = True) -> DataFrame:
    """Money on the bid against money on the ask, squeezed into -1..1."""
    bid, ask = F.col("sum_bid_notional"), F.col("sum_ask_notional")
    ratio = quotes.select(
        F.col("window_end_time").alias("ts"), "ticker", F.tanh(F.try_divide(bid - ask, bid + ask)).alias("value")
    )
    return ratio if by_ticker else basket(ratio, "value")


def institutional_pressure(quotes: DataFrame, by_ticker: bool = True) -> DataFrame:
    """Price and volume pressure, with hidden size suspected where the bid stands still.

    Needs window results with closing prices.
    """
    rows = quotes.select(
        F.col("window_end_time").alias("ts"),
        "ticker",
        F.col("bid_price_at_window_end").alias("bid_move"),
        F.col("ask_price_at_window_end").alias("ask_move"),
        F.col("sum_bid_quantity").alias("bid_volume"),
        F.col("sum_ask_quantity").alias("ask_volume"),
    )
    moved = difference(rows, ["bid_move", "ask_move"], ["ticker"])
    hidden = F.when(F.abs("bid_move") < 0.0005, F.log1p("bid_volume")).otherwise(0.0)
    pressure = (
        (F.col("bid_move") - F.col("ask_move")) * 0.5
        + (F.col("bid_volume") - F.col("ask_volume")) * 0.3
        + hidden * 0.2
    )
    result = moved.select("ts", "ticker", pressure.alias("value"))
    return result if by_ticker else basket(result, "value")


def quote_totals(quotes: DataFrame, by_ticker: bool = False, excluded: list[str] | None = None) -> DataFrame:
    """Notional on both sides per time, over all tickers or per ticker."""
    kept = quotes.filter(in_scope("ticker", None, excluded)).withColumnRenamed("window_end_time", "ts")
    if by_ticker:
        return kept.select("ts", "ticker", F.col("sum_ask_notional").alias("asks"), F.col("sum_bid_notional").alias("bids"))
    return kept.groupBy("ts").agg(F.sum("sum_ask_notional").alias("asks"), F.sum("sum_bid_notional").alias("bids"))


def traded_notional(trades: DataFrame, included: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Traded notional per ticker over time."""
    return trades.filter(in_scope("ticker", included, excluded)).select(
        F.col("window_end_time").alias("ts"), "ticker", F.col("sum_notional").alias("value")
    )


def windowed_quotations(quotes: DataFrame, symbol: str | None = None, start: Column | None = None, stop: Column | None = None) -> DataFrame:
    """Window results of a symbol and time range in the shape of the query API."""
    kept = quotes.filter(F.col("ticker") == symbol) if symbol else quotes
    if start is not None:
        kept = kept.filter(F.col("window_end_time") >= start)
    if stop is not None:
        kept = kept.filter(F.col("window_end_time") < stop)
    return kept.select(
        "measure_id",
        F.col("ticker").alias("symbol"),
        "window_start_time",
        "window_end_time",
        F.col("sum_bid_quantity").alias("sum_bid_volume"),
        F.col("sum_ask_quantity").alias("sum_ask_volume"),
        "record_count",
        F.col("volume_weighted_avg_bid_price").alias("average_bid_price"),
        F.col("volume_weighted_avg_ask_price").alias("average_ask_price"),
        "bid_price_at_window_end",
        "ask_price_at_window_end",
    )


def last_hour(quotes: DataFrame, symbol: str | None = None, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return windowed_quotations(quotes, symbol, now - F.expr("INTERVAL 1 HOUR"), now)


def with_anchors(series: DataFrame, values: list[float], now: Column | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Add chart axis anchors: one row per value at the current time."""
    now = F.current_timestamp() if now is None else now
    spark = series.sparkSession
    anchors = spark.createDataFrame([(float(v),) for v in values], f"`{value}` double").select(now.alias(ts), value)
    return series.unionByName(anchors, allowMissingColumns=True)


def renamed_fields(long: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Long-form results with dashboard field names; unknown fields keep theirs."""
    return long.withColumn("_field", rename_by(names or {**QUOTE_FIELDS, **TRADE_FIELDS}, "_field"))
