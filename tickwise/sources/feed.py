"""Live feed: JSON frames → routed, decoded, validated quotes and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.functions.scalar import money_amount, money_from_number, money_is_valid, timestamp_is_valid
from tickwise.operators.quality import present, split

# Key of a feed message, its type, and the column it becomes
# (stock and crypto messages share one superset; some keys differ only in case).
MESSAGE_KEYS = [
    ("T", "STRING", "message_type"),
    ("S", "STRING", "symbol"),
    ("i", "BIGINT", "trade_id"),
    ("x", "STRING", "exchange"),
    ("p", "DOUBLE", "price"),
    ("s", "DOUBLE", "size"),
    ("c", "ARRAY<STRING>", "conditions"),
    ("t", "TIMESTAMP", "market_ts"),
    ("z", "STRING", "tape"),
    ("tks", "STRING", "tks"),
    ("bx", "STRING", "bid_exchange"),
    ("bp", "DOUBLE", "bid_price"),
    ("bs", "DOUBLE", "bid_size"),
    ("ax", "STRING", "ask_exchange"),
    ("ap", "DOUBLE", "ask_price"),
    ("as", "DOUBLE", "ask_size"),
    ("msg", "STRING", "msg"),
]

_MONEY = "STRUCT<units: BIGINT, nanos: INT, currency: STRING>"
_UNIT = f"STRUCT<exchange: STRING, price: {_MONEY}, lot_size: DOUBLE>"
ENVELOPE_SCHEMA = (
    "kind STRING, symbol STRING, trade_id BIGINT, market_ts TIMESTAMP, ingest_ts TIMESTAMP, "
    f"bid {_UNIT}, ask {_UNIT}, settle {_UNIT}, conditions ARRAY<STRING>, tape STRING, tks STRING"
)


class FeedError(Exception):
    """The feed reported an error message."""


def read_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Text frames, one per line, as a batch or as a stream."""
    return (spark.readStream if stream else spark.read).text(path)


def messages(frames: DataFrame, column: str = "value") -> DataFrame:
    """One row per message: a frame is one object or an array of objects.

    The array schema covers both, a lone object parses as an array of one.
    """
    fields = ", ".join(f"`{key}`: {kind}" for key, kind, _ in MESSAGE_KEYS)
    parsed = F.from_json(column, f"ARRAY<STRUCT<{fields}>>", {"timeZone": "UTC"})
    return frames.select(F.inline(parsed).alias(*[name for _, _, name in MESSAGE_KEYS]))


def route(feed_type: str = "stocks") -> Column:
    """Destination of a message: its typed stream, a control channel or ``unknown``."""
    if feed_type not in ("stocks", "crypto"):
        raise ValueError(f"unknown feed type {feed_type!r}")
    first = "stock" if feed_type == "stocks" else "crypto"
    kind = F.col("message_type")
    control = [F.when(kind == k, F.lit(k)) for k in ("success", "subscription", "error")]
    return F.coalesce(
        F.when(kind == "q", F.lit(f"{first}_quotation")),
        F.when(kind == "t", F.lit(f"{first}_trade")),
        *control,
        F.lit("unknown"),
    )


def fail_on_errors(routed: DataFrame) -> DataFrame:
    """Make the job fail when an ``error`` message passes through."""
    text = F.concat(F.lit("feed error: "), F.coalesce(F.col("msg"), F.lit("")))
    passes = F.when(F.col("route") == "error", F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return routed.filter(passes)


def envelopes(decoded: DataFrame, feed_type: str = "stocks", ingest_ts: Column | None = None) -> DataFrame:
    """Quotes and trades in the typed envelope, prices split into units and nanos."""

    def unit(exchange: str, price: str, size: str) -> Column:
        money = F.when(F.col(price).isNotNull(), money_from_number(price))
        venue = F.col(exchange) if feed_type == "stocks" else F.lit(None).cast("string")
        return F.struct(venue.alias("exchange"), money.alias("price"), F.col(size).alias("lot_size"))

    routed = decoded.withColumn("route", route(feed_type))
    is_quote, is_trade = F.col("message_type") == "q", F.col("message_type") == "t"
    return routed.filter(is_quote | is_trade).select(
        F.col("route").alias("kind"),
        "symbol",
        F.when(is_trade, F.col("trade_id")).alias("trade_id"),
        "market_ts",
        (ingest_ts if ingest_ts is not None else F.current_timestamp()).alias("ingest_ts"),
        F.when(is_quote, unit("bid_exchange", "bid_price", "bid_size")).alias("bid"),
        F.when(is_quote, unit("ask_exchange", "ask_price", "ask_size")).alias("ask"),
        F.when(is_trade, unit("exchange", "price", "size")).alias("settle"),
        "conditions",
        "tape",
        "tks",
    )


def read_events(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Stored envelopes from the oldest on."""
    reader = (spark.readStream if stream else spark.read).schema(ENVELOPE_SCHEMA)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def write_events(df: DataFrame, path: str, checkpoint: str | None = None):
    """Append envelopes, partitioned by symbol; streams need a checkpoint folder."""
    if df.isStreaming:
        return (
            df.writeStream.partitionBy("symbol").format("json").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
        )
    df.write.mode("append").partitionBy("symbol").json(path)
    return None


def for_kafka(df: DataFrame) -> DataFrame:
    """``key``/``value`` columns for a Kafka sink: all events of a symbol share a partition."""
    return df.select(F.col("symbol").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    """One of the typed streams."""
    return events.filter(F.col("kind") == kind)


def since(events: DataFrame, bound: Column) -> DataFrame:
    return events.filter(F.col("market_ts") >= bound)


def _time_checks(ts: str) -> dict[str, Column]:
    micros = F.unix_micros(ts)
    return {f"{ts}_range": timestamp_is_valid(F.floor(micros / 1_000_000), F.pmod(micros, F.lit(1_000_000)) * 1000)}


def _money_checks(unit: str) -> dict[str, Column]:
    return {f"{unit}_sign": F.coalesce(money_is_valid(f"{unit}.price.units", f"{unit}.price.nanos"), F.lit(True))}


def decode_trades(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(trades, rejected)`` from trade envelopes."""
    checks = {
        **present("symbol", "market_ts", "ingest_ts", "settle", "settle.price"),
        **_time_checks("market_ts"),
        **_money_checks("settle"),
    }
    good, bad = split(events.filter(F.col("kind").endswith("_trade")), checks)
    amount = money_amount("settle.price.units", "settle.price.nanos")
    trades = good.select(
        "symbol", F.substring_index("kind", "_", 1).alias("asset"), "trade_id", "market_ts", "ingest_ts",
        amount.cast("double").alias("price"), F.col("settle.lot_size").alias("lot_size"),
        F.col("settle.price.currency").alias("currency"), F.col("settle.exchange").alias("exchange"),
        "conditions", "tape", "tks",
    )
    return trades, bad


def decode_quotes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(quotes, rejected)`` from quotation envelopes."""
    checks = {
        **present("symbol", "market_ts", "ingest_ts", "bid", "bid.price", "ask", "ask.price"),
        **_time_checks("market_ts"),
        **_money_checks("bid"),
        **_money_checks("ask"),
    }
    good, bad = split(events.filter(F.col("kind").endswith("_quotation")), checks)

    def side(name: str) -> list[Column]:
        amount = money_amount(f"{name}.price.units", f"{name}.price.nanos")
        return [amount.cast("double").alias(f"{name}_price"), F.col(f"{name}.lot_size").alias(f"{name}_lot")]

    quotes = good.select(
        "symbol", F.substring_index("kind", "_", 1).alias("asset"), "market_ts", "ingest_ts",
        *side("ask"), *side("bid"), "conditions", "tape",
    )
    return quotes, bad
