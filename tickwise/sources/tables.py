"""Views of the benchmark tables as market data.

Pure projections (plus the dimension joins a star schema needs); every row of
the source tables is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("trade_id"),
        F.col("ts").cast("timestamp").alias("market_ts"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def events_as_trades(events: DataFrame) -> DataFrame:
    return _event_columns(events).select(
        "symbol", "trade_id", "market_ts", F.col("value").alias("price"), F.col("k").alias("lot_size")
    )


def events_as_quotes(events: DataFrame) -> DataFrame:
    return _event_columns(events).select(
        "symbol",
        "market_ts",
        (F.col("value") * 1.01).alias("ask_price"),
        (F.lit(1.0) + F.col("trade_id") % 100).alias("ask_lot"),
        (F.col("value") * 0.99).alias("bid_price"),
        F.col("k").alias("bid_lot"),
    )


def trades(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_trades(read(spark, folder, "events"))


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_quotes(read(spark, folder, "events"))


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Half-hour bars per nation; twenty slots a day from 12:00 UTC, so that each
    day holds early, regular and late bars."""
    lineitem = read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_shipdate",
    )
    supplier = read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, folder, "nation").select("n_nationkey", "n_name")
    opening = F.col("l_extendedprice") / F.col("l_quantity")
    minutes = F.lit(720) + F.col("l_orderkey") % 20 * 30
    return (
        lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("ticker"),
            F.concat(F.col("n_name"), F.lit(" Inc")).alias("company"),
            F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + minutes * 60).alias("market_ts"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sequence"),
            opening.alias("opening_price"),
            (opening * (1 - F.col("l_discount"))).alias("closing_price"),
            opening.alias("high_price"),
            (opening * (1 - F.col("l_discount"))).alias("low_price"),
            (opening * (1 - F.col("l_discount") / 2)).alias("volume_weighted_avg_price"),
            F.col("l_quantity").alias("volume"),
        )
        .withColumn("total_trading_value", F.col("volume_weighted_avg_price") * F.col("volume"))
    )


def volatility_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Daily text observations with gaps: every fifth day of the year is missing."""
    daily = (
        read(spark, folder, "orders")
        .groupBy(F.to_date("o_orderdate").alias("day"))
        .agg(F.avg("o_totalprice").alias("mean_price"))
    )
    text = F.when(F.dayofyear("day") % 5 == 0, F.lit(".")).otherwise(
        F.round(F.col("mean_price") / 1000, 9).cast("decimal(18,9)").cast("string")
    )
    return daily.select(F.lit("VIX").alias("ticker"), "day", text.alias("value"))


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    """One symbol per connection, as connections are keyed by their id."""
    names = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    return read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("connection_id"),
        F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("symbol"),
    )


def universe(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate universe rows, some malformed, some doubled."""
    code = F.concat(
        F.chr(F.lit(65) + F.col("s_nationkey")), F.chr(F.lit(65) + (F.col("s_suppkey") % 26).cast("int"))
    )
    return read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("row_id"),
        F.when(F.col("s_acctbal") < 0, F.lower(code)).otherwise(code).alias("ticker"),
        F.when(F.col("s_suppkey") % 17 == 0, F.lit(" ")).otherwise(F.col("s_name")).alias("company"),
    )


def statement_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals per market segment, year and quarter, in cents."""
    orders = read(spark, folder, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    customer = read(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("c_mktsegment").alias("ticker"),
            F.year("o_orderdate").alias("year"),
            F.quarter("o_orderdate").alias("quarter"),
        )
        .agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    )
