"""Life cycle of stored tables: written, written again, deleted from, renamed, refreshed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.plans import pipeline
from tickwise.session import fresh_path
from tickwise.sources import store, tables


def _last_values(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, folder, "events").select(
        F.concat("event_type", F.lit("/USD#1")).alias("ticker"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value",
        F.to_date("ts").alias("day"),
    )


def _series_table(spark: SparkSession, partitions: list[str], keys: list[str]) -> store.Table:
    return store.Table(fresh_path(spark, "series-table"), keys, partitions, ["ts", "event_id"])


def upserted(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of daily values per ticker and user; the second replaces rows of the first, twice."""
    rows = _last_values(spark, folder)
    table = _series_table(spark, ["day"], ["ticker", "user_id", "day"])
    for odd in (0, 1, 1):
        store.upsert(rows.filter(F.col("event_id") % 2 == odd), table)
    return store.load(spark, table, rows.schema)


def deleted(spark: SparkSession, folder: str) -> DataFrame:
    """All of one ticker and the large values of the others are deleted."""
    rows = _last_values(spark, folder)
    table = _series_table(spark, ["ticker"], ["ticker", "user_id"])
    store.upsert(rows, table)
    store.delete(spark, table, (F.col("ticker") == "view/USD#1") | (F.col("value") > 300))
    return store.load(spark, table, rows.schema)


def renamed(spark: SparkSession, folder: str) -> DataFrame:
    """One ticker goes on under the name of another that has rows of the same users."""
    rows = _last_values(spark, folder)
    table = _series_table(spark, ["ticker"], ["ticker", "user_id"])
    store.upsert(rows, table)
    store.rename_ticker(spark, table, "view/USD#1", "click/USD#1")
    return store.load(spark, table, rows.schema)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per customer and order status in two batches; the newest version counts."""
    orders = tables.read(spark, folder, "orders")
    rows = orders.select(
        F.concat(F.lit("f#"), "o_custkey").alias("pk"), F.col("o_orderstatus").alias("sk"),
        F.col("o_orderkey").cast("string").alias("body"), F.col("o_orderkey").alias("version"),
    )
    table = store.document_table(fresh_path(spark, "documents"))
    half = F.col("version") <= orders.select(F.expr("percentile_approx(o_orderkey, 0.5)")).first()[0]
    store.put_documents(rows.filter(half), table)
    store.put_documents(rows.filter(~half), table)
    return store.load(spark, table).drop("bucket")


Run = tuple[DataFrame, str | None, bool]


def _run(spark: SparkSession, runs: list[Run]) -> tuple[store.Table, store.Table, store.Table]:
    """The stored members, index and states after some runs, each of (bars, stale mark, full)."""
    members = pipeline.members_table(fresh_path(spark, "members-table"))
    index = pipeline.index_table(fresh_path(spark, "index-table"))
    states = pipeline.states_table(fresh_path(spark, "states-table"))
    for daily, mark, full in runs:
        marks = spark.createDataFrame([(mark,)], "d string").select(F.to_date("d").alias("stale_from"))
        pipeline.refresh_index(spark, daily, members, index, states, marks, "1995-01-01", full)
    return members, index, states


def _refreshed(spark: SparkSession, runs: list[Run]) -> DataFrame:
    members, index, _ = _run(spark, runs)
    own = store.load(spark, members).select("ticker", "day", "price_change_avg", "month")
    whole = store.load(spark, index).select(F.lit("INDEX").alias("ticker"), "day", "price_change_avg", "month")
    return own.unionByName(whole).withColumn("month", F.col("month").cast("string"))


def refreshed(spark: SparkSession, folder: str, daily: DataFrame) -> DataFrame:
    """A first run over the bars up to mid-2000, then one from the stale mark on."""
    held = store.staged(daily, fresh_path(spark, "daily"))
    return _refreshed(spark, [(held.filter("day < '2000-06-10'"), None, False), (held, "2000-06-10", False)])


def member_versions(spark: SparkSession, folder: str, daily: DataFrame) -> DataFrame:
    """The members' state as of each January, after a first run and two refreshes, the second of which goes further back."""
    held = store.staged(daily, fresh_path(spark, "daily"))
    runs = [(held.filter("day < '1998-03-10'"), None, False), (held.filter("day < '2000-06-10'"), "1998-02-20", False), (held, "1997-05-05", False)]
    _, _, states = _run(spark, runs)
    return store.load(spark, states).filter(F.month("as_of") == 1).drop("month")


def redone(spark: SparkSession, folder: str, daily: DataFrame) -> DataFrame:
    """A full run over all bars, then another after the bars from 2000 on have gone."""
    held = store.staged(daily, fresh_path(spark, "daily"))
    return _refreshed(spark, [(held, None, True), (held.filter("day < '2000-01-01'"), None, True)])


def stale_mark(spark: SparkSession, folder: str) -> DataFrame:
    """The earlier of a stored mark (the first order) and what a run suggests (the first shipment)."""
    first = lambda name, column: tables.read(spark, folder, name).agg(F.to_date(F.min(column)).alias("stale_from"))
    return store.suggest_stale_from(first("orders", "o_orderdate"), first("lineitem", "l_shipdate"))
