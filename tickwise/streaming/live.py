"""Live window aggregates: the batch operators behind a watermark."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickwise.operators.windows import (
    quote_levels,
    quote_windows_from_levels,
    trade_windows,
)
from tickwise.sources.store import Table, upsert

# Window length, how late events may come, idle wait, checkpoint pace.
WINDOW = "5 minutes"
LATENESS = "120 seconds"
IDLE = "90 seconds"
CHECKPOINT_PACE = "120 seconds"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_lateness(events: DataFrame, lateness: str = LATENESS, ts: str = "market_ts") -> DataFrame:
    """Event time with bounded disorder; later rows are dropped by the aggregates.

    The watermark follows the newest event of this input, so an idle symbol holds nothing back. For
    several inputs see ``inputs.live_input``.
    """
    return events.withWatermark(ts, lateness)


def live_trade_windows(trades: DataFrame, every: str = WINDOW, lateness: str = LATENESS, slide: str | None = None) -> DataFrame:
    """Closed trade windows; works on a stream and on a static frame alike."""
    return trade_windows(with_lateness(trades, lateness), every, slide)


def live_quote_levels(quotes: DataFrame, every: str = WINDOW, lateness: str = LATENESS, slide: str | None = None) -> DataFrame:
    """Price levels of closed quote windows.

    State holds one row per price level.  All levels of a window leave in the
    micro-batch that closes it, so ``quote_sink`` can finish the window there.
    """
    return quote_levels(with_lateness(quotes, lateness), every, slide)


def window_table(path: str) -> Table:
    """Stored window results; replaying a day writes the same keys again."""
    return Table(path, keys=["ticker", "window_end_time"], partitions=["day"])


def store_windows(rows: DataFrame, table: Table) -> None:
    upsert(rows.withColumn("day", F.to_date("window_end_time")), table)


def trade_sink(windows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Upsert closed trade windows into a stored table."""
    table = window_table(path)
    return (
        windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: store_windows(batch, table))
    )


def quote_sink(levels: DataFrame, path: str, checkpoint: str, closing: bool = False) -> DataStreamWriter:
    """Finish the quote windows of each micro-batch and upsert them."""
    table = window_table(path)
    return (
        levels.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: store_windows(quote_windows_from_levels(batch, closing), table))
    )


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Whether rows of a state are counted, for which each write looks its key up first.
COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"


def use_rocksdb(spark) -> None:
    """Keep keyed state in RocksDB: it spills to disk and is checkpointed incrementally."""
    spark.conf.set(PROVIDER, ROCKSDB)


@contextmanager
def rocksdb(spark):
    """``use_rocksdb`` for the queries started within, then as before. The rows of their states aren't counted."""
    before, counted = spark.conf.get(PROVIDER), spark.conf.get(COUNTED, None)
    use_rocksdb(spark)
    spark.conf.set(COUNTED, "false")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
        spark.conf.unset(COUNTED) if counted is None else spark.conf.set(COUNTED, counted)


def late_rows(query) -> int:
    """Rows dropped as late so far in the query's recent progress."""
    return sum(
        operator.numRowsDroppedByWatermark for progress in query.recentProgress for operator in progress.stateOperators
    )
