"""Results to subscribers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickwise.operators import quality
from tickwise.operators.series import numbered
from tickwise.streaming import ledger

BATCH_SIZE = 7
#: Connections that a delivery is addressed to at most.
ADDRESSES = 500


def message_batches(results: DataFrame, columns: list[str], order: list[str], size: int = BATCH_SIZE) -> DataFrame:
    """Each symbol's messages in order, ``size`` to a batch.

    A connection holds one symbol, so its batches are those of the symbol: they are
    made once per symbol and not once per subscriber. Messages are numbered by hours of the
    first of ``order``, a time, so that a symbol with most results takes many tasks.
    """
    rows = results.select("symbol", F.struct(*columns).alias("message"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    placed = numbered(rows, ["symbol"], F.date_trunc("hour", "_o0"), [f"_o{i}" for i in range(len(order))], "_n")
    return (
        placed.groupBy("symbol", F.floor(F.col("_n") / size).alias("batch"))
        .agg(F.array_sort(F.collect_list(F.struct("_n", "message"))).alias("_m"))
        .select("symbol", "batch", F.col("_m.message").alias("messages"))
    )


def subscriber_batches(batches: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The batches each connection is sent.

    Only whole batches travel; a symbol with very many subscribers is split by the
    adaptive skew join.
    """
    return subscriptions.select("connection_id", "symbol").join(batches, "symbol").select(
        "connection_id", "symbol", "batch", "messages"
    )


def address_lists(subscriptions: DataFrame, size: int = ADDRESSES) -> DataFrame:
    """The connections of each symbol in lists of about ``size``: ``(symbol, list, connections)``.

    Connections are dealt to lists by hash, so that a symbol with most subscribers isn't gathered.
    """
    counts = subscriptions.groupBy("symbol").agg(F.ceil(F.count(F.lit(1)) / size).alias("_lists"))
    part = F.pmod(F.xxhash64("connection_id"), F.col("_lists")).cast("int")
    dealt = subscriptions.select("connection_id", "symbol").distinct().join(counts, "symbol").select("symbol", part.alias("list"), "connection_id")
    return dealt.groupBy("symbol", "list").agg(F.array_sort(F.collect_list("connection_id")).alias("connections"))


def deliveries(batches: DataFrame, subscriptions: DataFrame, size: int = ADDRESSES) -> DataFrame:
    """Each batch once for every list of connections that it goes to, not once for every connection."""
    return batches.join(address_lists(subscriptions, size), "symbol").select("symbol", "batch", "list", "messages", "connections")


def checked(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid results, rejected with reasons)``: a message needs its id, its measurement and its symbol."""
    return quality.split(results, quality.result_message_checks())


def push(
    results: DataFrame,
    subscriptions: Callable[[int], DataFrame],
    columns: list[str],
    order: list[str],
    send: Callable[[DataFrame, int], None],
    checkpoint: str,
    book: ledger.Ledger,
    query: str = "push",
    run: int = 1,
):
    """Stream results to subscribers: each micro-batch is checked, batched, addressed and handed to ``send``.

    ``subscriptions`` is asked anew for every micro-batch, so connections that have come or left since
    count at once. A micro-batch that the ledger lists isn't sent again.
    """

    def deliver(rows: DataFrame, number: int) -> None:
        valid, _ = checked(rows)
        send(deliveries(message_batches(valid, columns, order), subscriptions(number)), number)

    return (
        results.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(ledger.once(book, query, run, {"sent": deliver}))
    )
