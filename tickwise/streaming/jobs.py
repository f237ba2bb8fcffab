"""Complete streaming jobs: source → operator → stored table, run until the source is drained."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.operators import quality, trends
from tickwise.operators.windows import QUOTE_METRICS, TRADE_METRICS, all_assets, quote_windows_from_levels, trade_windows
from tickwise.session import fresh_path
from tickwise.sources import feed, store, tables
from tickwise.streaming import fanout, inputs, ledger, live, stateful

#: Micro-batches that a replayed table is cut into.
STEPS = 4


def drain(writer) -> None:
    """Run a query over what the source holds now and wait for its end."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def _drain(spark: SparkSession, writer) -> None:
    """``drain`` with keyed state in RocksDB; the session's own setting is left as it was."""
    with live.rocksdb(spark):
        drain(writer)


# --- replayed tables ---------------------------------------------------------


def replay(df: DataFrame, name: str, ts: str = "ts", steps: int = STEPS, cuts: list[int] | None = None, step: str | None = None, stored: bool = False) -> Iterator[DataFrame]:
    """A table as a stream that grows step by step in order of time; yields the stream after each step.

    A query drained after each step goes on from its checkpoint, and finds a step's files as one
    micro-batch. All tasks write a step. Rows without time come first. ``cuts``, in microseconds, are the last times of
    all steps but the last; without them steps have about as many rows each. A column ``step`` says it instead.
    A table that is ``stored`` isn't stored again before it is cut.
    """
    spark = df.sparkSession
    held = df if stored else store.staged(df, fresh_path(spark, name))
    path = f"{fresh_path(spark, name)}/input"
    if step is None:
        instant = F.unix_micros(ts)
        if cuts is None:
            cuts = held.agg(F.percentile_approx(instant, [i / steps for i in range(1, steps)], 10_000)).first()[0] or []
        place = step_of(instant, cuts)
    else:
        place = F.col(step)
    for number in range(steps):
        held.filter(place == number).write.mode("append").parquet(path)
        yield spark.readStream.schema(held.schema).parquet(path)


def step_of(instant: Column, cuts: list[int]) -> Column:
    """How many cuts lie before a time; 0 without a time."""
    place = F.lit(0)
    for cut in cuts:
        place = place + F.coalesce(instant > cut, F.lit(False)).cast("int")
    return place


def even_cuts(df: DataFrame, ts: str, steps: int = STEPS) -> list[int]:
    """Cuts that part the time between first and last row evenly."""
    first, last = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    return [] if first is None else [first + (last - first) * i // steps for i in range(1, steps)]


def replayed(df: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame], ts: str = "ts", **options) -> tuple[DataFrame, str]:
    """What ``transform`` gives for a replayed table (``options`` as for ``replay``), and the checkpoint that holds its state."""
    spark = df.sparkSession
    out = fresh_path(spark, name)
    for stream in replay(df, name, ts, **options):
        result = transform(stream)
        _drain(
            spark,
            result.writeStream.outputMode("append").format("parquet")
            .option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint")
        )
    return spark.read.schema(result.schema).parquet(f"{out}/table"), f"{out}/checkpoint"


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """(key, value) of a state variable of a query's keyed operator, as its last batch has left it."""
    with live.rocksdb(spark):
        rows = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
        return store.staged(rows.select("key", "value"), fresh_path(spark, f"state-{variable}"))


# --- windows, deltas, drawdown, trends ---------------------------------------


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream; the schema comes from the file."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def trade_windows_from_file(every: str, spark: SparkSession, folder: str) -> DataFrame:
    windows = live.live_trade_windows(tables.events_as_trades(event_stream(spark, folder)), every)
    out = fresh_path(spark, "trade-windows")
    _drain(spark, live.trade_sink(windows, f"{out}/table", f"{out}/checkpoint"))
    return spark.read.schema(windows.schema).parquet(f"{out}/table").drop("day")


def quote_windows_from_file(every: str, spark: SparkSession, folder: str) -> DataFrame:
    levels = live.live_quote_levels(tables.events_as_quotes(event_stream(spark, folder)), every)
    out = fresh_path(spark, "quote-windows")
    _drain(spark, live.quote_sink(levels, f"{out}/table", f"{out}/checkpoint"))
    return spark.read.schema(quote_windows_from_levels(levels).schema).parquet(f"{out}/table").drop("day")


def trade_deltas_from_file(every: str, spark: SparkSession, folder: str) -> DataFrame:
    """Closed windows from the event stream, then deltas with the previous window in state."""
    windows = trade_windows_from_file(every, spark, folder)
    return replayed(windows, "trade-deltas", lambda s: stateful.stream_deltas(s, TRADE_METRICS), "window_end_time")[0]


def quote_deltas_from_file(every: str, spark: SparkSession, folder: str) -> DataFrame:
    windows = quote_windows_from_file(every, spark, folder)
    return replayed(windows, "quote-deltas", lambda s: stateful.stream_deltas(s, QUOTE_METRICS), "window_end_time")[0]


def drawdown_from_table(spark: SparkSession, index: DataFrame) -> DataFrame:
    return replayed(index, "drawdown", stateful.stream_drawdown)[0]


def trends_from_table(spark: SparkSession, series: DataFrame) -> DataFrame:
    held = store.staged(series, fresh_path(spark, "series"))
    found, _ = replayed(held, "trends", stateful.stream_trends, cuts=even_cuts(held, "ts"))
    return found.drop("redone").withColumn("ts", F.col("ends"))


def trends_redone(spark: SparkSession, series: DataFrame, redo: Column) -> DataFrame:
    """Trends of a growing series; at the third step those that ``redo`` selects are told to start afresh and sent again from the first row on."""
    held = store.staged(series.select(*trends.SERIES, "ts", "price_change_avg"), fresh_path(spark, "series"))
    place = step_of(F.unix_micros("ts"), even_cuts(held, "ts"))
    rows = held.withColumn("step", place).withColumn("redo", F.lit(False))
    again = rows.filter(redo & (F.col("step") < 2)).withColumn("step", F.lit(2))
    told = held.filter(redo).select(*trends.SERIES).distinct().select(
        *trends.SERIES, F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("price_change_avg"), F.lit(2).alias("step"), F.lit(True).alias("redo")
    )
    sent = rows.unionByName(again).unionByName(told)
    found, checkpoint = replayed(sent, "trends-redone", lambda s: stateful.stream_trends(s, redo="redo"), step="step")
    times = state_rows(spark, checkpoint, "redone").select(*[F.col(f"key.{k}").alias(f"_{k}") for k in trends.SERIES], F.col("value.times").alias("times"))
    same = [F.col(k) == F.col(f"_{k}") for k in trends.SERIES]
    valid = found.join(times, same, "left").filter(F.col("redone") == F.coalesce("times", F.lit(0)))
    return valid.select(*found.columns).withColumn("ts", F.col("ends"))


def previous_windows(every: str, spark: SparkSession, folder: str) -> DataFrame:
    """The previous window that each ticker's state holds once the deltas of all windows are out."""
    windows = trade_windows_from_file(every, spark, folder)
    _, checkpoint = replayed(windows, "trade-deltas", lambda s: stateful.stream_deltas(s, TRADE_METRICS), "window_end_time")
    return state_rows(spark, checkpoint, "previous").select("key.ticker", "value.*")


def running_maxima(spark: SparkSession, members: DataFrame) -> DataFrame:
    """The highest values that each member's state holds once all its days have been seen."""
    _, checkpoint = replayed(members, "member-drawdown", stateful.stream_drawdown)
    return state_rows(spark, checkpoint, "top").select("key.ticker", "value.*")


# --- batches delivered more than once ----------------------------------------


class Killed(Exception):
    """Stands for the end of a process between two writes."""


def _killed_once(write: Callable[[DataFrame, int], None], at: int) -> Callable[[DataFrame, int], None]:
    """``write`` that ends its query after batch ``at`` is written and before the ledger knows, the first time."""
    left = [1]

    def run(rows: DataFrame, number: int) -> None:
        write(rows, number)
        if number == at and left:
            left.pop()
            raise Killed(f"batch {number}")

    return run


def _until_done(spark: SparkSession, start: Callable[[], object]) -> None:
    """Drains a query, and starts it again from its checkpoint if it was killed."""
    try:
        _drain(spark, start())
    except StreamingQueryException as error:
        if Killed.__name__ not in str(error):
            raise
        _drain(spark, start())


def replayed_windows(every: str, spark: SparkSession, folder: str) -> DataFrame:
    """Closed trade windows in a table and in a log, from a stream that has been through a lot.

    The first run stops half-way; its second batch is killed between two writes and delivered again.
    Then everything is replayed as a new run. ``deliveries`` counts a window's rows in the log.
    """
    trades = tables.trades(spark, folder)
    out = fresh_path(spark, "replayed-windows")
    book, table = ledger.Ledger(f"{out}/ledger"), live.window_table(f"{out}/table")
    schema = live.live_trade_windows(trades, every).schema

    def job(stream: DataFrame, run: int, append: Callable[[DataFrame, int], None]):
        writes = {"table": lambda rows, _: live.store_windows(rows, table), "log": append}
        windows = live.live_trade_windows(stream, every)
        return windows.writeStream.outputMode("append").option("checkpointLocation", f"{out}/run-{run}").foreachBatch(ledger.once(book, "windows", run, writes))

    first = book.new_run(spark, "windows")
    append = _killed_once(ledger.append_batch(f"{out}/log", "windows", first), 1)
    for step, stream in enumerate(replay(trades, "trades", "market_ts")):
        if step < STEPS // 2:
            _until_done(spark, lambda s=stream: job(s, first, append))
    second = first + 1
    _drain(spark, job(stream, second, ledger.append_batch(f"{out}/log", "windows", second)))
    book.end_run(spark, "windows", second)
    log = ledger.appended(spark, book, f"{out}/log", "windows", "log", schema)
    counted = log.groupBy("measure_id").agg(F.count(F.lit(1)).alias("deliveries"))
    return store.load(spark, table).drop("day").join(counted, "measure_id")


def replayed_throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Messages per minute, added up from the counts of each micro-batch; one batch is delivered twice."""
    trades = tables.trades(spark, folder).select("market_ts")
    out = fresh_path(spark, "replayed-throughput")
    book = ledger.Ledger(f"{out}/ledger")
    run = book.new_run(spark, "throughput")
    append = ledger.append_batch(f"{out}/counts", "throughput", run)
    write = _killed_once(lambda rows, number: append(quality.throughput(rows), number), 2)

    def job(stream: DataFrame):
        return stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(ledger.once(book, "throughput", run, {"counts": write}))

    for stream in replay(trades, "trades", "market_ts"):
        _until_done(spark, lambda s=stream: job(s))
    counts = ledger.appended(spark, book, f"{out}/counts", "throughput", "counts", "minute timestamp, messages long")
    return counts.groupBy("minute").agg(F.sum("messages").alias("messages"))


# --- several inputs, late rows -----------------------------------------------

CRYPTO = ["view", "error"]


def live_assets(every: str, spark: SparkSession, folder: str) -> DataFrame:
    """Windows of stocks and crypto as two live inputs of one query.

    Crypto pauses for a step and then brings that step's events, older than what stocks have reached; none is lost.
    When both have ended, beats close the windows that the earlier end would hold open.
    """
    trades = store.staged(tables.trades(spark, folder), fresh_path(spark, "trades"))
    out = fresh_path(spark, "live-assets")
    crypto = F.col("symbol").isin(CRYPTO)
    cuts = even_cuts(trades, "market_ts")
    log = inputs.ProgressLog()

    def job(stocks: DataFrame, other: DataFrame):
        of = lambda events, name: trade_windows(inputs.live_input(events, name, out), every)
        both = all_assets(of(stocks, "stocks"), of(other, "crypto"))
        return live.trade_sink(both, f"{out}/table", f"{out}/checkpoint")

    def look() -> None:
        log.run(spark, lambda: _drain(spark, job(stocks, other)))

    late = replay(trades.filter(crypto), "crypto", "market_ts", cuts=cuts, stored=True)
    other = next(late)
    for step, stocks in enumerate(replay(trades.filter(~crypto), "stocks", "market_ts", cuts=cuts, stored=True)):
        if step != 1:  # crypto is silent, and two steps come at once after that
            for _ in range({0: 0, 2: 2}.get(step, 1)):
                other = next(late, other)
        look()
    end = trades.agg(F.max(F.unix_micros("market_ts"))).first()[0]
    for name in ("stocks", "crypto") if end is not None else ():
        inputs.send_beat(spark, out, name, inputs.instant(end))
    look()
    return spark.read.schema(live.live_trade_windows(trades, every).schema).parquet(f"{out}/table").drop("day")


def late_trades(every: str, spark: SparkSession, folder: str) -> DataFrame:
    """Rows, newest time and late rows of each micro-batch, when every thirteenth trade arrives two days late."""
    arrival = F.when(F.col("trade_id") % 13 == 0, F.col("market_ts") + F.make_dt_interval(days=F.lit(2))).otherwise(F.col("market_ts"))
    trades = store.staged(tables.trades(spark, folder).withColumn("arrived", arrival), fresh_path(spark, "arrivals"))
    out = fresh_path(spark, "late-trades")
    log = inputs.ProgressLog()
    for stream in replay(trades, "arrivals", "arrived", cuts=even_cuts(trades, "arrived"), stored=True):
        events = inputs.distinct_in_window(inputs.live_input(stream, "trades", out), ["symbol", "trade_id"], every)
        writer = live.trade_sink(trade_windows(events, F.col("w")), f"{out}/table", f"{out}/checkpoint")
        log.run(spark, lambda w=writer: _drain(spark, w))
    batches = log.table(spark).filter(F.col("rows") > 0)
    return batches.select("rows", "newest", "late")


# --- batches by count or timer, event log, fan-out ---------------------------


def counted_batches(spark: SparkSession, folder: str, count: int = 100) -> DataFrame:
    """Each symbol's trades in batches of a hundred, the rest when time has gone on; a summary of each batch."""
    trades = tables.trades(spark, folder).select("symbol", "trade_id", "market_ts")
    out = fresh_path(spark, "counted-batches")
    columns = {"trade_id": "long", "market_ts": "timestamp"}
    days = 86_400_000

    def job(stream: DataFrame) -> DataFrame:
        events = inputs.live_input(stream, "trades", out)
        return stateful.count_or_timer(events, "symbol", columns, count, 60 * days, ["market_ts", "trade_id"], "market_ts")

    def run(stream: DataFrame) -> None:
        _drain(
            spark,
            job(stream).writeStream.outputMode("append").format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint")
        )

    for stream in replay(trades, "trades", "market_ts"):
        run(stream)
    end = trades.agg(F.max(F.unix_micros("market_ts"))).first()[0]
    inputs.send_beat(spark, out, "trades", inputs.instant((end or 0) + 90 * days * 1000))
    run(stream)
    rows = spark.read.schema(job(stream).schema).parquet(f"{out}/table")
    return rows.groupBy(F.col("key").alias("symbol"), "batch").agg(
        F.count(F.lit(1)).alias("trades"), F.min("market_ts").alias("first"), F.max("market_ts").alias("last"), F.sum("trade_id").alias("ids")
    )


def logged_windows(every: str, spark: SparkSession, frames: DataFrame) -> DataFrame:
    """Feed frames → log of envelopes → windows of the decoded trades, by two jobs that share the log alone."""
    from tickwise.sources import log as event_log

    out = fresh_path(spark, "event-log")
    path = f"{out}/log"
    for stream in replay(frames, "frames", "at"):
        routed = feed.envelopes(feed.messages(stream), "stocks", F.col("market_ts"))
        _drain(spark, event_log.write(routed, path, f"{out}/writer"))
    decoded, _ = feed.decode_trades(event_log.read(spark, path, stream=True))
    windows = live.live_trade_windows(decoded, every)
    _drain(spark, live.trade_sink(windows, f"{out}/table", f"{out}/reader"))
    return spark.read.schema(windows.schema).parquet(f"{out}/table").drop("day")


def pushed_batches(spark: SparkSession, results: DataFrame, subscriptions: Callable[[int], DataFrame], columns: list[str], order: list[str]) -> DataFrame:
    """What a stream of results hands to subscribers who come and go: ``subscriptions(batch)`` are those of that moment."""
    out = fresh_path(spark, "pushed")
    schema = fanout.deliveries(fanout.message_batches(results, columns, order), subscriptions(0)).withColumn("delivery", F.lit(0).cast("long")).schema
    book = ledger.Ledger(f"{out}/ledger")
    append = ledger.append_batch(f"{out}/sent", "push", 1)

    def send(rows: DataFrame, number: int) -> None:
        append(rows.withColumn("delivery", F.lit(number).cast("long")), number)

    for stream in replay(results, "results", order[0], cuts=even_cuts(results, order[0])):
        _drain(spark, fanout.push(stream, subscriptions, columns, order, send, f"{out}/checkpoint", book))
    return ledger.appended(spark, book, f"{out}/sent", "push", "sent", schema)
