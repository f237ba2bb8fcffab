import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwise.operators import drawdown as dd
from tickwise.operators import trends as tr
from tickwise.operators import windows as w
from tickwise.operators import series
from tickwise.sources import log as event_log
from tickwise.streaming import fanout, inputs, jobs, ledger, live, stateful
from tickwise.streaming.jobs import drain, replay

T0 = datetime(2025, 1, 15, 15, 0)
TRADE = "symbol string, trade_id long, market_ts timestamp, price double, lot_size double"
QUOTE = "symbol string, market_ts timestamp, ask_price double, ask_lot double, bid_price double, bid_lot double"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    """Keyed state in RocksDB, in two partitions, since each costs time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    with live.rocksdb(spark):
        yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def write_in_turn(spark, folder, parts, schema):
    """One file per part; each call is a micro-batch of its own when read one file at a time."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def trades(n, seed=5):
    rng = random.Random(seed)
    return [
        (rng.choice(["HOT"] * 6 + ["B", "C"]), i, T0 + timedelta(seconds=rng.uniform(0, 3600)), round(rng.uniform(9, 11), 2), float(rng.randint(0, 9)))
        for i in range(n)
    ]


def test_trade_stream_equals_batch(spark, tmp_path):
    rows = sorted(trades(600), key=lambda r: r[2])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    latest = []
    for part in (rows[:200], rows[200:400], rows[400:]):
        write_in_turn(spark, source, [part], TRADE)
        drain(live.trade_sink(live.live_trade_windows(stream(spark, source, TRADE)), out, str(tmp_path / "cp")))
        latest.append(spark.read.parquet(out).count())
    closed = max(r[2] for r in rows) - timedelta(seconds=120)
    want = w.trade_windows(spark.createDataFrame(rows, TRADE)).filter(f"window_end_time <= TIMESTAMP '{closed}'")
    got = {r.measure_id: r for r in spark.read.parquet(out).collect()}
    want = {r.measure_id: r for r in want.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert (got[k].price_at_window_start, got[k].price_at_window_end) == (want[k].price_at_window_start, want[k].price_at_window_end)
        assert all(got[k][m] == pytest.approx(want[k][m]) for m in w.TRADE_METRICS)
    assert latest == sorted(latest) and latest[0] < latest[-1]


def test_quote_stream_equals_batch(spark, tmp_path):
    rows = [(s, ts, p + 0.01, q, p, q + 1) for s, _, ts, p, q in sorted(trades(400, 9), key=lambda r: r[2])]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:150], rows[150:]):
        write_in_turn(spark, source, [part], QUOTE)
        drain(live.quote_sink(live.live_quote_levels(stream(spark, source, QUOTE)), out, str(tmp_path / "cp")))
    closed = max(r[1] for r in rows) - timedelta(seconds=120)
    want = w.quote_windows(spark.createDataFrame(rows, QUOTE)).filter(f"window_end_time <= TIMESTAMP '{closed}'")
    key = lambda r: (r.ticker, r.window_end_time)
    got = {key(r): r for r in spark.read.parquet(out).collect()}
    want = {key(r): r for r in want.collect()}
    assert got.keys() == want.keys()
    for k in want:
        for m in w.QUOTE_METRICS:
            assert got[k][m] == pytest.approx(want[k][m], abs=1e-9)


def test_late_events_are_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[("A", 1, T0, 1.0, 1.0), ("A", 2, T0 + timedelta(minutes=20), 1.0, 1.0)], [("A", 3, T0 + timedelta(seconds=5), 9.0, 1.0), ("A", 4, T0 + timedelta(minutes=40), 1.0, 1.0)]]
    for part in parts:
        write_in_turn(spark, source, [part], TRADE)
        drain(live.trade_sink(live.live_trade_windows(stream(spark, source, TRADE)), out, str(tmp_path / "cp")))
    first = spark.read.parquet(out).orderBy("window_end_time").first()
    assert (first.record_count, first.max_price) == (1, 1.0)


def append(df, folder):
    drain(df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp"))


def test_stream_deltas(spark, tmp_path):
    columns = ", ".join(["ticker string", "window_end_time timestamp", *[f"{m} double" for m in w.TRADE_METRICS]])
    rng = random.Random(2)
    rows = [(t, T0 + timedelta(minutes=5 * i), *[rng.uniform(0, 10) for _ in w.TRADE_METRICS]) for t in "AB" for i in range(9)]
    rows.sort(key=lambda r: r[1])
    source = str(tmp_path / "in")
    for part in (rows[:7], rows[7:12] + rows[:3], rows[12:]):
        write_in_turn(spark, source, [part], columns)
        append(stateful.stream_deltas(stream(spark, source, columns), w.TRADE_METRICS), str(tmp_path))
    got = {(r.ticker, r.timestamp): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.ticker, r.timestamp): r for r in w.trade_deltas(spark.createDataFrame(rows, columns)).collect()}
    assert got.keys() == want.keys() and len(got) == 16
    for k in want:
        assert all(got[k][f"{m}_delta"] == pytest.approx(want[k][f"{m}_delta"]) for m in w.TRADE_METRICS)


CHANGES = "measurement string, ticker string, ts timestamp, price_change_low double, price_change_avg double, price_change_high double"


def daily(n, tickers="AB"):
    rng, out = random.Random(4), []
    for t in tickers:
        x = 1.0
        for i in range(n):
            x *= rng.uniform(0.96, 1.045)
            out.append(("m", t, datetime(2024, 1, 1) + timedelta(i), x * 0.9, x, x * 1.1))
    return sorted(out, key=lambda r: r[2])


def test_stream_drawdown(spark, tmp_path):
    rows, source = daily(40), str(tmp_path / "in")
    for part in (rows[:30], rows[30:50] + rows[:4], rows[50:]):
        write_in_turn(spark, source, [part], CHANGES)
        append(stateful.stream_drawdown(stream(spark, source, CHANGES), as_of="2024-02-05"), str(tmp_path))
    key = lambda r: (r.ticker, r.ts)
    got = {key(r): r.drawdown_avg for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {key(r): r.drawdown_avg for r in dd.drawdown(spark.createDataFrame(rows, CHANGES), as_of="2024-02-05").collect()}
    assert got == pytest.approx(want)


def test_stream_drawdown_resets(spark, tmp_path):
    source = str(tmp_path / "in")
    at = lambda d, v: ("m", "A", datetime(2024, 1, d), v, v, v)
    for part in ([at(1, 5.0), at(2, 4.0)], [at(1, 2.0), at(2, 1.0)]):
        write_in_turn(spark, source, [part], CHANGES)
        append(stateful.stream_drawdown(stream(spark, source, CHANGES), earliest="2024-01-01"), str(tmp_path))
    got = [r.drawdown_avg for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == pytest.approx([50.0, 80.0, 100.0, 100.0])


def test_stream_trends_carry_the_tail(spark, tmp_path):
    rows, source = daily(240), str(tmp_path / "in")
    write_in_turn(spark, source, [rows[:200]], CHANGES)
    append(stateful.stream_trends(stream(spark, source, CHANGES)), str(tmp_path))
    write_in_turn(spark, source, [rows[200:]], CHANGES)
    append(stateful.stream_trends(stream(spark, source, CHANGES)), str(tmp_path))
    got = sorted((r.ticker, r.begins, r.ends) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = []
    for t in "AB":
        mine = [r for r in rows if r[1] == t]
        head = mine[:100]
        found, begin = tr.find_segments(np.array([r[4] for r in head]))
        rest = head[begin:] + mine[100:]
        more, _ = tr.find_segments(np.array([r[4] for r in rest]))
        want += [(t, head[s[0]][2], head[s[1]][2]) for s in found] + [(t, rest[s[0]][2], rest[s[1]][2]) for s in more]
    assert got == sorted(want) and len(got) > 2


def test_count_batches(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k string, v int"
    for part in ([("a", i) for i in range(7)], [("a", i) for i in range(7, 12)]):
        write_in_turn(spark, source, [part], schema)
        append(stateful.count_or_timer(stream(spark, source, schema), "k", {"v": "int"}, count=5, wait_ms=0), str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("batch").count().orderBy("batch").collect()
    assert [(r.batch, r["count"]) for r in got] == [(1, 5), (2, 5)]


def wait_for(spark, folder, rows, schema, seconds=60):
    import time

    end = time.time() + seconds
    while time.time() < end:
        if Path(f"{folder}/out").exists() and spark.read.schema(schema).parquet(f"{folder}/out").count() >= rows:
            return
        time.sleep(1)


def run_until(spark, df, folder, rows):
    query = (
        df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/cp").trigger(processingTime="1 second").start()
    )
    try:
        wait_for(spark, folder, rows, df.schema)
    finally:
        query.stop()
    return spark.read.schema(df.schema).parquet(f"{folder}/out").collect()


def test_small_batch_leaves_after_a_while(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k string, v int"
    write_in_turn(spark, source, [[("a", 1), ("a", 2)]], schema)
    df = stateful.count_or_timer(stream(spark, source, schema), "k", {"v": "int"}, count=100, wait_ms=1000)
    got = run_until(spark, df, str(tmp_path), 2)
    assert sorted((r.key, r.batch, r.v) for r in got) == [("a", 1, 1), ("a", 1, 2)]


def test_deltas_with_expiring_state(spark, tmp_path):
    columns = ", ".join(["ticker string", "window_end_time timestamp", *[f"{m} double" for m in w.TRADE_METRICS]])
    source = str(tmp_path / "in")
    write_in_turn(spark, source, [[("A", T0 + timedelta(minutes=5 * i), *[float(i)] * 6) for i in range(3)]], columns)
    got = run_until(spark, stateful.stream_deltas(stream(spark, source, columns), w.TRADE_METRICS, stateful.STATE_TTL_MS), str(tmp_path), 2)
    assert [r.record_count_delta for r in got] == [1.0, 1.0]


def test_fan_out(spark):
    results = spark.createDataFrame([("X", T0 + timedelta(i), f"id{i:02d}") for i in range(16)] + [("Y", T0, "y")], "symbol string, ts timestamp, measure_id string")
    subscribers = spark.createDataFrame([("c1", "X"), ("c2", "X"), ("c3", "Y"), ("c4", "Z")], "connection_id string, symbol string")
    batches = fanout.message_batches(results, ["measure_id"], ["ts"])
    sent = fanout.subscriber_batches(batches, subscribers).orderBy("connection_id", "batch").collect()
    assert [(r.connection_id, len(r.messages)) for r in sent] == [("c1", 7), ("c1", 7), ("c1", 2), ("c2", 7), ("c2", 7), ("c2", 2), ("c3", 1)]
    assert [m.measure_id for m in sent[1].messages] == [f"id{i:02d}" for i in range(7, 14)]


def test_address_lists_split_a_symbol_with_many_subscribers(spark):
    subscribers = spark.createDataFrame([(f"c{i}", "X") for i in range(95)] + [("y", "Y"), ("y", "Y")], "connection_id string, symbol string")
    lists = fanout.address_lists(subscribers, 10).collect()
    assert sum(len(r.connections) for r in lists if r.symbol == "X") == 95 and len([r for r in lists if r.symbol == "X"]) == 10
    assert [r.connections for r in lists if r.symbol == "Y"] == [["y"]]


RESULT = "symbol string, ts timestamp, measure_id string, measurement string"


def test_push_sends_each_micro_batch_to_those_who_are_connected(spark, tmp_path):
    source, sent = str(tmp_path / "in"), []
    book = ledger.Ledger(str(tmp_path / "ledger"))
    rows = [("X", T0 + timedelta(i), f"m{i}", "w") for i in range(8)] + [("X", T0, "m9", None), (None, T0, "m8", "w")]
    who = {0: ["a"], 1: ["a", "b"]}

    def connected(number):
        return spark.createDataFrame([(c, "X") for c in who[number]], "connection_id string, symbol string")

    def send(df, number):
        sent.append((number, sorted((r.batch, len(r.messages), r.connections) for r in df.collect())))

    for part in (rows, [("X", T0, "m0", "w")]):
        write_in_turn(spark, source, [part], RESULT)
        drain(fanout.push(stream(spark, source, RESULT), connected, ["measure_id"], ["ts"], send, str(tmp_path / "cp"), book))
    assert sent == [(0, [(0, 7, ["a"]), (1, 1, ["a"])]), (1, [(0, 1, ["a", "b"])])]
    drain(fanout.push(stream(spark, source, RESULT), connected, ["measure_id"], ["ts"], send, str(tmp_path / "cp-new"), book))
    assert len(sent) == 2


def test_rows_are_numbered_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, None if rng.random() < 0.1 else T0 + timedelta(minutes=rng.randint(0, 600)), i) for i in range(300) for k in ("a", None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int")
    got = series.numbered(df, ["k"], F.date_trunc("hour", "ts"), ["ts", "i"], "n").collect()
    order = lambda r: (r.ts is not None, r.ts or T0, r.i)
    for key in ("a", None):
        mine = sorted((r for r in got if r.k == key), key=order)
        assert [r.n for r in mine] == list(range(300))


TIMED = "k string, v int, ts timestamp"


def test_rows_left_by_a_count_wait_for_a_timer_of_their_own(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path)
    at = lambda s: T0 + timedelta(seconds=s)

    def step(part=None, beat=None):
        if part:
            write_in_turn(spark, source, [part], TIMED)
        if beat is not None:
            inputs.send_beat(spark, folder, "k", at(beat), "ts")
        events = inputs.live_input(stream(spark, source, TIMED), "k", folder, "0 seconds", "ts")
        append(stateful.count_or_timer(events, "k", {"v": "int", "ts": "timestamp"}, 5, 60_000, ["v"], "ts"), folder)
        return sorted((r.batch, r.v) for r in spark.read.schema("key string, batch long, v int").parquet(f"{folder}/out").collect())

    assert step([("a", i, at(i)) for i in range(3)]) == []
    five = [(1, i) for i in range(5)]
    assert step([("a", i, at(40 + i)) for i in range(3, 7)]) == five
    assert step(beat=90) == five  # the timer of the first rows, due after 60 seconds, is gone
    rest = five + [(2, 5), (2, 6)]
    assert step(beat=110) == rest  # a minute after the release at 46
    assert step([("a", 9, at(115))]) == rest
    assert step(beat=168) == rest + [(3, 9)]  # a minute after the last release at 106


def test_a_batch_killed_between_writes_is_done_once(spark, tmp_path):
    book, done = ledger.Ledger(str(tmp_path / "ledger")), []
    rows = spark.range(3).selectExpr("id AS v")
    run = book.new_run(spark, "q")
    assert run == 1 and book.valid_run(spark, "q") is None

    def failing(df, number):
        done.append("b")
        ledger.append_batch(str(tmp_path / "b"), "q", run)(df, number)
        if done.count("b") == 1:
            raise RuntimeError("killed")

    deliver = ledger.once(book, "q", run, {"a": lambda df, n: done.append("a"), "b": failing})
    with pytest.raises(RuntimeError):
        deliver(rows, 0)
    read = lambda: [r.v for r in ledger.appended(spark, book, str(tmp_path / "b"), "q", "b", rows.schema).collect()]
    assert read() == []
    deliver(rows, 0)
    deliver(rows, 0)
    assert done == ["a", "b", "b"] and sorted(read()) == [0, 1, 2]
    again = book.new_run(spark, "q")
    ledger.once(book, "q", again, {"b": ledger.append_batch(str(tmp_path / "b"), "q", again)})(rows.limit(1), 0)
    assert len(read()) == 1 and book.valid_run(spark, "q") == 2
    book.end_run(spark, "q", 1)
    assert len(read()) == 3
    assert ledger.appended(spark, book, str(tmp_path / "b"), "other", "b", rows.schema).collect() == []


def test_an_input_is_idle_while_others_go_on():
    watch = inputs.IdleWatch(["a", "b"], "90 seconds")
    assert watch.look({"a": (5, 100), "b": (5, 90)}, 0) == {}
    assert watch.look({"a": (5, 200)}, 60) == {}
    assert watch.look({"a": (5, 300), "b": (0, None)}, 120) == {"b": 300}
    assert watch.look({"a": (1, 300)}, 130) == {}
    assert watch.look({"a": (1, 400)}, 140) == {"b": 400}
    assert watch.look({"b": (1, 250), "a": (1, 410)}, 150) == {}
    assert watch.look({}, 1000) == {}
    assert inputs.seconds(live.IDLE) == 90 and inputs.seconds("2 minutes") == 120


def test_a_slow_input_loses_nothing_and_an_idle_one_holds_nothing(spark, tmp_path):
    one, two, out = str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "out")
    at = lambda m: T0 + timedelta(minutes=m)

    def step(stocks=(), crypto=()):
        for path, rows in ((one, stocks), (two, crypto)):
            spark.createDataFrame(list(rows), TRADE).coalesce(1).write.mode("append").parquet(path)
        of = lambda path, name: w.trade_windows(inputs.live_input(stream(spark, path, TRADE), name, str(tmp_path)), "5 minutes")
        log = inputs.ProgressLog()
        log.run(spark, lambda: drain(live.trade_sink(w.all_assets(of(one, "stocks"), of(two, "crypto")), out, str(tmp_path / "cp"))))
        found = spark.read.schema("ticker string, window_start_time timestamp, record_count long").parquet(out).collect()
        return sorted((r.ticker, r.window_start_time, r.record_count) for r in found), log

    got, _ = step([("S", 1, at(0), 1.0, 1.0), ("S", 2, at(30), 1.0, 1.0)], [("C", 3, at(0), 1.0, 1.0)])
    assert got == []
    got, log = step([("S", 4, at(60), 1.0, 1.0)], [("C", 5, at(1), 1.0, 1.0), ("C", 6, at(10), 1.0, 1.0)])
    assert got == [("C", at(0), 2), ("S", at(0), 1)]  # 59 minutes behind, and in time
    rows = {r.batch: r for r in log.table(spark).collect()}
    assert sum(r.rows for r in rows.values()) == 3 and max(r.newest for r in rows.values() if r.newest) == at(60)
    got, _ = step([("S", 7, at(90), 1.0, 1.0)])
    assert len(got) == 2
    inputs.send_beat(spark, str(tmp_path), "crypto", at(90).replace(tzinfo=timezone.utc))
    got, _ = step([("S", 8, at(91), 1.0, 1.0)])
    assert got == [("C", at(0), 2), ("C", at(10), 1), ("S", at(0), 1), ("S", at(30), 1), ("S", at(60), 1)]


def test_late_rows_are_counted_one_by_one(spark, tmp_path):
    source, counted = str(tmp_path / "in"), []
    at = lambda m: T0 + timedelta(minutes=m)
    parts = [[("A", 1, at(0), 1.0, 1.0), ("A", 2, at(20), 1.0, 1.0)], [("A", i, at(1), 1.0, 1.0) for i in range(3, 7)] + [("A", 2, at(20), 1.0, 1.0), ("A", 8, at(16), 1.0, 1.0)]]
    for part in parts:
        write_in_turn(spark, source, [part], TRADE)
        events = inputs.distinct_in_window(inputs.live_input(stream(spark, source, TRADE), "t", str(tmp_path)), ["symbol", "trade_id"], "5 minutes")
        log = inputs.ProgressLog()
        log.run(spark, lambda: drain(live.trade_sink(w.trade_windows(events, F.col("w")), str(tmp_path / "out"), str(tmp_path / "cp"))))
        counted += [(r.rows, r.late) for r in log.table(spark).collect() if r.rows]
    assert counted == [(2, 0), (6, 4)]


def test_an_event_log_has_its_schema_and_order(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame(trades(200), TRADE)
    late, early = rows.filter("trade_id % 2 = 1"), rows.filter("trade_id % 2 = 0")
    event_log.write_segment(early, path, 0, ["market_ts", "trade_id"])
    event_log.write_segment(late, path, 1, ["market_ts", "trade_id"])
    event_log.write_segment(late, path, 1, ["market_ts", "trade_id"])
    assert event_log.schema(spark, path).simpleString() == rows.schema.simpleString()
    assert event_log.read(spark, path).count() == 200
    placed = event_log.positions(spark, path).filter("symbol = 'HOT'").orderBy("position").collect()
    assert [r.trade_id % 2 for r in placed] == sorted(r.trade_id % 2 for r in placed)
    assert [r.market_ts for r in placed if r.trade_id % 2] == sorted(r.market_ts for r in placed if r.trade_id % 2)
    drain(event_log.read(spark, path, stream=True, max_files=1).writeStream.format("parquet").option("path", str(tmp_path / "copy")).option("checkpointLocation", str(tmp_path / "cp")))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 200



def test_replayed_tables_keep_rows_without_time(spark, tmp_path):
    rows = [(i, None if i % 10 == 0 else T0 + timedelta(minutes=i)) for i in range(100)]
    df, counts = spark.createDataFrame(rows, "i int, ts timestamp").repartition(3), []
    for part in replay(df, "timed"):
        append(part, str(tmp_path))
        counts.append([r.i for r in spark.read.parquet(f"{tmp_path}/out").collect()])
    assert sorted(counts[-1]) == list(range(100)) and [len(c) for c in counts] == sorted(len(c) for c in counts)
    assert set(range(0, 100, 10)) <= set(counts[0]) and len(counts[0]) < 50


def test_a_stored_table_is_replayed_without_another_copy_and_states_are_not_counted(spark, tmp_path, monkeypatch):
    rows = spark.range(40).selectExpr("id", "timestamp_seconds(id) AS market_ts")
    rows.write.parquet(str(tmp_path / "rows"))
    copies = []
    monkeypatch.setattr(jobs.store, "staged", lambda df, path: copies.append(path) or df)
    seen = [s.isStreaming for s in jobs.replay(spark.read.parquet(str(tmp_path / "rows")), "rows", "market_ts", stored=True)]
    assert seen == [True] * jobs.STEPS and copies == []
    before = [spark.conf.get(x, None) for x in (live.PROVIDER, live.COUNTED)]
    with live.rocksdb(spark):
        assert spark.conf.get(live.COUNTED) == "false"
    assert [spark.conf.get(x, None) for x in (live.PROVIDER, live.COUNTED)] == before
