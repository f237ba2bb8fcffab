import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tickwise.operators import financials as fin
from tickwise.operators import quality as q
from tickwise.functions import periods
from tickwise.sources import bars as bar_source
from tickwise.sources import feed, points, store, universe

STOCK_TRADE = {"T": "t", "S": "TWK", "i": 48213, "x": "V", "p": 87.625, "s": 30, "c": ["F", "I"], "t": "2023-05-17T14:02:09.250Z", "z": "C"}
CRYPTO_TRADE = {"T": "t", "S": "SOL/EUR", "i": 77, "p": 61.0425, "s": 0.0375, "t": "2023-05-17T14:02:10Z", "tks": "S"}
STOCK_QUOTE = {"T": "q", "S": "TWK", "bx": "K", "bp": 87, "bs": 3, "ax": "P", "ap": 88.25, "as": 8, "t": "2023-05-17T14:02:11Z", "c": ["R"], "z": "C"}


def frames(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def test_decode_stock_trade(spark):
    events = feed.envelopes(feed.messages(frames(spark, STOCK_TRADE, [dict(STOCK_TRADE, p=87)])))
    rows = events.orderBy(F.desc("settle.price.nanos")).collect()
    assert rows[0].kind == "stock_trade" and rows[0].settle.price.asDict() == {"units": 87, "nanos": 625_000_000, "currency": "USD"}
    assert rows[1].settle.price.nanos == 0
    assert rows[0].conditions == ["F", "I"] and rows[0].settle.exchange == "V"
    assert rows[0].market_ts == datetime(2023, 5, 17, 14, 2, 9, 250_000) and rows[0].bid is None
    trades, bad = feed.decode_trades(events)
    assert {r.price for r in trades.collect()} == {87.625, 87.0} and bad.count() == 0


def test_decode_crypto_and_quotes(spark):
    crypto = feed.envelopes(feed.messages(frames(spark, CRYPTO_TRADE)), "crypto").first()
    assert (crypto.kind, crypto.settle.price.units, crypto.settle.price.nanos) == ("crypto_trade", 61, 42_500_000)
    assert crypto.settle.lot_size == 0.0375 and crypto.settle.exchange is None
    quotes, _ = feed.decode_quotes(feed.envelopes(feed.messages(frames(spark, STOCK_QUOTE))))
    row = quotes.first()
    assert (row.ask_price, row.bid_price, row.ask_lot, row.bid_lot, row.asset) == (88.25, 87.0, 8.0, 3.0, "stock")


def test_routes_and_errors(spark):
    kinds = [STOCK_QUOTE, STOCK_TRADE, {"T": "success", "msg": "connected"}, {"T": "subscription"}, {"T": "x"}, {"a": 1}]
    routed = feed.messages(frames(spark, kinds)).withColumn("route", feed.route("crypto"))
    assert sorted(r.route for r in routed.collect()) == ["crypto_quotation", "crypto_trade", "subscription", "success", "unknown", "unknown"]
    assert feed.fail_on_errors(routed).count() == 6
    broken = feed.messages(frames(spark, {"T": "error", "msg": "limit"})).withColumn("route", feed.route())
    with pytest.raises(Exception, match="feed error: limit"):
        feed.fail_on_errors(broken).collect()
    with pytest.raises(ValueError):
        feed.route("bonds")


def test_rejected_events(spark):
    rows = feed.envelopes(feed.messages(frames(spark, {k: v for k, v in STOCK_TRADE.items() if k != "p"}, {k: v for k, v in STOCK_TRADE.items() if k != "t"}, dict(STOCK_TRADE, t="1960-01-01T00:00:00Z"))))
    good, bad = feed.decode_trades(rows)
    assert good.count() == 0
    assert sorted(",".join(r.reasons) for r in bad.collect()) == ["market_ts,market_ts_range", "market_ts_range", "settle_price"]


def test_kafka_rows_and_stored_events(spark, tmp_path):
    events = feed.envelopes(feed.messages(frames(spark, STOCK_TRADE)), ingest_ts=F.col("market_ts"))
    row = feed.for_kafka(events).first()
    assert row.key == "TWK" and json.loads(row.value)["kind"] == "stock_trade"
    feed.write_events(events, str(tmp_path / "events"))
    again = feed.read_events(spark, str(tmp_path / "events"))
    assert again.first().settle == events.first().settle
    assert feed.of_kind(again, "stock_trade").count() == 1
    assert feed.since(again, F.lit("2023-05-18").cast("timestamp")).count() == 0


BAR = {"o": 10.0, "h": 12.0, "l": 9.0, "c": 11.0, "vw": 10.5, "v": 100, "t": "2025-01-15T15:00:00Z"}


def test_bar_pages(spark, tmp_path):
    page = {"bars": {"TWK": [BAR, dict(BAR, v=0, t="2025-01-15T15:30:00Z")], "OTH": [dict(BAR, t="2025-01-15T22:00:00Z")]}, "next_page_token": None}
    (tmp_path / "page.json").write_text(json.dumps(page))
    bars = bar_source.bars_from_pages(bar_source.read_pages(spark, str(tmp_path)))
    good, bad = bar_source.validated(bars)
    rows = {r.ticker: r for r in good.collect()}
    assert rows["TWK"].total_trading_value == 1050.0 and rows["TWK"].regular_trading_hours is True
    assert rows["OTH"].regular_trading_hours is False
    assert [r.reasons for r in bad.collect()] == [["volume"]]


@pytest.mark.parametrize("key", ["o", "h", "l", "c", "vw", "v"])
def test_bar_rejections(spark, tmp_path, key):
    (tmp_path / "page.json").write_text(json.dumps({"bars": {"A": [dict(BAR, **{key: -1})]}}))
    good, bad = bar_source.validated(bar_source.bars_from_pages(bar_source.read_pages(spark, str(tmp_path))))
    assert good.count() == 0 and bad.first().reasons == [bar_source.BAR_KEYS[key]]


def test_scan_starts_and_staleness(spark):
    names = spark.createDataFrame([("A",), ("B",)], "ticker string")
    stored = spark.createDataFrame([("A", datetime(2025, 1, 2))], "ticker string, market_ts timestamp")
    starts = {r.ticker: r.start for r in bar_source.scan_starts(names, stored, "2016-01-02").collect()}
    assert starts == {"A": datetime(2025, 1, 2), "B": datetime(2016, 1, 2, 5)}
    latest = spark.createDataFrame([("A", datetime(2025, 1, 2)), ("B", datetime(2025, 1, 9))], "ticker string, latest timestamp")
    stale = q.stale_tickers(latest, F.lit("2025-01-10").cast("timestamp"))
    assert [r.ticker for r in stale.collect()] == ["A"]
    assert [r.ticker for r in q.tickers_without_rows(names, stored).collect()] == ["B"]


def test_volatility(spark):
    values = ["", "17.5", ".", "abc", "18"]
    rows = [("VIX", date(2025, 1, 1 + i), v) for i, v in enumerate(values)]
    got = bar_source.volatility(spark.createDataFrame(rows, "ticker string, day date, value string")).orderBy("day").collect()
    assert [(r.value, r.carry_forward_from) for r in got] == [(17.5, None), (17.5, date(2025, 1, 2)), (17.5, date(2025, 1, 2)), (18.0, None)]


def test_universe(spark, tmp_path):
    pytest.importorskip("yaml")
    text = """
source-data:
  params:
    - market-data: {ticker: BRK.B, company-name: "B, Inc.", stock-series: B, start-date: 2010-01-04}
      fundamentals: {ticker: BRKB}
    - market-data: {ticker: toolong, company-name: " ", start-date: 2011-01-03}
      fundamentals: {skip: true}
"""
    (tmp_path / "u.yml").write_text(text)
    rows = universe.read_universe(spark, str(tmp_path / "u.yml"))
    good, bad = q.split(rows, q.universe_checks())
    assert good.first().start_date == date(2010, 1, 4)
    assert bad.first().reasons == ["ticker", "company"]
    symbols = spark.createDataFrame([("BRKB",), ("BRK.B",), ("X",)], "symbol string")
    assert sorted(r.symbol for r in q.resolve_aliases(symbols, rows).collect()) == ["BRK.B", "BRKB"]
    assert [r.ticker for r in fin.sample_companies(rows, 5, 1).collect()] == ["BRK.B"]
    assert q.duplicates(rows.unionAll(rows), "ticker").count() == 2


# --- points and stored tables ------------------------------------------------


def test_line_protocol(spark):
    df = spark.sql(
        """SELECT 'ABC' AS ticker, '123e4567' AS measure_id, TIMESTAMP '2025-01-01 00:01:00.5' AS window_end_time,
           CAST(100 AS BIGINT) AS record_count, 119.5D AS min_price, CAST(NULL AS DOUBLE) AS max_price, 1e-11D AS tiny"""
    )
    got = points.line_protocol(df, "trades", ["ticker"], ["measure_id", "window_end_time", "record_count", "min_price", "max_price", "tiny"], "window_end_time")
    assert got.first().value == (
        'trades,ticker=ABC measure_id="123e4567",window_end_time=1735689660000000000i,record_count=100i,'
        "min_price=119.5000000000,tiny=0.0000000000 1735689660000000000"
    )


def test_upsert_delete_rename(spark, tmp_path):
    table = store.Table(str(tmp_path / "t"), keys=["ticker", "ts"], partitions=["day"], order=["version"])

    def rows(*values):
        return spark.createDataFrame([(t, ts, d, v, n) for t, ts, d, v, n in values], "ticker string, ts int, day string, v double, version int")

    store.upsert(rows(("A", 1, "d1", 1.0, 1), ("A", 2, "d2", 2.0, 1), ("B", 1, "d1", 3.0, 1)), table)
    store.upsert(rows(("A", 1, "d1", 9.0, 2), ("A", 1, "d1", 8.0, 1), ("C", 3, "d3", 4.0, 1)), table)
    read = lambda: {(r.ticker, r.ts): r.v for r in store.load(spark, table).collect()}
    assert read() == {("A", 1): 9.0, ("A", 2): 2.0, ("B", 1): 3.0, ("C", 3): 4.0}
    store.rename_ticker(spark, table, "A", "Z")
    assert read() == {("Z", 1): 9.0, ("Z", 2): 2.0, ("B", 1): 3.0, ("C", 3): 4.0}
    store.delete(spark, table, F.col("ticker") == "Z")
    assert read() == {("B", 1): 3.0, ("C", 3): 4.0}
    store.delete(spark, table, F.lit(False))
    assert len(read()) == 2


@pytest.mark.parametrize("partitions", [["ticker"], ["day"], ["ticker", "day"]])
def test_rename_onto_a_ticker_with_rows(spark, tmp_path, partitions):
    table = store.Table(str(tmp_path / "t"), keys=["ticker", "ts"], partitions=partitions, order=["version"])
    rows = [("ETH/USD", 1, "d1", 1.0, 2), ("ETH/USD", 2, "d2", 2.0, 1), ("f#A", 1, "d1", 3.0, 1), ("f#A", 2, "d2", 4.0, 5), ("f#A", 7, "d3", 5.0, 1), ("B", 1, "d1", 6.0, 1)]
    df = spark.createDataFrame(rows, "ticker string, ts int, day string, v double, version int")
    store.upsert(df, table)
    store.rename_ticker(spark, table, "ETH/USD", "f#A")
    read = lambda: sorted((r.ticker, r.ts, r.v) for r in store.load(spark, table, df.schema).collect())
    assert read() == [("B", 1, 6.0), ("f#A", 1, 1.0), ("f#A", 2, 4.0), ("f#A", 7, 5.0)]
    store.rename_ticker(spark, table, "none", "f#A")
    store.delete(spark, table, F.col("ticker") == "f#A")
    assert read() == [("B", 1, 6.0)]


def test_null_partitions(spark, tmp_path):
    table = store.Table(str(tmp_path / "t"), keys=["ticker", "ts"], partitions=["ticker"])
    schema = "ticker string, ts int, v double"
    store.upsert(spark.createDataFrame([("A", 1, 1.0), (None, 1, 2.0), (None, 2, 3.0)], schema), table)
    store.upsert(spark.createDataFrame([(None, 2, 4.0)], schema), table)
    read = lambda: sorted((str(r.ticker), r.ts, r.v) for r in store.load(spark, table, spark.createDataFrame([], schema).schema).collect())
    assert read() == [("A", 1, 1.0), ("None", 1, 2.0), ("None", 2, 4.0)]
    store.delete(spark, table, F.col("ticker").isNull())
    assert read() == [("A", 1, 1.0)]


def test_scan_and_documents(spark, tmp_path):
    df = spark.sql(
        "SELECT 'm' AS measurement, CAST(d AS TIMESTAMP) AS ts, d AS day FROM (SELECT explode(sequence(DATE '2025-01-01', DATE '2025-01-05')) AS d)"
    )
    path = str(tmp_path / "series")
    df.write.partitionBy("measurement", "day").parquet(path)
    found = store.scan(spark.read.parquet(path), "m", "2025-01-02", "2025-01-04")
    assert sorted(r.ts.day for r in found.collect()) == [2, 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "measurement" in plan.split("PartitionFilters: [")[1].split("]")[0]
    table = store.document_table(str(tmp_path / "docs"))
    docs = spark.createDataFrame([("f#A", "2023Q1", "{}", 1), ("f#A", "2023Q2", "{}", 1), ("f#A", "2023Q1", '{"x":1}', 2)], "pk string, sk string, body string, version int")
    store.put_documents(docs, table)
    assert store.query_documents(spark, table, "f#A").count() == 2
    assert store.query_documents(spark, table, "f#A", "2023Q1").first().body == '{"x":1}'


def test_stale_mark(spark):
    mark = lambda *d: spark.createDataFrame([(x,) for x in d], "stale_from date")
    assert store.suggest_stale_from(mark(), mark(date(2025, 1, 2))).first().stale_from == date(2025, 1, 2)
    assert store.suggest_stale_from(mark(date(2025, 1, 1)), mark(date(2025, 1, 2))).first().stale_from == date(2025, 1, 1)


# --- financials ----------------------------------------------------------------


def response(annual, quarterly, ticker="A"):
    statement = lambda values: {i: values for i in fin.ITEMS} if values is not None else None
    return {"currency": "USD", "company_info": {"cik": "1", "ticker": ticker, "name": "A"}, "financial_data": {"annual": statement(annual), "quarterly": statement(quarterly)}}


def responses(spark, *rows):
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return lines.select(F.from_json("value", fin.RESPONSE_SCHEMA).alias("r")).select("r.*")


def test_report_rows(spark):
    rows = responses(spark, response({"2016": 10.9, "2017": -3.9}, {"2016-Q1": 1.5}), response(None, {"2016-Q2": 2.0}, "B"), response(None, None, "C"))
    as_of = F.lit("2018-05-10").cast("date")
    annual = {(r.ticker, r.report_period): (r.revenue, r.eps_basic) for r in fin.report_rows(rows, as_of, "A").collect()}
    assert annual == {("A", "2016A"): (10, 10.9), ("A", "2017A"): (-3, -3.9), ("B", "2016A"): (None, None), ("B", "2017A"): (None, None)}
    quarters = fin.report_rows(rows, as_of, "Q")
    labels = sorted(r.report_period for r in quarters.filter("ticker = 'A'").collect())
    assert (labels[0], labels[-1], len(labels)) == ("2016Q1", "2018Q1", 9)
    assert quarters.filter("report_period = '2016Q2' AND ticker = 'B'").first().revenue == 2
    stored = quarters.filter("fiscal_year < 2018")
    assert sorted((r.ticker, r.report_period) for r in fin.new_periods(quarters, stored).collect()) == [("A", "2018Q1"), ("B", "2018Q1")]
    assert fin.statements(quarters, "A", "2016Q1").first().revenue == 1


@pytest.mark.parametrize("day, annual, quarter", [("2025-01-10", "2024A", "2024Q4"), ("2025-04-01", "2024A", "2025Q1"), ("2025-12-31", "2024A", "2025Q3")])
def test_latest_periods(spark, day, annual, quarter):
    as_of = F.lit(day).cast("date")
    row = spark.range(1).select(periods.latest_annual(as_of).alias("a"), periods.latest_quarter(as_of).alias("q"), periods.parse_period(F.lit(quarter)).alias("p"), periods.parse_period(F.lit("23Q1")).alias("bad")).first()
    assert (row.a, row.q) == (annual, quarter)
    assert (row.p.fiscal_year, row.p.period) == (int(quarter[:4]), quarter[4:])
    assert row.bad.fiscal_year is None


def test_schema_check(spark):
    df = spark.createDataFrame([(1, 2)], "label int, a int")
    assert q.check_columns(df, ["label", "a"], "label").columns == ["label", "a"]
    with pytest.raises(TypeError, match="missing"):
        q.check_columns(df, ["label", "b"], "label")
    with pytest.raises(TypeError, match="first column"):
        q.check_columns(df, ["label", "a"], "a")
