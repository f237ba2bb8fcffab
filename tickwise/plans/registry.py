"""Every operator and composed query, run over the whole benchmark tables.

Doubles are shown in single precision, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tickwise.functions import calendar as cal
from tickwise.functions import chart, periods, scalar
from tickwise.operators import bars as bar_ops
from tickwise.operators import drawdown as dd
from tickwise.operators import financials as fin
from tickwise.operators import index as ix
from tickwise.operators import quality, series, trends, windows
from tickwise.plans import features as feat
from tickwise.plans import market_index as mi
from tickwise.plans import microstructure as ms
from tickwise.plans import stored
from tickwise.plans.rounding import shown
from tickwise.sources import bars as bar_source
from tickwise.session import fresh_path
from tickwise.sources import feed, pages, points, polling, store, tables, universe
from tickwise.streaming import fanout
from tickwise.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

EVERY = "6 hours"
SEQUENCE = ["market_ts", "sequence"]
BASE_DATE, RESULTS_FROM, FEATURE_START, PROVISIONAL_FROM = "1995-01-01", "1996-01-01", "1995-06-01", "2001-01-01"
STATEMENTS_AS_OF = "2001-12-31"
FIRST_STATEMENT_YEAR = 1995
#: Fewer than the 25 tickers of the data, so that the list of the most traded cuts.
TOP_MEMBERS = 10


def rounded(df: DataFrame) -> DataFrame:
    def column(f: T.StructField):
        name = F.col(f"`{f.name}`")
        return shown(name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else name

    return df.select(*[column(f) for f in df.schema])


# --- shared inputs -----------------------------------------------------------


def _trade_windows(spark, d):
    return windows.trade_windows(tables.trades(spark, d), EVERY)


def _quote_windows(spark, d, closing=False):
    return windows.quote_windows(tables.quotes(spark, d), EVERY, closing=closing)


def _daily(spark, d, regular=True):
    return bar_ops.daily_bars(tables.bars(spark, d), regular, SEQUENCE)


def _members(spark, d, regular=True):
    return ix.index_members(_daily(spark, d, regular), regular_hours=regular)


def _index(spark, d, regular=True, geometric=False):
    return ix.index_series(_members(spark, d, regular), regular, geometric)


def _levels(spark, d):
    return dd.drawdown(_index(spark, d))


def _volatility(spark, d):
    return bar_source.volatility(tables.volatility_observations(spark, d))


# --- live windows ------------------------------------------------------------


def window_medians(spark, d):
    """Exact median and scaled deviation of the ask prices per symbol and window."""
    levels = windows.quote_levels(tables.quotes(spark, d), EVERY)
    flagged = windows.flag_outliers(levels, ["ticker", "w", "side"])
    return flagged.groupBy("ticker", F.col("w.end").alias("window_end_time"), "side").agg(
        F.max("median").alias("median"),
        F.max("deviation").alias("deviation"),
        F.sum("quotes").alias("quotes"),
        F.sum(F.when(F.col("kept"), F.col("quotes")).otherwise(0)).alias("kept"),
    )


def microstructure_stepped(spark, d):
    """Windows of one minute, averaged over the quarter-hour steps of a week's look-back."""
    quotes = windows.quote_windows(tables.quotes(spark, d), "1 minute")
    trades = windows.trade_windows(tables.trades(spark, d), "1 minute")
    return ms.microstructure_metrics(quotes, trades, look_back="-7d")


def microstructure_cumulative(spark, d):
    metrics = ms.microstructure_metrics(_quote_windows(spark, d), _trade_windows(spark, d))
    return ms.metric_series(metrics, "mid_change", cumulative=True)


def primitives_cumulative(spark, d):
    """The changes summed up over time, and a level, which isn't."""
    rows = ms.microstructure_primitives(_quote_windows(spark, d), _trade_windows(spark, d))
    names = ["ask_change", "spread", "mid"]
    return reduce(DataFrame.unionByName, [ms.metric_series(rows, x, cumulative=True) for x in names])


def line_protocol(spark, d):
    rows = _trade_windows(spark, d)
    fields = [c for c in rows.columns if c != "ticker"]
    exact = rows.select(*[shown(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])
    return points.line_protocol(exact, windows.TRADE_WINDOWS, ["ticker"], fields, "window_end_time")


def subscriber_batches(spark, d):
    results = _trade_windows(spark, d).withColumnRenamed("ticker", "symbol")
    batches = fanout.message_batches(results, ["measure_id"], ["window_end_time", "measure_id"])
    sent = fanout.subscriber_batches(batches, tables.subscriptions(spark, d))
    return sent.select(
        "connection_id", "symbol", "batch", F.size("messages").alias("size"),
        F.concat_ws(",", "messages.measure_id").alias("ids"),
    )


def latest_per_id(spark, d):
    rows = tables.read(spark, d, "events").select(
        F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value"
    )
    return series.latest_per_id(rows, "id", ["ts", "event_id"])


def chart_points(spark, d):
    rows = _trade_windows(spark, d)
    return chart.chart_points(rows, "sum_notional", "price_at_window_end", "window_end_time", ["ticker"])


def nearest_points(spark, d):
    """The trade window nearest to each event, among the windows of its symbol that hold more than fifteen trades, if one ends within five hours of it."""
    rows = _trade_windows(spark, d).filter(F.col("record_count") > 15).select("ticker", F.col("window_end_time").alias("ts"), "record_count", "sum_notional")
    asked = tables.trades(spark, d).select(F.col("symbol").alias("ticker"), F.col("market_ts").alias("ts"), "trade_id")
    return chart.nearest_points(rows, asked, ["ticker"], "ts", ["record_count", "sum_notional"], 5 * 3600.0)


def polylines(spark, d):
    """The trade windows as lines of notional over the time of day, in pieces of fifty points."""
    return chart.polylines(chart_points(spark, d), ["ticker"], 50, digits=2)


def throughput(spark, d):
    return quality.throughput(tables.trades(spark, d))


# --- feed --------------------------------------------------------------------


def _frames(spark, d, *more):
    """Feed frames written from the events: trades, quotes and control messages, some without price or time, some from long ago."""
    e = tables.read(spark, d, "events").select(
        "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    kind = (
        F.when(F.col("event_type") == "signup", "q").when(F.col("event_type") == "error", "subscription")
        .when(F.col("event_type") == "view", "x").otherwise("t")
    )
    price = F.when(F.col("k") != 7, F.col("value"))
    sent = F.when(F.col("k") == 11, F.lit("1950-01-01").cast("timestamp")).when(F.col("k") != 13, F.col("ts"))
    body = F.struct(
        kind.alias("T"), F.col("event_type").alias("S"), F.col("event_id").alias("i"), F.lit("X").alias("x"),
        price.alias("p"), F.col("k").alias("s"), sent.alias("t"), F.lit("A").alias("z"),
        price.alias("ap"), F.col("k").alias("as"), price.alias("bp"), F.col("k").alias("bs"),
    )
    json = F.to_json(body, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return e.select(F.when(F.col("event_id") % 2 == 0, json).otherwise(F.concat(F.lit("["), json, F.lit("]"))).alias("value"), *more)


def route_messages(spark, d):
    decoded = feed.messages(_frames(spark, d))
    return decoded.groupBy(feed.route("stocks").alias("route")).agg(
        F.count(F.lit(1)).alias("messages"), F.sum("trade_id").alias("ids")
    )


def _envelopes(spark, d):
    return feed.envelopes(feed.messages(_frames(spark, d)), "stocks", F.col("market_ts"))


def decoded_trades(spark, d):
    good, _ = feed.decode_trades(_envelopes(spark, d))
    return good.select("symbol", "asset", "trade_id", "market_ts", "price", "lot_size", "exchange", "currency", "tape")


def decoded_quotes(spark, d):
    good, _ = feed.decode_quotes(_envelopes(spark, d))
    return good.select("symbol", "asset", "market_ts", "ask_price", "ask_lot", "bid_price", "bid_lot", "tape")


def rejected_quotes(spark, d):
    _, bad = feed.decode_quotes(_envelopes(spark, d))
    return bad.select("symbol", F.concat_ws(",", "reasons").alias("reasons")).groupBy("symbol", "reasons").agg(F.count(F.lit(1)).alias("quotes"))


def rejected_trades(spark, d):
    _, bad = feed.decode_trades(_envelopes(spark, d))
    return bad.select("symbol", "trade_id", F.concat_ws(",", "reasons").alias("reasons"))


def money_split(spark, d):
    money = scalar.money_from_number(F.col("o_totalprice"))
    return tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), money.alias("m")).select(
        "id", "m.units", "m.nanos", "m.currency", scalar.money_amount("m.units", "m.nanos").cast("double").alias("amount")
    )


def asset_union(spark, d):
    """Two asset classes windowed on their own, then put together."""
    rows = tables.trades(spark, d)
    crypto = F.col("symbol").isin("view", "error")
    return windows.all_assets(
        windows.trade_windows(rows.filter(~crypto), EVERY), windows.trade_windows(rows.filter(crypto), EVERY)
    )


def shared_tags(spark, d):
    """Map intersection: tags of a trade that its window also carries."""
    rows = tables.trades(spark, d).select(
        "trade_id",
        F.create_map(F.col("symbol"), F.lit("a"), F.lit("tape"), F.lit("A")).alias("mine"),
        F.create_map(F.when(F.col("lot_size") > 50, F.col("symbol")).otherwise("none"), F.col("lot_size").cast("int").cast("string")).alias("theirs"),
    )
    return rows.select("trade_id", F.concat_ws(",", F.map_values(scalar.shared_keys("mine", "theirs"))).alias("shared"))


# --- bars and calendar -------------------------------------------------------


def _raw_bars(spark, d):
    """Bars of single trades, some with one price that is zero, negative or missing."""
    broken = lambda n, value: F.when(F.col("trade_id") % n == 0, value)
    price = F.col("price")
    return tables.trades(spark, d).select(
        F.col("symbol").alias("ticker"), "trade_id", "market_ts",
        broken(11, F.lit(0.0)).otherwise(price).alias("opening_price"), broken(13, -price).otherwise(price).alias("closing_price"),
        broken(17, F.lit(None).cast("double")).otherwise(price * 1.01).alias("high_price"), broken(19, F.lit(0.0)).otherwise(price * 0.99).alias("low_price"),
        broken(23, -price).otherwise(price).alias("volume_weighted_avg_price"), F.col("lot_size").alias("volume"),
    )


def bar_validation(spark, d):
    good, _ = bar_source.validated(_raw_bars(spark, d))
    return good.select("ticker", "trade_id", "market_ts", "total_trading_value", "regular_trading_hours")


def bar_rejections(spark, d):
    _, bad = bar_source.validated(_raw_bars(spark, d))
    return bad.select("ticker", "trade_id", F.concat_ws(",", "reasons").alias("reasons"))


def _ship_days(spark, d):
    return tables.read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()


def _later_days(spark, d):
    """The order dates 24 years on, among them Good Fridays that the calendar lists."""
    return tables.read(spark, d, "orders").select(F.date_add(F.to_date("o_orderdate"), 8766).alias("day")).distinct()


def stale_tickers(spark, d):
    rows = tables.read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("timestamp").alias("market_ts")
    )
    as_of = rows.select(F.max("market_ts")).scalar()
    return quality.stale_tickers(bar_ops.time_bounds(rows), as_of)


def scan_starts(spark, d):
    names = tables.read(spark, d, "supplier").select(F.col("s_name").alias("ticker"), "s_suppkey")
    sold = tables.read(spark, d, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("timestamp").alias("market_ts"))
    rows = sold.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select("ticker", "market_ts")
    listed = names.unionByName(names.select(F.concat("ticker", F.lit(".NEW")).alias("ticker"), "s_suppkey"))
    return bar_source.scan_starts(listed, rows, "1995-01-01")


def _landed(spark, d):
    """Pages of a hundred bars and the start of each ticker: 1998 for the even ones, all for the others, and a ticker that has none."""
    bars = tables.bars(spark, d).withColumn("volume", F.col("volume").cast("long"))
    path = fresh_path(spark, "bar-pages")
    pages.land_pages(bars, path, SEQUENCE, 100, together=100)
    nations = tables.read(spark, d, "nation")
    start = F.when(F.col("n_nationkey") % 2 == 0, F.lit("1998-01-01")).otherwise(F.lit("1990-01-01")).cast("timestamp")
    known = nations.select(F.col("n_name").alias("ticker"), start.alias("start"))
    starts = known.unionByName(known.groupBy(F.lit("GONE").alias("ticker")).agg(F.max("start").alias("start")))
    return path, starts


def paged_bars(spark, d):
    path, starts = _landed(spark, d)
    rows = pages.read_bars(spark, path, starts, pushdown=True)
    return rows.filter(F.col("market_ts") >= F.lit("1995-01-01").cast("timestamp"))


def tickers_without_pages(spark, d):
    path, starts = _landed(spark, d)
    return quality.tickers_without_rows(starts, pages.read_bars(spark, path, starts))


def earliest_touched(spark, d):
    return bar_ops.earliest_touched(scan_starts(spark, d))


def top_tickers(spark, d):
    monthly = bar_ops.monthly_traded_value(tables.bars(spark, d), include_last_day=True, digits=None)
    return bar_ops.top_by_value(monthly.filter(F.col("month") == "2000-06").drop("month"), 10)


def first_since(spark, d):
    return bar_ops.first_since(tables.bars(spark, d), "closing_price", "1996-01-01", order=SEQUENCE)


def universe_rejections(spark, d):
    _, bad = quality.split(tables.universe(spark, d), quality.universe_checks())
    return bad.select("row_id", F.concat_ws(",", "reasons").alias("reasons"))


def universe_duplicates(spark, d):
    rows = tables.universe(spark, d)
    tickers = quality.duplicates(rows, "ticker").select(F.lit("ticker").alias("field"), F.col("ticker").alias("value"), "occurrences")
    companies = quality.duplicates(rows, "company").select(F.lit("company").alias("field"), F.col("company").alias("value"), "occurrences")
    return tickers.unionByName(companies)


def tickers_without_rows(spark, d):
    """Parts under their key and, for every seventh, under a key that was never sold."""
    key = F.when(F.col("p_partkey") % 7 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey"))
    parts = tables.read(spark, d, "part").select(key.alias("ticker"), "p_name")
    return quality.tickers_without_rows(parts, tables.read(spark, d, "lineitem").select(F.col("l_partkey").alias("ticker")))


def ticker_aliases(spark, d):
    """Symbols found under a market or a fundamentals ticker."""
    known = tables.read(spark, d, "supplier").select(
        F.col("s_name").alias("ticker"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("F"), F.col("s_suppkey"))).alias("fundamentals_ticker"),
    )
    asked = tables.read(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("F"), F.col("c_custkey") % 1000).alias("symbol")
    )
    return quality.resolve_aliases(asked, known).select("c_custkey", "symbol", "ticker")


def polling_hours(spark, d):
    return tables.trades(spark, d).groupBy(polling.in_polling_hours("market_ts").alias("polled")).agg(
        F.count(F.lit(1)).alias("events")
    )


def report_periods(spark, d):
    """Period labels of the order dates, parsed again, with the latest ended periods."""
    day = F.to_date("o_orderdate")
    label = periods.period_label(F.year(day), F.concat(F.lit("Q"), F.quarter(day)))
    rows = tables.read(spark, d, "orders").select(day.alias("day"), label.alias("label")).distinct()
    parsed = periods.parse_period("label")
    return rows.select(
        "day", "label", parsed["fiscal_year"].alias("fiscal_year"), parsed["period"].alias("period"),
        periods.latest_annual(F.col("day")).alias("latest_annual"), periods.latest_quarter(F.col("day")).alias("latest_quarter"),
    )


# --- index -------------------------------------------------------------------


def index_members(spark, d, regular=True):
    return rounded(_members(spark, d, regular)).drop("company", "measurement")


def member_state(spark, d):
    return ix.member_state(_members(spark, d), "1998-01-01")


def index_recompute(spark, d):
    """The last year's member rows from a continued run."""
    daily = _daily(spark, d)
    recent = ix.recompute_from(daily, ix.index_members(daily), "2001-01-02")
    return recent.select("ticker", "day", "price_change_avg", "prev_price_change_avg")


def price_change_months(spark, d):
    return bar_ops.price_change_rollup(_members(spark, d), F.trunc("day", "month"))


def long_series(spark, d):
    return series.to_long(_index(spark, d), ["ts"], ["price_change_avg", "price_change_low", "price_change_high"])


def wide_series(spark, d):
    long = series.matching_fields(long_series(spark, d), "^price_change_(avg|low)$")
    return series.to_wide(long, ["ts"], ["price_change_avg", "price_change_low"])


def moving_average(spark, d):
    return series.moving_average(_index(spark, d), "price_change_avg", 42, mi.KEYS).select("ts", "moving_average")


def kaufman(spark, d):
    return series.kaufman_average(_index(spark, d), "price_change_avg", 10, mi.KEYS).select("ts", "kaufman_average")


def polled_rows(spark, d):
    """Index rows still to be analysed when results end in the year 2000."""
    index = _index(spark, d)
    results = dd.drawdown(index).filter(F.col("ts") < "2001-01-01")
    return polling.rows_to_process(index, results, "1995-01-01").select("ts", "price_change_avg")


def drawdown_labels(spark, d):
    return dd.drawdown_labels(_levels(spark, d), 25).drop("measurement", "ticker")


def member_drawdown(spark, d):
    return dd.drawdown(_members(spark, d)).drop("measurement")


def drawdown_provisional(spark, d):
    return dd.drawdown(_index(spark, d), as_of=PROVISIONAL_FROM).drop("measurement", "ticker")


def linear_regression(spark, d):
    return trends.linear_regression(_members(spark, d), "price_change_avg", ["ticker"])


def trend_segments(spark, d):
    return trends.trend_segments(_members(spark, d))


def trend_analysis(spark, d):
    return mi.trend_analysis(trends.trend_segments(_index(spark, d)))


def largest_deviation(spark, d):
    """The row of each member's year that departs most from the row seven places before it."""
    by = Window.partitionBy("ticker", "year").orderBy("day")
    rows = _members(spark, d).select("ticker", F.year("day").alias("year"), "day", "price_change_avg")
    rows = rows.withColumn("position", F.row_number().over(by) - 1)
    shifted = rows.filter(F.col("position") >= 7).withColumn("position", F.col("position") - 7)
    return trends.largest_deviation(shifted, rows, "price_change_avg", ["ticker", "year"])


# --- features ----------------------------------------------------------------


def member_spread(spark, d):
    return feat.member_spread(_members(spark, d, regular=False), FEATURE_START, n=TOP_MEMBERS)


def _features(program, spark, d):
    # both flavours of the bars come from one step, and the index, read by three of the five inputs, has a row a day
    both = store.staged(bar_ops.daily_bars_both(tables.bars(spark, d), SEQUENCE), fresh_path(spark, "daily"))
    regular = ix.index_members(both.filter("regular IS NOT NULL").select("regular.*"))
    extended = ix.index_members(both.select("extended.*"), regular_hours=False)
    index = store.staged(ix.index_series(regular), fresh_path(spark, "index"))
    return feat.daily_features(program, dd.drawdown(index), index, extended, _volatility(spark, d), FEATURE_START, top=TOP_MEMBERS)


def features(program, spark, d):
    return rounded(_features(program, spark, d))


def features_doubled_days(spark, d):
    """Every day has two rows of the index and of the volatility; those of noon are the last."""
    noon = F.col("ts") + F.make_dt_interval(hours=F.lit(12))
    index = store.staged(_index(spark, d), fresh_path(spark, "index"))
    raised = [(F.col(c) * 1.01).alias(c) if c.startswith("price_change") or c == "total_trading_value" else F.col(c) for c in index.columns]
    both = index.withColumn("ts", noon).unionByName(index.select(*raised))
    vix = _volatility(spark, d).withColumn("ts", F.col("day").cast("timestamp"))
    both_vix = vix.withColumn("ts", noon).unionByName(vix.withColumn("value", F.col("value") + 1))
    return rounded(feat.daily_features(feat.NEXT_BANK_DAY, dd.drawdown(both), both, _members(spark, d, regular=False), both_vix, FEATURE_START, top=TOP_MEMBERS))


def training_rows(spark, d):
    return quality.hold_out_tail(features(feat.NEXT_BANK_DAY, spark, d))


def feature_points(spark, d):
    rows = _features(feat.FORWARD_TWO_WEEKS, spark, d)
    points_ = rows.select(
        *[shown(F.col(c)).cast("decimal(38,6)").alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    )
    return feat.feature_lines(points_, feat.FORWARD_TWO_WEEKS)


def predictions(spark, d):
    """Train on all but the last 375 days and predict every day."""
    rows = store.staged(_features(feat.NEXT_BANK_DAY, spark, d).repartition("day").sortWithinPartitions("day"), fresh_path(spark, "training"))
    model = feat.train(quality.hold_out_tail(rows), feat.NEXT_BANK_DAY)
    return feat.predict(rows, model, feat.NEXT_BANK_DAY)


def predictions_by_tree(spark, d):
    """Like ``predictions`` with columns drawn per tree, and forty trees."""
    rows = store.staged(_features(feat.NEXT_BANK_DAY, spark, d).repartition("day").sortWithinPartitions("day"), fresh_path(spark, "training"))
    model, _ = feat.train_by_tree(quality.hold_out_tail(rows), feat.NEXT_BANK_DAY, rounds=40)
    return model.predicted(rows, feat.NEXT_BANK_DAY.label + "_predicted").select("day", F.col(feat.NEXT_BANK_DAY.label + "_predicted").alias("prediction"))


# --- streaming ---------------------------------------------------------------


def pushed_batches(spark, d):
    """Trade windows pushed to customers: a quarter connects at each delivery, some have left by the third; some windows lack their measurement."""
    valid = F.when(F.col("record_count") % 11 != 0, F.lit(windows.TRADE_WINDOWS))
    results = _trade_windows(spark, d).withColumnRenamed("ticker", "symbol").withColumn("measurement", valid)
    customers = tables.subscriptions(spark, d).withColumn("n", F.col("connection_id").cast("long"))

    def connected(delivery: int) -> DataFrame:
        return customers.filter((F.col("n") % 4 <= delivery) & ((F.col("n") % 7 != 0) | F.lit(delivery < 2))).drop("n")

    sent = jobs.pushed_batches(spark, results.select("symbol", "measure_id", "measurement", "window_end_time"), connected, ["measure_id"], ["window_end_time", "measure_id"])
    return sent.groupBy("delivery", "symbol", "batch").agg(
        F.first(F.concat_ws(",", "messages.measure_id")).alias("ids"), F.sum(F.size("connections")).alias("connections")
    )


# --- financials --------------------------------------------------------------


def _reports(spark, d, kind):
    responses = fin.responses_from_totals(tables.statement_totals(spark, d))
    return fin.report_rows(responses, F.lit(STATEMENTS_AS_OF).cast("date"), kind, FIRST_STATEMENT_YEAR)


def financial_periods(kind, spark, d):
    return _reports(spark, d, kind)


def new_report_periods(spark, d):
    reports = _reports(spark, d, "Q")
    stored = reports.filter(F.col("fiscal_year") < 2000)
    return fin.new_periods(reports, stored).select("ticker", "report_period", "revenue", "eps_basic")


def statement_lookup(spark, d):
    return fin.statements(_reports(spark, d, "Q"), "BUILDING", "1998Q2")


# --- lookups and checks ------------------------------------------------------


def series_scan(spark, d):
    """A year of the regular index from a table that holds both flavours."""
    table = store.Table(fresh_path(spark, "series"), ["measurement", "ts"], ["measurement"])
    store.upsert(_index(spark, d).unionByName(_index(spark, d, regular=False)).select("measurement", "ts", "price_change_avg", "total_trading_value"), table)
    return store.scan(store.load(spark, table), ix.measurements(True)[1], "1997-01-01", "1998-01-01")


def document_lookup(spark, d):
    """The documents of one customer, and of another one of one kind."""
    orders = tables.read(spark, d, "orders")
    rows = orders.select(
        F.concat(F.lit("f#"), "o_custkey").alias("pk"), F.col("o_orderstatus").alias("sk"),
        F.col("o_orderkey").cast("string").alias("body"), F.col("o_orderkey").alias("version"),
    )
    table = store.document_table(fresh_path(spark, "documents"))
    store.put_documents(rows, table)
    first, last = (f"f#{k}" for k in orders.agg(F.min("o_custkey"), F.max("o_custkey")).first())
    return store.query_documents(spark, table, first).unionByName(store.query_documents(spark, table, last, "F"))


def training_export(spark, d):
    """The exported file, read again: no header, the label first, the last days left out."""
    program = feat.NEXT_BANK_DAY
    out = fresh_path(spark, "export")
    feat.export_csv(features(program, spark, d), program, out, "run")
    return spark.read.schema(", ".join(f"{c} double" for c in program.columns)).csv(f"{out}/{program.name}/latest")


def universe_table(spark, d):
    """The universe as a configured table of nations, read back with its schema."""
    nations = tables.read(spark, d, "nation")
    rows = nations.select(
        F.col("n_name").alias("ticker"), F.concat("n_name", F.lit(" Inc")).alias("company"), F.lit("1990-01-01").alias("start_date"), (F.col("n_nationkey") % 5 == 0).alias("skip")
    )
    path = fresh_path(spark, "universe")
    rows.write.json(path)
    return universe.read_universe_table(spark, path)


def sampled_companies(spark, d):
    """Ten companies a run, drawn from those that aren't skipped; the run's seed says which."""
    return fin.sample_companies(universe_table(spark, d), 10, 7).select(F.count("ticker").over(Window.partitionBy("skip")).alias("companies"), "skip").distinct()


def session_feed(spark, d):
    """Trades from an hour before the opening bell of the last day on."""
    rows = tables.trades(spark, d)
    last = rows.select(F.to_date(F.max("market_ts")).cast("string")).first()[0]
    return feed.since(rows, cal.feed_start(last))


def statement_responses(spark, d):
    """Responses with annual statements, with quarterly ones, and with neither, which are left out."""
    responses = fin.responses_from_totals(tables.statement_totals(spark, d))
    ticker = F.col("company_info.ticker")
    kept = lambda part, when: F.when(when, F.col(f"financial_data.{part}")).alias(part)
    data = F.struct(kept("annual", ticker < "C"), kept("quarterly", ticker.between("B", "G"))).alias("financial_data")
    return responses.select(ticker.alias("ticker"), data).filter(fin.has_statements()).select(
        "ticker", F.col("financial_data.annual").isNotNull().alias("annual"), F.col("financial_data.quarterly").isNotNull().alias("quarterly")
    )


def least_instants(spark, d):
    """The earliest of up to three optional times of each event."""
    ts = F.col("ts").cast("timestamp")
    later = lambda n, hours: F.when(F.col("event_id") % n != 0, ts + F.make_dt_interval(hours=F.lit(hours)))
    first = cal.earliest(later(2, 5), later(3, 3), later(5, 4))
    return tables.read(spark, d, "events").select("event_id", first.alias("earliest"))


def checked_features(spark, d):
    """Feature rows with exactly the declared columns, the label first; rows of other columns are refused."""
    program = feat.FORWARD_TWO_WEEKS
    rows = features(program, spark, d).drop("day")
    refused = 0
    for wrong in (rows.drop("vix"), rows.withColumn("more", F.lit(1)), rows.select(*reversed(rows.columns))):
        try:
            quality.check_columns(wrong, program.columns, program.label)
        except TypeError:
            refused += 1
    return quality.check_columns(rows, program.columns, program.label).agg(F.count(F.lit(1)).alias("rows"), F.max("vix").alias("vix")).withColumn("refused", F.lit(refused))


def quotations_of_a_day(spark, d):
    """Windows of one symbol that ended on the tenth day of the data."""
    first = tables.quotes(spark, d).select(F.date_trunc("day", F.min("market_ts"))).scalar()
    start = first + F.make_dt_interval(days=F.lit(9))
    return ms.windowed_quotations(_quote_windows(spark, d, closing=True), "purchase", start, start + F.make_dt_interval(days=F.lit(1)))


def quotations_of_the_last_hour(spark, d):
    """Windows of all symbols that ended in the hour up to half an hour after the newest one."""
    rows = _quote_windows(spark, d, closing=True)
    return ms.last_hour(rows, None, rows.select(F.max("window_end_time") + F.make_dt_interval(mins=F.lit(30))).scalar())


# --- dashboard parts ---------------------------------------------------------


def renamed_fields(spark, d):
    rows = _trade_windows(spark, d)
    long = series.to_long(rows, ["ticker", "window_end_time"], ["volume_weighted_avg_price", "sum_notional", "max_price"])
    return ms.renamed_fields(long)


def bank_day_range(spark, d):
    """The bank days from the first to the last order."""
    days = tables.read(spark, d, "orders").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    first, last = days.select(F.to_date("first").cast("string"), F.to_date("last").cast("string")).first()
    return cal.bank_days(days, first, last)


def index_level_anchored(spark, d):
    levels = mi.index_level(_index(spark, d)).select("ts", "value")
    return ms.with_anchors(levels, [0.0, 2.5], F.lit("2002-01-01").cast("timestamp"))


def epochs(spark, d):
    """Event times as epochs of four resolutions, brought back to milliseconds."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    scale = F.element_at(F.array(*[F.lit(10**n).cast("long") for n in (0, 3, 6, 9)]), (F.col("event_id") % 4 + 1).cast("int"))
    return tables.read(spark, d, "events").select("event_id", scalar.epoch_to_millis(seconds * scale).alias("millis"))


def queries() -> dict[str, Query]:
    def table(fn) -> Query:
        return lambda spark, d: rounded(fn(spark, d))

    def on_quotes(build, /, closing=False, **options) -> Query:
        return table(lambda s, d: build(_quote_windows(s, d, closing), **options))

    def on_both(build, /, **options) -> Query:
        return table(lambda s, d: build(_quote_windows(s, d), _trade_windows(s, d), **options))

    def on_index(build, /, *args, **options) -> Query:
        return table(lambda s, d: build(_index(s, d), *args, **options).drop("measurement", "ticker", "company"))

    def on_members(build, /, *args, **options) -> Query:
        return table(lambda s, d: build(_members(s, d), *args, **options).drop("measurement", "company"))

    return {
        # live windows
        "trade_windows": table(_trade_windows),
        "quote_windows": table(_quote_windows),
        "window_medians": table(window_medians),
        "trade_deltas": table(lambda s, d: windows.trade_deltas(_trade_windows(s, d))),
        "quote_deltas": on_quotes(windows.quote_deltas),
        "microstructure_metrics": on_both(ms.microstructure_metrics),
        "microstructure_stepped": table(microstructure_stepped),
        "microstructure_cumulative": table(microstructure_cumulative),
        "microstructure_lagged": on_both(ms.microstructure_lagged, step_seconds=6 * 3600),
        "microstructure_primitives": on_both(ms.microstructure_primitives),
        "primitives_cumulative": table(primitives_cumulative),
        "bid_ask_ratio": on_quotes(ms.bid_ask_ratio),
        "bid_ask_ratio_basket": on_quotes(ms.bid_ask_ratio, by_ticker=False),
        "institutional_pressure": on_quotes(ms.institutional_pressure, closing=True),
        "institutional_pressure_basket": on_quotes(ms.institutional_pressure, closing=True, by_ticker=False),
        "quote_totals": on_quotes(ms.quote_totals),
        "quote_totals_by_ticker": on_quotes(ms.quote_totals, by_ticker=True, excluded=["click"]),
        "trade_notional": table(lambda s, d: ms.traded_notional(_trade_windows(s, d), excluded=["click", "view"])),
        "windowed_quotations": on_quotes(ms.windowed_quotations, closing=True),
        "line_protocol": line_protocol,
        "subscriber_batches": subscriber_batches,
        "latest_per_id": table(latest_per_id),
        "chart_points": table(chart_points),
        "nearest_points": table(nearest_points),
        "polylines": polylines,
        "throughput": throughput,
        "asset_union": table(asset_union),
        "shared_tags": shared_tags,
        # feed
        "route_messages": route_messages,
        "decoded_trades": table(decoded_trades),
        "rejected_trades": rejected_trades,
        "decoded_quotes": table(decoded_quotes),
        "rejected_quotes": rejected_quotes,
        "money_split": table(money_split),
        # bars and calendar
        "bar_validation": table(bar_validation),
        "bar_rejections": bar_rejections,
        "daily_bars": table(lambda s, d: _daily(s, d)),
        "daily_bars_extended": table(lambda s, d: _daily(s, d, False)),
        "monthly_volumes": table(lambda s, d: bar_ops.monthly_traded_value(tables.bars(s, d), digits=None)),
        "top_tickers": table(top_tickers),
        "time_bounds": lambda s, d: bar_ops.time_bounds(tables.bars(s, d)),
        "first_since": table(first_since),
        "stale_tickers": stale_tickers,
        "scan_starts": scan_starts,
        "paged_bars": table(paged_bars),
        "tickers_without_pages": tickers_without_pages,
        "earliest_touched": earliest_touched,
        "universe_rejections": universe_rejections,
        "universe_duplicates": universe_duplicates,
        "tickers_without_rows": tickers_without_rows,
        "ticker_aliases": ticker_aliases,
        "polling_hours": polling_hours,
        "report_periods": report_periods,
        "calendar": lambda s, d: cal.with_calendar(_ship_days(s, d)),
        "calendar_later": lambda s, d: cal.with_calendar(_later_days(s, d)),
        "session_bounds": lambda s, d: cal.with_sessions(_ship_days(s, d)),
        "vix_forward_fill": table(_volatility),
        # index
        "index_members": index_members,
        "index_members_extended": partial(index_members, regular=False),
        "member_state": table(member_state),
        "index_daily": on_index(lambda i: i),
        "index_geometric": table(lambda s, d: _index(s, d, geometric=True).drop("measurement", "ticker", "company")),
        "index_recompute": table(index_recompute),
        "price_change_months": table(lambda s, d: price_change_months(s, d).drop("measurement", "company")),
        "long_series": table(long_series),
        "wide_series": table(wide_series),
        "moving_average": table(moving_average),
        "kaufman_average": table(kaufman),
        "index_level": on_index(mi.index_level),
        "index_trend": on_index(mi.index_trend),
        "index_trend_weekly": on_index(mi.index_trend, n=60, weekly_base=True),
        "index_bands": on_index(mi.index_bands),
        "index_bands_linear": on_index(mi.index_bands, fn="median", log=False),
        "index_change": on_index(mi.index_change),
        "index_volume": on_index(mi.index_volume),
        "index_volume_by_month": on_index(mi.index_volume_by_month),
        "weekly_unit_volume": on_index(mi.weekly_unit_volume),
        "index_flow": on_index(mi.flow),
        "annualised_gain": on_index(mi.annualised_gain, BASE_DATE, RESULTS_FROM),
        "drawdown": table(lambda s, d: _levels(s, d).drop("measurement", "ticker")),
        "drawdown_provisional": table(drawdown_provisional),
        "drawdown_bands": table(lambda s, d: mi.drawdown_bands(_levels(s, d)).drop("ticker")),
        "polled_rows": table(polled_rows),
        "drawdown_labels": table(drawdown_labels),
        "member_drawdown": table(member_drawdown),
        "linear_regression": table(linear_regression),
        "trend_segments": table(trend_segments),
        "trend_analysis": table(trend_analysis),
        "largest_deviation": table(largest_deviation),
        # members
        "member_trends": on_members(mi.member_trends),
        "member_daily_change": on_members(mi.member_daily_change, emphasise=True),
        "member_volumes": on_members(mi.member_volumes),
        "member_flow": on_members(mi.flow, excluded=["NATION_1"]),
        "member_attribution": table(
            lambda s, d: mi.member_attribution(_index(s, d), _members(s, d)).drop("company")
        ),
        "member_attribution_flat": table(
            lambda s, d: mi.member_attribution(_index(s, d), _members(s, d), direction="flat").drop("company")
        ),
        # features
        "member_spread": table(member_spread),
        "features_next_day": partial(features, feat.NEXT_BANK_DAY),
        "features_forward_two_weeks": partial(features, feat.FORWARD_TWO_WEEKS),
        "features_forward_five_weeks": partial(features, feat.FORWARD_FIVE_WEEKS),
        "training_rows": training_rows,
        "feature_points": feature_points,
        "features_doubled_days": features_doubled_days,
        "predictions": table(predictions),
        "predictions_by_tree": table(predictions_by_tree),
        # financials
        "financial_quarters": table(partial(financial_periods, "Q")),
        "financial_years": table(partial(financial_periods, "A")),
        "new_report_periods": table(new_report_periods),
        "statement_lookup": table(statement_lookup),
        # dashboard parts
        "renamed_fields": table(renamed_fields),
        "bank_day_range": bank_day_range,
        "index_level_anchored": table(index_level_anchored),
        "epochs": epochs,
        # lookups and checks
        "series_scan": table(series_scan),
        "document_lookup": document_lookup,
        "training_export": table(training_export),
        "universe_table": universe_table,
        "sampled_companies": sampled_companies,
        "session_feed": table(session_feed),
        "statement_responses": statement_responses,
        "least_instants": least_instants,
        "checked_features": table(checked_features),
        "quotations_of_a_day": table(quotations_of_a_day),
        "quotations_of_the_last_hour": table(quotations_of_the_last_hour),
        "member_trends_included": on_members(mi.member_trends, included=["NATION_1", "NATION_2", "NATION_7"], excluded=["NATION_7"]),
        "member_attribution_bull": table(
            lambda s, d: mi.member_attribution(_index(s, d), _members(s, d), direction="bull").drop("company")
        ),
        "member_attribution_bear": table(
            lambda s, d: mi.member_attribution(_index(s, d), _members(s, d), direction="bear", included=["NATION_3", "NATION_4"]).drop("company")
        ),
        # stored tables
        "stored_upsert": table(stored.upserted),
        "stored_delete": table(stored.deleted),
        "stored_rename": table(stored.renamed),
        "stored_documents": stored.documents,
        "index_refresh": table(lambda s, d: stored.refreshed(s, d, _daily(s, d))),
        "index_redo": table(lambda s, d: stored.redone(s, d, _daily(s, d))),
        "member_versions": table(lambda s, d: stored.member_versions(s, d, _daily(s, d))),
        "stale_mark": stored.stale_mark,
        # streaming
        "stream_trade_windows": table(partial(jobs.trade_windows_from_file, EVERY)),
        "stream_quote_windows": table(partial(jobs.quote_windows_from_file, EVERY)),
        "stream_trade_deltas": table(partial(jobs.trade_deltas_from_file, EVERY)),
        "stream_quote_deltas": table(partial(jobs.quote_deltas_from_file, EVERY)),
        "stream_drawdown": table(lambda s, d: jobs.drawdown_from_table(s, _index(s, d)).drop("measurement", "ticker")),
        "stream_state_windows": table(partial(jobs.previous_windows, EVERY)),
        "stream_state_maxima": table(lambda s, d: jobs.running_maxima(s, _members(s, d))),
        "replayed_windows": table(partial(jobs.replayed_windows, EVERY)),
        "replayed_throughput": jobs.replayed_throughput,
        "live_assets": table(partial(jobs.live_assets, EVERY)),
        "late_trades": partial(jobs.late_trades, EVERY),
        "counted_batches": jobs.counted_batches,
        "logged_windows": table(lambda s, d: jobs.logged_windows(EVERY, s, _frames(s, d, F.col("ts").alias("at")))),
        "pushed_batches": pushed_batches,
        "stream_trends": table(lambda s, d: jobs.trends_from_table(s, _members(s, d))),
        "stream_trends_redone": table(lambda s, d: jobs.trends_redone(s, _members(s, d), F.col("ticker") < "NATION_2")),
    }
