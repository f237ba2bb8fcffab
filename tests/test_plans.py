"""The shape of the physical plans: shuffles, scans and joins."""

import re

import pytest
from pyspark.sql import functions as F

from tickwise.operators import bars, series, windows
from tickwise.plans import microstructure, registry
from tickwise.sources import tables

FOLDER = "/root/testdata/sf0.001"
PLAIN = [
    "trade_windows", "quote_windows", "quote_deltas", "microstructure_metrics", "microstructure_lagged", "institutional_pressure",
    "subscriber_batches", "latest_per_id", "chart_points", "decoded_trades", "daily_bars", "monthly_volumes", "stale_tickers",
    "scan_starts", "universe_duplicates", "tickers_without_rows", "ticker_aliases", "vix_forward_fill", "financial_quarters",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange (hash|range|single|round)", plan(df), re.IGNORECASE))


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_joins_and_no_row_functions(spark, name):
    text = plan(registry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_trade_windows_shuffle_once_after_partial_aggregation(spark):
    df = windows.trade_windows(tables.trades(spark, FOLDER))
    assert shuffles(df) == 1 and "partial_sum" in plan(df)
    assert "user_id" not in plan(df)


def test_distinct_times_keep_the_hash_aggregate(spark):
    df = windows.trade_windows(tables.trades(spark, FOLDER), tie_break=None)
    assert "HashAggregate" in plan(df) and "SortAggregate" not in plan(df)


def test_quote_windows_shuffle_levels_once_more(spark):
    assert shuffles(windows.quote_windows(tables.quotes(spark, FOLDER))) == 2


def test_merged_windows_are_distributed_once(spark):
    q, t = windows.quote_windows(tables.quotes(spark, FOLDER)), windows.trade_windows(tables.trades(spark, FOLDER))
    assert shuffles(microstructure.microstructure_metrics(q, t)) == shuffles(q) + shuffles(t) + 1


def test_fixed_lag_needs_no_join(spark):
    df = tables.trades(spark, FOLDER).select("symbol", "market_ts", series.fixed_lag("price", 60, ["symbol"], "market_ts").alias("p"))
    assert "Join" not in plan(df) and shuffles(df) == 1


def test_daily_bars_filter_before_the_shuffle(spark):
    text = plan(bars.daily_bars(tables.bars(spark, FOLDER)))
    assert text.index("Exchange hashpartitioning(ticker") < text.index("Filter")
    assert "l_tax" not in text and "l_returnflag" not in text


def test_newest_rows_combine_before_the_shuffle(spark):
    """The newest order is found by hash on the raw rows; only rows that have it are sorted."""
    text = plan(series.newest_rows(tables.trades(spark, FOLDER), ["symbol"], ["market_ts", "trade_id"]))
    assert "partial_max(_order" in text and "HashAggregate" in text
    below = text[text.index("Join") :]
    assert "SortAggregate" not in below


def test_raw_trades_are_aggregated_by_hash(spark):
    assert "SortAggregate" not in plan(registry.queries()["trade_windows"](spark, FOLDER))


def test_features_read_the_bars_once(spark):
    both = bars.daily_bars_both(tables.bars(spark, FOLDER), registry.SEQUENCE)
    assert plan(both).count("lineitem.parquet") == 1
    want = {name: bars.daily_bars(tables.bars(spark, FOLDER), name == "regular", registry.SEQUENCE) for name in ("regular", "extended")}
    for name, rows in want.items():
        got = both.filter(f"{name} IS NOT NULL").select(f"{name}.*")
        assert sorted(map(str, (r.asDict() for r in got.select(*rows.columns).collect()))) == sorted(map(str, (r.asDict() for r in rows.collect())))


def test_both_flavours_sort_only_the_bars_of_a_days_ends(spark):
    """All bars are aggregated by hash; those sorted for first and last prices have met the days' first and last times."""
    rows = tables.bars(spark, FOLDER)
    both = plan(bars.daily_bars_both(rows, registry.SEQUENCE))
    sorted_bars = both[both.rindex("SortAggregate") :]
    assert "_at#" in sorted_bars[: sorted_bars.index("lineitem.parquet")]
    groups = plan(bars._day_groups(rows))
    assert "SortAggregate" not in groups and "HashAggregate" in groups


def test_both_flavours_of_odd_bars(spark):
    """Ties go by the whole order, nulls first; repeated bars, missing names and prices, days without regular hours."""
    made = [
        ("A", "X", "2025-01-15 15:00:00", (2, 1), 1.0, 2.0), ("A", "X", "2025-01-15 15:00:00", (1, 9), 3.0, 4.0), ("A", "W", "2025-01-15 15:00:00", (None, 5), 5.0, None),
        ("A", "X", "2025-01-15 20:30:00", (7, 1), 6.0, 7.0), ("A", "X", "2025-01-15 20:30:00", (7, 1), 6.0, 7.0), ("A", "V", "2025-01-15 23:00:00", (1, 1), 8.0, 9.0),
        ("A", "X", "2025-01-16 02:00:00", (1, 1), 10.0, 11.0), (None, None, "2025-01-16 02:00:00", (1, 1), 12.0, None), (None, None, "2025-01-16 15:00:00", (4, 4), 13.0, 14.0),
        ("A", "X", "2025-01-18 15:00:00", (1, 1), 15.0, 16.0), ("A", "X", "2025-01-20 15:00:00", (1, 1), 17.0, 18.0), ("B", "Y", None, (1, 1), 19.0, 20.0), ("B", "Y", "2025-01-21 03:00:00", (1, 1), 21.0, 22.0),
        ("B", "Y", "2025-01-22 03:00:00", (3, 1), None, 23.0), ("B", "Y", "2025-01-22 13:00:00", (1, None), 24.0, None),
    ]
    rows = [(t, c, at, o, p, q, p, q, q, 1.0, q) for t, c, at, o, p, q in made]
    kinds = "ticker string, company string, at string, sequence struct<a: bigint, b: int>, " + ", ".join(f"{c} double" for c in [*bars.PRICES, "volume", "total_trading_value"])
    df = spark.createDataFrame(rows, kinds).withColumn("market_ts", F.col("at").cast("timestamp")).repartition(3)
    both = bars.daily_bars_both(df, registry.SEQUENCE)
    for name, count in (("regular", 2), ("extended", 5)):
        want = bars.daily_bars(df, name == "regular", registry.SEQUENCE)
        got = both.filter(f"{name} IS NOT NULL").select(f"{name}.*").select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == count
    first = both.filter("regular.ticker = 'A'").select("regular.*").first()
    assert (first.company, first.opening_price, first.closing_price) == ("W", 5.0, 7.0)
