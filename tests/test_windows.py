import random
import statistics
from datetime import datetime, timedelta

import pytest

from tickwise.operators import windows as w

T0 = datetime(2025, 1, 15, 15, 0)
TRADE = "symbol string, trade_id long, market_ts timestamp, price double, lot_size double"
QUOTE = "symbol string, market_ts timestamp, ask_price double, ask_lot double, bid_price double, bid_lot double"


def test_trade_window(spark):
    rows = [("AAPL", 1, T0, 100.0, 15.0), ("AAPL", 2, T0 + timedelta(seconds=1), 90.0, 10.0)]
    got = w.trade_windows(spark.createDataFrame(rows, TRADE)).first()
    assert got.record_count == 2
    assert (got.price_at_window_start, got.price_at_window_end, got.min_price, got.max_price) == (100, 90, 90, 100)
    assert (got.sum_quantity, got.sum_notional, got.volume_weighted_avg_price) == (25, 2400, 96)
    assert (got.window_start_time, got.window_end_time) == (T0, T0 + timedelta(minutes=5))


def test_trade_window_ties_and_zero_quantity(spark):
    rows = [("A", 2, T0, 2.0, 0.0), ("A", 1, T0, 1.0, 0.0), ("A", 3, T0, 3.0, 0.0)]
    got = w.trade_windows(spark.createDataFrame(rows, TRADE)).first()
    assert (got.price_at_window_start, got.price_at_window_end, got.volume_weighted_avg_price) == (1, 3, 0)
    plain = w.trade_windows(spark.createDataFrame(rows[:1], TRADE), tie_break=None).first()
    assert plain.price_at_window_start == 2


def test_quote_window(spark):
    rows = [("AAPL", T0, 100.0, 15.0, 90.0, 10.0), ("AAPL", T0 + timedelta(seconds=1), 99.0, 15.0, 95.0, 10.0)]
    got = w.quote_windows(spark.createDataFrame(rows, QUOTE), closing=True).first()
    assert got.record_count == 2
    assert (got.min_ask_price, got.max_ask_price, got.min_bid_price, got.max_bid_price) == (99, 100, 90, 95)
    assert (got.sum_ask_quantity, got.sum_bid_quantity) == (30, 20)
    assert (got.sum_ask_notional, got.sum_bid_notional) == (2985, 1850)
    assert (got.volume_weighted_avg_ask_price, got.volume_weighted_avg_bid_price) == (99.5, 92.5)
    assert (got.bid_ask_spread, got.spread_midpoint) == (7, 96)
    assert got.order_imbalance == pytest.approx(-0.2)
    assert (got.ask_price_at_window_end, got.bid_price_at_window_end) == (99, 95)


def brute_force(prices):
    median = statistics.median(prices)
    deviation = statistics.median([abs(p - median) for p in prices]) * 1.4826
    kept = [p for p in prices if abs(p - median) <= 4 * deviation]
    return min(kept), max(kept)


def test_outliers_against_brute_force(spark):
    """One symbol holds most rows; prices repeat, and some windows are constant."""
    rng = random.Random(7)
    rows, expected = [], {}
    for i in range(60):
        symbol = "HOT" if i % 3 else f"S{i}"
        start = T0 + timedelta(minutes=5 * i)
        center = rng.uniform(50, 60)
        prices = [round(center + rng.gauss(0, 0.05), 2) for _ in range(rng.randint(1, 40))] if i % 7 else [50.0] * 5
        prices += [round(center * 2, 2)] * (i % 2)
        for p in prices:
            rows.append((symbol, start + timedelta(seconds=rng.random() * 299), p, 1.0, p - 0.01, 1.0))
        expected[symbol, start] = brute_force(prices)
    got = w.quote_windows(spark.createDataFrame(rows, QUOTE)).collect()
    assert {(r.ticker, r.window_start_time): (r.min_ask_price, r.max_ask_price) for r in got} == expected


def test_deltas(spark):
    columns = ["ticker string", "window_end_time timestamp", *[f"{m} double" for m in w.TRADE_METRICS]]
    end = T0 + timedelta(minutes=5)
    rows = [
        ("A", T0, *range(6)),
        ("A", end, *[float(10 + 2 * i) for i in range(6)]),
        ("B", end, *range(6)),
    ]
    rows = [(t, ts, *map(float, rest)) for t, ts, *rest in rows]
    windows = spark.createDataFrame(rows + rows[1:2], ", ".join(columns))
    got = w.trade_deltas(windows, dedupe=True).collect()
    assert len(got) == 1 and got[0].timestamp == end
    assert [got[0][f"{m}_delta"] for m in w.TRADE_METRICS] == [10.0 + i for i in range(6)]


def test_ids_repeat(spark):
    rows = spark.createDataFrame([("A", 1, T0, 1.0, 1.0)], TRADE)
    first, second = (w.trade_windows(rows).first().measure_id for _ in range(2))
    assert first == second and len(first) == 64


def test_sliding(spark):
    rows = spark.createDataFrame([("A", 1, T0, 1.0, 1.0)], TRADE)
    assert w.trade_windows(rows, slide="150 seconds").count() == 2
