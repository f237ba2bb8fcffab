import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tickwise.operators import drawdown as dd
from tickwise.operators import trends as tr

T0 = datetime(2020, 1, 1)
CHANGES = "measurement string, ticker string, ts timestamp, price_change_low double, price_change_avg double, price_change_high double"


def walk(n, seed=1, start=1.0):
    rng, x, out = random.Random(seed), start, []
    for _ in range(n):
        x *= rng.uniform(0.96, 1.045)
        out.append(x)
    return out


def changes(spark, values, ticker="T"):
    rows = [("m", ticker, T0 + timedelta(i), v * 0.9, v, v * 1.1) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, CHANGES)


def test_running_maximum(spark):
    values = [-1.0, 0.0, *walk(50)]
    got = dd.drawdown(changes(spark, values)).orderBy("ts").collect()
    top = 0.0
    for row, value in zip(got, values):
        top = max(top, value)
        assert row.drawdown_avg == (None if top == 0 else pytest.approx(value / top * 100))


def test_today_is_provisional(spark):
    got = dd.drawdown(changes(spark, [1.0, 2.0, 4.0, 3.0]), as_of="2020-01-03").orderBy("ts").collect()
    assert [r.drawdown_avg for r in got] == pytest.approx([100, 100, 100, 100])
    got = dd.drawdown(changes(spark, [1.0, 2.0, 4.0, 3.0])).orderBy("ts").collect()
    assert [r.drawdown_avg for r in got] == pytest.approx([100, 100, 100, 75])


@pytest.mark.parametrize("forward", [0, 1, 10, 200])
def test_labels_against_plain_loops(spark, forward):
    levels = [100 - 20 * abs(np.sin(i / 3)) for i in range(60)]
    rows = [("m", "T", T0 + timedelta(i), float(v)) for i, v in enumerate(levels)]
    df = spark.createDataFrame(rows, "measurement string, ticker string, ts timestamp, drawdown_low double")
    got = dd.drawdown_labels(df, forward).orderBy("ts").collect()
    since = dict.fromkeys(dd.DIP_LEVELS, 0)
    for i, row in enumerate(got):
        for size, limit in dd.DIP_LEVELS.items():
            since[size] = 0 if levels[i] <= limit else since[size] + 1
            assert row[f"days_since_dip_of_{size}"] == since[size]
        assert row.drawdown_next_bank_day == pytest.approx(levels[i + 1] if i + 1 < len(levels) else 0.0)
        ahead = levels[i + 1 : i + 1 + forward]
        assert row.forward_max_drawdown == pytest.approx(min(ahead) if ahead else levels[i])


def plain_segments(rows, m=7, limit=0.8, tolerance=0.05):
    """The segmentation rules on plain lists of (time, value)."""

    def fit(part):
        y = np.array([(v / part[0][1] - 1) * 100 for _, v in part])
        x = np.arange(len(y))
        slope, intercept = np.polyfit(x, y, 1)
        return slope, intercept, float(np.mean((y - slope * x - intercept) ** 2))

    if len(rows) < 2 * m:
        return [], rows
    window, rest, out = rows[: 2 * m], rows[2 * m :], []
    while len(rest) >= 2 * m:
        window, rest = window + rest[:1], rest[1:]
        tail = window[-m:]
        if len(window) >= 2 * m and abs(fit(window)[0] - fit(tail)[0]) > limit:
            near = [i for i in range(m) if abs(tail[i][1] - window[i][1]) <= tolerance]
            k = near[-1] if near else 0
            slope, intercept, variance = fit(window)
            days = (tail[k][0] - window[0][0]).days
            out.append((window[0][0], tail[k][0], slope * days, slope, intercept, variance))
            window, rest = (tail + rest[:k])[k:], rest[k:]
    return out, window + rest


@pytest.mark.parametrize("n", [10, 27, 28, 60, 400])
def test_segments_against_plain_rules(spark, n):
    series = {f"T{s}": walk(n, seed=s) for s in range(4)}
    df = None
    for ticker, values in series.items():
        part = changes(spark, values, ticker)
        df = part if df is None else df.unionAll(part)
    got = tr.trend_segments(df.unionAll(df.limit(3))).collect()
    tails = tr.undecided_tail(df).groupBy("ticker").count().collect()
    for ticker, values in series.items():
        rows = [(T0 + timedelta(i), v) for i, v in enumerate(values)]
        want, rest = plain_segments(rows)
        mine = sorted((r for r in got if r.ticker == ticker), key=lambda r: r.begins)
        assert [(r.begins, r.ends) for r in mine] == [(s[0], s[1]) for s in want]
        for r, s in zip(mine, want):
            assert [r.growth, r.regression_slope, r.regression_intercept, r.regression_variance] == pytest.approx(list(s[2:]), rel=1e-6, abs=1e-6)
        assert {t.ticker: t["count"] for t in tails}[ticker] == len(rest)


def test_regression_aggregate(spark):
    values = walk(30)
    got = tr.linear_regression(changes(spark, values), "price_change_avg", ["ticker"]).first()
    assert [got.slope, got.intercept, got.variance] == pytest.approx(list(tr.regression(np.array(values))), rel=1e-9)


def test_largest_deviation(spark):
    tail = spark.createDataFrame([("T", i, v) for i, v in enumerate([1.0, 5.0, 9.0])], "k string, position int, v double")
    overall = spark.createDataFrame([("T", i, 1.0) for i in range(6)], "k string, position int, v double")
    plain = tr.largest_deviation(tail, overall, "v", ["k"], alpha=0.0).first()
    assert (plain.position, plain.residual) == (2, 8.0)
    centred = tr.largest_deviation(tail, overall, "v", ["k"], alpha=1.0).first()
    assert centred.position == 1
