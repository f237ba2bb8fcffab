import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tickwise.operators import bars as b
from tickwise.operators import index as ix
from tickwise.plans import pipeline
from tickwise.sources import store

DAILY = (
    "ticker string, company string, day date, opening_price double, closing_price double, high_price double, "
    "low_price double, volume_weighted_avg_price double, total_trading_value double"
)


def random_daily(seed=3, tickers=12, days=40):
    rng = random.Random(seed)
    rows = []
    for t in range(tickers):
        price, first = rng.uniform(5, 50), rng.choice([0, 0, 5, 11, 23])
        for d in range(first, days):
            if d > first and rng.random() < 0.15:
                continue
            price *= rng.uniform(0.95, 1.06)
            rows.append((f"T{t}", "C", date(2020, 1, 1) + timedelta(d), price * 0.99, price * 1.01, price * 1.02, price * 0.98, price, 100.0 * price))
    return rows


def day_by_day(rows):
    """Plain fold over the days: members join at the index level of the day before."""
    by_day = defaultdict(list)
    for row in rows:
        by_day[row[2]].append(row)
    members, level, changes, index = {}, 1.0, {}, {}
    for day in sorted(by_day):
        today = []
        for ticker, _, _, *_, vwap, value in by_day[day]:
            if ticker not in members:
                members[ticker] = [level, vwap, vwap]
            intro, price, previous = members[ticker]
            changes[ticker, day] = (vwap / price * intro, previous / price * intro)
            today.append(vwap / price * intro)
            members[ticker][2] = vwap
        level = sum(today) / len(today)
        index[day] = level
    return changes, index


def test_chain_equals_fold(spark):
    rows = random_daily()
    members = ix.index_members(spark.createDataFrame(rows, DAILY))
    changes, index = day_by_day(rows)
    got = {(r.ticker, r.day): (r.price_change_avg, r.prev_price_change_avg) for r in members.collect()}
    assert got.keys() == changes.keys()
    for key, pair in changes.items():
        assert got[key] == pytest.approx(pair, rel=1e-9)
    series = {r.day: r.price_change_avg for r in ix.index_series(members).collect()}
    assert series == pytest.approx(index, rel=1e-9)


@pytest.mark.parametrize("start", ["2020-01-06", "2020-01-12", "2020-01-30"])
def test_continued_run_equals_full_run(spark, start):
    daily = spark.createDataFrame(random_daily(), DAILY)
    full = ix.index_members(daily).cache()
    again = ix.recompute_from(daily, full, start)
    key = lambda r: (r.ticker, r.day)
    want = {key(r): r.asDict() for r in full.filter(f"day >= '{start}'").collect()}
    got = {key(r): r.asDict() for r in again.collect()}
    assert got.keys() == want.keys()
    for k in want:
        for c in [*ix.CHANGES, "introduction_price", "index_value_when_introduced"]:
            assert got[k][c] == pytest.approx(want[k][c], rel=1e-9)
        assert got[k]["introduction_day"] == want[k]["introduction_day"]


def test_geometric_mean(spark):
    rows = [("A", "C", date(2020, 1, 1), *[1.0] * 5, 10.0), ("B", "C", date(2020, 1, 1), *[1.0] * 5, 5.0),
            ("A", "C", date(2020, 1, 2), *[2.0] * 5, 10.0), ("B", "C", date(2020, 1, 2), *[8.0] * 5, 5.0)]
    members = ix.index_members(spark.createDataFrame(rows, DAILY))
    got = ix.index_series(members, geometric=True).orderBy("day").collect()[1]
    assert got.price_change_avg == pytest.approx(4.0)
    assert got.total_trading_value == 15.0


def test_start_date(spark):
    empty = spark.createDataFrame([], "stale_from date")
    index = spark.createDataFrame([(date(2020, 5, 1),)], "day date")
    assert ix.start_date(empty, index, "2016-01-02").first().start == date(2016, 1, 2)
    mark = spark.createDataFrame([(date(2020, 6, 1),)], "stale_from date")
    assert ix.start_date(mark, index, "2016-01-02").first().start == date(2020, 5, 1)


def test_daily_roll_up(spark):
    rows = spark.sql(
        """
        SELECT 'A' AS ticker, 'C' AS company, ts AS market_ts, o AS opening_price, c AS closing_price, h AS high_price,
               l AS low_price, v AS volume_weighted_avg_price, n AS volume, v * n AS total_trading_value
        FROM VALUES (TIMESTAMP '2025-01-15 15:00:00', 1D, 2D, 3D, 0.5D, 2D, 10),
                    (TIMESTAMP '2025-01-15 15:30:00', 2D, 4D, 5D, 1.5D, 4D, 30),
                    (TIMESTAMP '2025-01-15 22:00:00', 9D, 9D, 9D, 9D, 9D, 10),
                    (TIMESTAMP '2025-01-18 15:00:00', 9D, 9D, 9D, 9D, 9D, 10) AS t(ts, o, c, h, l, v, n)
        """
    )
    got = b.daily_bars(rows).collect()
    assert len(got) == 1
    day = got[0]
    assert (day.opening_price, day.closing_price, day.high_price, day.low_price) == (1, 4, 5, 0.5)
    assert (day.volume_weighted_avg_price, day.total_trading_value) == (3, 140)
    assert b.daily_bars(rows, weighted=True).first().volume_weighted_avg_price == pytest.approx(3.5)
    assert b.daily_bars(rows, regular_hours=False).first().closing_price == 9


def test_monthly_value_and_top(spark):
    rows = spark.sql(
        """
        SELECT * FROM VALUES ('A', TIMESTAMP '2025-01-30 15:00:00', 1.005D), ('A', TIMESTAMP '2025-01-31 04:59:59', 1D),
                             ('A', TIMESTAMP '2025-01-31 05:00:00', 100D), ('B', TIMESTAMP '2025-01-02 15:00:00', 2.005D)
        AS t(ticker, market_ts, total_trading_value)
        """
    )
    totals = {r.ticker: r.total_trading_value for r in b.monthly_traded_value(rows).collect()}
    assert totals == {"A": 2.01, "B": 2.01}
    whole = b.monthly_traded_value(rows, include_last_day=True)
    assert [r.ticker for r in b.top_by_value(whole, 1).collect()] == ["A"]
    assert [r.ticker for r in b.top_by_value(b.monthly_traded_value(rows), 1).collect()] == ["A"]


def test_refresh(spark, tmp_path):
    """First run, a later run with new days, a run after changed bars, and a full redo agree with one full run."""
    rows = random_daily(days=100)
    members, index = pipeline.members_table(str(tmp_path / "members")), pipeline.index_table(str(tmp_path / "index"))
    states = pipeline.states_table(str(tmp_path / "states"))
    mark = lambda *d: spark.createDataFrame([(x,) for x in d], "stale_from date")
    frame = lambda some: spark.createDataFrame(some, DAILY)

    def run(some, stale, full=False):
        start = pipeline.refresh_index(spark, frame(some), members, index, states, stale, "2020-01-01", full)
        got = {(r.ticker, r.day): r.price_change_avg for r in store.load(spark, members).collect()}
        changes, levels = day_by_day(some)
        assert got == pytest.approx({k: v[0] for k, v in changes.items()}, rel=1e-9)
        stored = {r.day: r.price_change_avg for r in store.load(spark, index).collect()}
        assert stored == pytest.approx(levels, rel=1e-9)
        versions = store.load(spark, states).collect()
        assert len({(r.ticker, r.as_of) for r in versions}) == len(versions)
        for as_of in {r.as_of for r in versions}:
            want = ix.member_state(store.load(spark, members), as_of.isoformat()).collect()
            mine = {r.ticker: tuple(r)[1:6] for r in versions if r.as_of == as_of}
            assert mine == {r.ticker: (r.introduction_day, r.introduction_price, r.index_value_when_introduced, r.prev_day, r.prev_avg_price) for r in want}
        assert max(r.as_of for r in versions) > max(r[2] for r in some)
        return start

    early = [r for r in rows if r[2] < date(2020, 3, 10)]
    assert run(early, mark()) is None
    assert run(rows, mark(date(2020, 3, 10))) == date(2020, 3, 1)
    changed = [(*r[:7], r[7] * 1.1, r[8]) if r[2] == date(2020, 3, 20) else r for r in rows]
    assert run(changed, mark(date(2020, 3, 20))) == date(2020, 3, 1)
    assert run(rows, mark(), full=True) is None
    assert run([r for r in rows if r[2] < date(2020, 3, 1)], mark(), full=True) is None


def test_a_refresh_reads_one_month_of_the_states(spark, tmp_path):
    members, index, states = (f(str(tmp_path / n)) for f, n in ((pipeline.members_table, "m"), (pipeline.index_table, "i"), (pipeline.states_table, "s")))
    daily = spark.createDataFrame(random_daily(days=70), DAILY)
    pipeline.refresh_index(spark, daily, members, index, states, spark.createDataFrame([], "stale_from date"), "2020-01-01")
    found = pipeline.state_as_of(spark, states, date(2020, 2, 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2020-02" in plan
    assert found.count() > 0 and found.select(F.max("prev_day")).first()[0] < date(2020, 2, 1)
