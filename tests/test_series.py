from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwise.functions.chart import chart_points, magnitude
from tickwise.operators import series as s

T0 = datetime(2021, 1, 1)


def frame(spark, values, step=timedelta(days=1), key="k"):
    return spark.createDataFrame([(key, T0 + i * step, v) for i, v in enumerate(values)], "k string, ts timestamp, v double")


def test_resample_labels_and_functions(spark):
    df = frame(spark, [1.0, 2.0, 6.0, 4.0], timedelta(hours=12))
    columns = [("v", fn, fn) for fn in s.AGGREGATES]
    rows = s.resample(df, "1 day", columns, ["k"]).orderBy("ts").collect()
    assert [r.ts for r in rows] == [datetime(2021, 1, 2), datetime(2021, 1, 3)]
    assert rows[1].asDict() == {
        "k": "k", "ts": datetime(2021, 1, 3), "first": 6.0, "last": 4.0, "max": 6.0, "mean": 5.0, "median": 5.0, "min": 4.0, "sum": 10.0,
    }
    with pytest.raises(ValueError):
        s.aggregate("mode", "v", "ts")


def test_weeks_start_on_thursday_and_months(spark):
    df = spark.createDataFrame([("k", datetime(2024, 1, 3), 1.0), ("k", datetime(2024, 1, 4), 2.0)], "k string, ts timestamp, v double")
    weeks = sorted(r.ts for r in s.resample(df, "7 days", [("v", "mean", "v")], ["k"]).collect())
    assert weeks == [datetime(2024, 1, 4), datetime(2024, 1, 11)]
    assert s.resample(df, "4 months", [("v", "sum", "v")], ["k"]).first().ts == datetime(2024, 5, 1)


def test_empty_buckets(spark):
    df = frame(spark, [1.0, 2.0], timedelta(days=3))
    rows = s.resample(df, "1 day", [("v", "mean", "v")], ["k"], create_empty=True).orderBy("ts").collect()
    assert [r.v for r in rows] == [1.0, None, None, 2.0]


def test_kaufman_documented_example(spark):
    """Published example of the function with three values."""
    df = frame(spark, [-2.0, 10.0, 7.0, 17.0, 15.0, 4.0], timedelta(seconds=10))
    got = [r.kaufman_average for r in s.kaufman_average(df, "v", 3, ["k"]).orderBy("ts").collect()]
    assert got == pytest.approx([9.72641183951902, 10.097401019601417, 9.972614968115325])
    assert np.isnan(s.kaufman(np.array([1.0, 2.0]), 3)).all()
    assert s.kaufman(np.ones(6), 2)[2:] == pytest.approx(1.0)


def test_moving_average_and_difference(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 10.0])
    assert [r.moving_average for r in s.moving_average(df, "v", 3, ["k"]).orderBy("ts").collect()] == [2.0, 5.0]
    assert [r.v for r in s.difference(df, ["v"], ["k"]).orderBy("ts").collect()] == [1.0, 1.0, 7.0]
    assert [r.c for r in df.select(s.cumulative_sum("v", ["k"]).alias("c")).orderBy("c").collect()] == [1.0, 3.0, 6.0, 16.0]


def test_fixed_lag_is_exact(spark):
    times = [0, 60, 180, 240, 360]
    df = spark.createDataFrame([("k", T0 + timedelta(seconds=t), float(t)) for t in times], "k string, ts timestamp, v double")
    rows = df.select("v", s.fixed_lag("v", 180, ["k"]).alias("p")).orderBy("v").collect()
    assert [r.p for r in rows] == [None, None, 0.0, 60.0, 180.0]


def test_forward_fill(spark):
    values = [None, 1.0, None, None, 2.0]
    df = spark.createDataFrame([("k", date(2021, 1, 1 + i), v) for i, v in enumerate(values)], "k string, day date, v double")
    rows = s.forward_fill(df, "v", ["k"]).orderBy("day").collect()
    assert [(r.v, r.carry_forward_from) for r in rows] == [
        (1.0, None), (1.0, date(2021, 1, 2)), (1.0, date(2021, 1, 2)), (2.0, None),
    ]


def test_reshape_round_trip(spark):
    wide = spark.createDataFrame([(T0, 1.0, 2.0), (T0 + timedelta(1), None, 3.0)], "ts timestamp, a double, b double")
    long = s.to_long(wide, ["ts"], ["a", "b"])
    assert long.count() == 3
    assert s.matching_fields(long, "^(a)$").count() == 1
    assert sorted(map(tuple, s.to_wide(long, ["ts"], ["a", "b"]).collect()), key=str) == sorted(map(tuple, wide.collect()), key=str)


def test_latest_per_id(spark):
    rows = [("x", 1, "a"), ("x", 3, "c"), ("y", 2, "b"), ("x", 2, "z")]
    df = spark.createDataFrame(rows, "id string, at int, v string")
    assert [tuple(r) for r in s.latest_per_id(df, "id", ["at"]).collect()] == [("x", 3, "c"), ("y", 2, "b")]


def test_time_shift_and_first(spark):
    df = frame(spark, [None, 5.0, 7.0])
    rows = df.select(s.time_shift("ts", 42, 0.15).alias("t"), s.first_value("v", ["k"]).alias("f")).orderBy("t").collect()
    assert rows[0].t == T0 - timedelta(days=6)
    assert [r.f for r in rows] == [None, 5.0, 5.0]


def test_chart_points(spark):
    df = spark.createDataFrame([("k", T0, 1.0, 10.0), ("k", T0 + timedelta(hours=23, minutes=59, seconds=59), 1.0, 20.0), ("k", T0, 0.0, 5.0)], "k string, ts timestamp, p double, v double")
    rows = chart_points(df, "v", "p", "ts", ["k"], width=100, height=50).orderBy("x").collect()
    assert [round(r.x, 6) for r in rows] == [0, 100]
    assert rows[1].y == pytest.approx((20 - 20.4) * 50 / (9.8 - 20.4))
    unit = spark.range(1).select(magnitude(F.lit(2e6)).alias("m")).first().m
    assert (unit.unit, unit.postfix) == (1e6, " m")
