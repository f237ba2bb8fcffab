from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tickwise.functions import calendar as cal


def days(spark, *values):
    return spark.createDataFrame([(date.fromisoformat(v),) for v in values], "day date")


@pytest.mark.parametrize(
    "day, holiday",
    [
        ("2026-01-01", True),
        ("2024-06-19", True),
        ("2025-07-04", True),
        ("2024-11-11", True),
        ("2024-12-24", True),
        ("2024-12-25", True),
        ("2024-12-26", False),
        ("2025-01-20", True),
        ("2025-02-17", True),
        ("2025-05-26", True),
        ("2025-09-01", True),
        ("2025-10-13", True),
        ("2025-11-27", True),
        ("2024-03-29", True),
        ("2024-04-01", False),
        ("2021-05-24", True),
        ("2021-05-31", True),
        ("2021-05-17", False),
    ],
)
def test_holidays(spark, day, holiday):
    assert days(spark, day).select(cal.is_holiday("day").alias("h")).first().h is holiday


def test_sessions(spark):
    rows = cal.with_sessions(days(spark, "2026-01-02", "2026-01-01", "2026-01-03", "2026-07-06")).collect()
    open_day, new_year, saturday, summer = rows
    assert open_day.open_utc == datetime(2026, 1, 2, 14, 30)
    assert open_day.close_utc == datetime(2026, 1, 2, 20, 59, 59, 999000)
    assert new_year.open_utc is None and saturday.close_utc is None
    assert new_year.day_open_utc == datetime(2026, 1, 1, 5)
    assert new_year.day_close_utc == datetime(2026, 1, 2, 4, 59, 59, 999000)
    assert summer.open_utc == datetime(2026, 7, 6, 13, 30)


@pytest.mark.parametrize(
    "instant, is_open",
    [
        ("2025-01-15 14:29:59.999", False),
        ("2025-01-15 14:30:00", True),
        ("2025-01-15 20:59:59.999", True),
        ("2025-01-15 21:00:00", False),
        ("2025-07-15 13:30:00", True),
        ("2025-07-15 20:00:00", False),
        ("2025-01-18 16:00:00", False),
        ("2025-12-25 16:00:00", False),
    ],
)
def test_regular_hours(spark, instant, is_open):
    row = spark.sql(f"SELECT TIMESTAMP '{instant}' AS ts").select(cal.is_regular_hours("ts").alias("o")).first()
    assert row.o is is_open


def test_bank_day_search(spark):
    rows = cal.with_calendar(days(spark, "2025-12-26", "2025-12-23", "2025-01-18")).collect()
    assert rows[0].previous_bank_day == date(2025, 12, 23)
    assert rows[1].next_bank_day == date(2025, 12, 26)
    assert (rows[2].previous_bank_day, rows[2].next_bank_day) == (date(2025, 1, 17), date(2025, 1, 21))


def test_ranges_and_bounds(spark):
    found = [r.day for r in cal.bank_days(spark.range(1), "2025-12-22", "2026-01-02").orderBy("day").collect()]
    assert found == [date(2025, 12, d) for d in (22, 23, 26, 29, 30, 31)] + [date(2026, 1, 2)]
    row = spark.range(1).select(
        cal.feed_start("2025-01-15").alias("start"),
        cal.earliest(F.lit(None).cast("timestamp"), F.lit("2025-01-01").cast("timestamp")).alias("least"),
    ).first()
    assert row.start == datetime(2025, 1, 15, 13, 30)
    assert row.least == datetime(2025, 1, 1)
