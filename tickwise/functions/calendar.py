"""Trading calendar as date expressions.

Holidays follow from the date alone, so no calendar table is joined: the
expressions run inside the scan's codegen stage whatever the data size.
The session time zone must be UTC.
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.scalar import _c

NEW_YORK = "America/New_York"
OPEN_SECONDS = 9 * 3600 + 30 * 60
CLOSE_SECONDS = 16 * 3600

# Fixed values: (month, day) of the yearly holidays.
FIXED_HOLIDAYS = [(1, 1), (6, 19), (7, 4), (11, 11), (12, 24), (12, 25)]

# Fixed values: (month, day of week with Sunday = 1, which one; 0 = last).
FLOATING_HOLIDAYS = [(1, 2, 3), (2, 2, 3), (5, 2, 0), (9, 2, 1), (10, 2, 2), (11, 5, 4)]

# Good Fridays.
GOOD_FRIDAYS = [
    "2016-03-25",
    "2017-04-14",
    "2018-03-30",
    "2019-04-19",
    "2020-04-10",
    "2021-04-02",
    "2022-04-15",
    "2023-04-07",
    "2024-03-29",
    "2025-04-18",
    "2026-04-03",
]


def is_weekend(day: Column | str) -> Column:
    return F.dayofweek(_c(day)).isin(1, 7)


def is_holiday(day: Column | str) -> Column:
    """Holidays of the stored series.

    The last Monday of May is tested as "within the last eight days of the
    month", so a 31-day May can hold two of them (24th and 31st).

    Month, day and weekday are folded into two keys and looked up in small sets: the
    generated code stays short enough for the JIT compiler.
    """
    day = _c(day)
    month, dom, dow = F.month(day), F.dayofmonth(day), F.dayofweek(day)
    month_day = month * 100 + dom
    nth_weekday = dow * 10000 + month * 100 + F.ceil(dom / 7).cast("int")
    found = month_day.isin([m * 100 + d for m, d in FIXED_HOLIDAYS])
    found = found | nth_weekday.isin([w * 10000 + m * 100 + n for m, w, n in FLOATING_HOLIDAYS if n])
    for m, weekday, n in FLOATING_HOLIDAYS:
        if not n:
            length = calendar.monthrange(2001, m)[1]
            found = found | ((dow == weekday) & month_day.between(m * 100 + length - 7, m * 100 + length))
    return found | day.isin([F.lit(d).cast("date") for d in GOOD_FRIDAYS])


def is_bank_day(day: Column | str) -> Column:
    return ~is_weekend(day) & ~is_holiday(day)


def _seek(day: Column, step: int, limit: int) -> Column:
    found = F.date_add(day, step * (limit + 1))
    for n in range(limit, 0, -1):
        candidate = F.date_add(day, step * n)
        found = F.when(is_bank_day(candidate), candidate).otherwise(found)
    return found


def previous_bank_day(day: Column | str, limit: int = 7) -> Column:
    """Nearest earlier bank day; after ``limit`` misses the next day down is taken as it is."""
    return _seek(_c(day), -1, limit)


def next_bank_day(day: Column | str, limit: int = 7) -> Column:
    return _seek(_c(day), 1, limit)


def new_york_instant(day: Column | str, seconds: int = 0) -> Column:
    """The UTC instant of a New York wall-clock time on ``day``."""
    wall = F.timestamp_seconds(F.unix_date(_c(day)).cast("long") * 86400 + seconds)
    return F.to_utc_timestamp(wall, NEW_YORK)


def session_open(day: Column | str) -> Column:
    return F.when(is_bank_day(day), new_york_instant(day, OPEN_SECONDS))


def session_close(day: Column | str) -> Column:
    """Last instant of the session: one millisecond before the bell."""
    bell = new_york_instant(day, CLOSE_SECONDS)
    return F.when(is_bank_day(day), bell - F.expr("INTERVAL 1 MILLISECOND"))


def day_open(day: Column | str) -> Column:
    """First instant of the New York calendar day."""
    return new_york_instant(day)


def day_close(day: Column | str) -> Column:
    """24 hours after the first instant, less one millisecond."""
    return new_york_instant(day) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MILLISECOND")


def trading_day(ts: Column | str) -> Column:
    """New York calendar date of an instant."""
    return F.to_date(F.from_utc_timestamp(_c(ts), NEW_YORK))


def is_session_time(ts: Column | str) -> Column:
    """Does the instant lie between the bells of its New York day, a bank day or not.

    The zone conversion is the costly part, so it occurs once: whole session lengths
    since the opening bell are zero exactly while the exchange is open.
    """
    local = F.from_utc_timestamp(_c(ts), NEW_YORK)
    since_open = F.pmod(F.unix_seconds(local), F.lit(86400)) - OPEN_SECONDS
    return F.floor(since_open / (CLOSE_SECONDS - OPEN_SECONDS)) == 0


def is_regular_hours(ts: Column | str) -> Column:
    """Is the exchange open at the instant; during those hours the New York date is the UTC date."""
    return is_session_time(ts) & is_bank_day(F.to_date(_c(ts)))


def feed_start(session_date: str) -> Column:
    """One hour before the opening bell: where a live run starts to replay."""
    return new_york_instant(F.lit(session_date).cast("date"), OPEN_SECONDS - 3600)


def with_calendar(df: DataFrame, day: str = "day") -> DataFrame:
    """Add all calendar columns to a frame that has a date column."""
    return df.select(
        "*",
        is_weekend(day).alias("is_weekend"),
        is_holiday(day).alias("is_holiday"),
        is_bank_day(day).alias("is_bank_day"),
        previous_bank_day(day).alias("previous_bank_day"),
        next_bank_day(day).alias("next_bank_day"),
    )


def with_sessions(df: DataFrame, day: str = "day") -> DataFrame:
    return df.select(
        "*",
        session_open(day).alias("open_utc"),
        session_close(day).alias("close_utc"),
        day_open(day).alias("day_open_utc"),
        day_close(day).alias("day_close_utc"),
    )


def bank_days(df: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """One row per bank day in ``[start, end]``; ``df`` only lends its session."""
    span = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    days = df.sparkSession.range(1).select(F.explode(span).alias(day))
    return days.filter(is_bank_day(day))


def earliest(*instants: Column | str) -> Column:
    """Least of optional instants, NULL ones left out."""
    return F.least(*[_c(i) for i in instants])
