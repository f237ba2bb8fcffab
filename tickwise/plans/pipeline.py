"""The maintained index: recompute stored member and index series from where they are stale."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.operators.index import STATE, index_members, index_series, recompute_with_state, start_date, state_versions
from tickwise.session import fresh_path
from tickwise.sources import store


def members_table(path: str) -> store.Table:
    """Member rows by month: files stay large, and a recompute rewrites whole months."""
    return store.Table(path, keys=["measurement", "ticker", "day"], partitions=["month"])


def index_table(path: str) -> store.Table:
    return store.Table(path, keys=["measurement", "day"], partitions=["month"])


def states_table(path: str) -> store.Table:
    """The members' state as of the first of each month: a refresh reads one month's version."""
    return store.Table(path, keys=["ticker", "as_of"], partitions=["month"])


def state_as_of(spark: SparkSession, states: store.Table, month: date) -> DataFrame:
    """The stored state as of the first day of a month; other months' folders aren't read."""
    found = store.load(spark, states).filter(F.col("month") == month.strftime("%Y-%m"))
    return found.select(*[f.split()[0] for f in STATE.split(", ")])


def _with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("day", "yyyy-MM"))


def refresh_index(
    spark: SparkSession,
    daily: DataFrame,
    members: store.Table,
    index: store.Table,
    states: store.Table,
    stale_from: DataFrame,
    earliest: str,
    full: bool = False,
    regular_hours: bool = True,
) -> date | None:
    """Bring the stored series up to date with the daily bars.

    Months from the start on that have no rows any more are removed. The recompute starts at the earlier of the stale mark and the last stored index
    day, taken back to the start of its month; earlier months are left alone, and of the members only their state
    as of that month is read. A first or ``full`` run covers everything.  Returns the start, ``None`` for a full run; the
    caller then drops the stale mark.
    """
    start = None
    earlier = None
    if not full and all(store.exists(spark, t) for t in (members, index, states)):
        begin = start_date(stale_from, store.load(spark, index), earliest)
        start = begin.select(F.trunc("start", "month").alias("start")).first()["start"]
    if start is None:
        rows = index_members(daily, regular_hours=regular_hours)
    else:
        earlier = state_as_of(spark, states, start)
        rows = recompute_with_state(daily, earlier, start.isoformat(), regular_hours)
    again = store.exists(spark, members)
    rows = store.staged(_with_month(rows), fresh_path(spark, "members"))
    from_month = F.col("month") >= (start.strftime("%Y-%m") if start is not None else "")
    store.replace_partitions(rows, members)
    store.replace_partitions(_with_month(index_series(rows.drop("month"), regular_hours)), index)
    _store_states(spark, rows, earlier, states, start)
    if again:
        store.drop_missing(spark, members, rows.select("month"), from_month)
        store.drop_missing(spark, index, rows.select("month"), from_month)
    return start


def _store_states(spark: SparkSession, rows: DataFrame, earlier: DataFrame | None, states: store.Table, start: date | None) -> None:
    """The versions after ``start``; those up to it stay, and those of a full run take the place of all."""
    last = rows.agg(F.add_months(F.trunc(F.max("day"), "month"), 1)).first()[0]
    again = store.exists(spark, states)
    if last is None:
        return
    versions = state_versions(rows, earlier, last.isoformat())
    if start is not None:
        versions = versions.filter(F.col("as_of") > F.lit(start))
    versions = store.staged(versions.withColumn("month", F.date_format("as_of", "yyyy-MM")), fresh_path(spark, "states"))
    store.replace_partitions(versions, states)
    if again:
        after = F.col("month") > (start.strftime("%Y-%m") if start is not None else "")
        store.drop_missing(spark, states, versions.select("month"), after)
