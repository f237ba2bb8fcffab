"""Equal-weight index whose members join over time.

A member enters at the index level of the day before, so its price is scaled by
``level / introduction price``.  Members that start on the same day form a cohort
and share that level.  With ``S_k(d)`` the sum of cohort ``k``'s price relatives on
day ``d`` and ``n(d)`` the members present, the index is ``sum_k level_k * S_k(d) / n(d)``.
Levels therefore follow from the sums on the days before new cohorts, and the heavy
work is one aggregation; nothing walks the data day by day.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

INDEX_TICKER = "INDEX"
CHANGES = ["price_change_open", "price_change_close", "price_change_high", "price_change_low", "price_change_avg", "prev_price_change_avg"]


def measurements(regular_hours: bool) -> tuple[str, str]:
    """Names of the member series and of the index series."""
    hours = "regular-hours" if regular_hours else "extended-hours"
    return f"securities-daily-change-{hours}", f"index-daily-change-{hours}"


def _introduced(daily: DataFrame, state: DataFrame | None) -> DataFrame:
    """Daily bars with the member's introduction and its previous average price."""
    by = Window.partitionBy("ticker").orderBy("day")
    first_day, first_price = F.first("day").over(by), F.first("volume_weighted_avg_price").over(by)
    previous = F.lag("volume_weighted_avg_price").over(by)
    if state is None:
        return daily.select(
            "*",
            first_day.alias("introduction_day"),
            first_price.alias("introduction_price"),
            F.lit(None).cast("double").alias("known_level"),
            F.coalesce(previous, "volume_weighted_avg_price").alias("prev_avg_price"),
        )
    known = state.select(
        "ticker",
        F.col("introduction_day").alias("_day"),
        F.col("introduction_price").alias("_price"),
        F.col("index_value_when_introduced").alias("known_level"),
        F.col("prev_avg_price").alias("_prev"),
    )
    return daily.join(known, "ticker", "left").select(
        *daily.columns,
        F.coalesce("_day", first_day).alias("introduction_day"),
        F.coalesce("_price", first_price).alias("introduction_price"),
        "known_level",
        F.coalesce(previous, "_prev", "volume_weighted_avg_price").alias("prev_avg_price"),
    )


def cohort_sums(introduced: DataFrame) -> DataFrame:
    """Sum of price relatives and member count per day and cohort."""
    return introduced.groupBy("day", "introduction_day").agg(
        F.sum(F.col("volume_weighted_avg_price") / F.col("introduction_price")).alias("relatives"),
        F.count(F.lit(1)).alias("members"),
        F.max("known_level").alias("known_level"),
    )


def cohort_levels(sums: DataFrame) -> DataFrame:
    """Index level at which each cohort enters: ``(introduction_day, level)``.

    Only the days just before a new cohort matter. They are found on one narrow row per
    day; only their cohort sums go to one small forward substitution, at most (cohorts)² / 2 of
    them, and cohorts are bounded by the trading days of the calendar, not by the bars.
    """
    opens = F.max(F.when((F.col("introduction_day") == F.col("day")) & F.col("known_level").isNull(), 1))
    days = sums.groupBy("day").agg(F.sum("members").alias("present"), opens.alias("opens"))
    by = Window.partitionBy(F.lit("all")).orderBy("day")
    opened = days.select(
        F.col("day").alias("cohort_day"), "opens", F.lag("day").over(by).alias("_before"), F.lag("present").over(by).alias("present")
    ).filter(F.col("opens") == 1)
    parts = sums.select(F.col("day").alias("_day"), "introduction_day", "relatives", "known_level")
    terms = opened.join(parts, F.col("_before") == F.col("_day"), "left").select(
        "cohort_day", "present", "introduction_day", "relatives", "known_level"
    )

    def substitute(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows.dropna(subset=["known_level"])
        levels = dict(zip(known["introduction_day"], known["known_level"]))
        opened = []
        for day, part in rows.groupby("cohort_day", sort=True):
            part = part.dropna(subset=["relatives"])
            level = 1.0
            if len(part):
                total = sum(levels[d] * r for d, r in zip(part["introduction_day"], part["relatives"]))
                level = total / part["present"].iloc[0]
            levels[day] = level
            opened.append((day, level))
        return pd.DataFrame(opened, columns=["introduction_day", "level"])

    return terms.groupBy(F.lit("all")).applyInPandas(substitute, "introduction_day date, level double")


def index_members(daily: DataFrame, state: DataFrame | None = None, regular_hours: bool = True) -> DataFrame:
    """Price changes of every member on every day, with its introduction data.

    ``state`` (from ``member_state``) continues an earlier run.
    """
    introduced = _introduced(daily, state)
    levels = cohort_levels(cohort_sums(introduced))
    scale = F.col("index_value_when_introduced") / F.col("introduction_price")
    return (
        introduced.join(levels, "introduction_day", "left")
        .withColumn("index_value_when_introduced", F.coalesce("known_level", "level"))
        .select(
            F.lit(measurements(regular_hours)[0]).alias("measurement"),
            "ticker",
            "company",
            "day",
            F.col("day").cast("timestamp").alias("ts"),
            (F.col("opening_price") * scale).alias("price_change_open"),
            (F.col("closing_price") * scale).alias("price_change_close"),
            (F.col("high_price") * scale).alias("price_change_high"),
            (F.col("low_price") * scale).alias("price_change_low"),
            (F.col("volume_weighted_avg_price") * scale).alias("price_change_avg"),
            (F.col("prev_avg_price") * scale).alias("prev_price_change_avg"),
            "total_trading_value",
            "introduction_day",
            "introduction_price",
            "index_value_when_introduced",
            F.col("volume_weighted_avg_price").alias("avg_price"),
        )
    )


def index_series(members: DataFrame, regular_hours: bool = True, geometric: bool = False) -> DataFrame:
    """The index: mean of each change over the day's members, traded value summed."""

    def mean(column: str):
        return F.exp(F.avg(F.ln(column))) if geometric else F.avg(column)

    return members.groupBy("day").agg(
        *[mean(c).alias(c) for c in CHANGES], F.sum("total_trading_value").alias("total_trading_value")
    ).select(
        F.lit(measurements(regular_hours)[1]).alias("measurement"),
        F.lit(INDEX_TICKER).alias("ticker"),
        F.lit(INDEX_TICKER).alias("company"),
        "day",
        F.col("day").cast("timestamp").alias("ts"),
        *CHANGES,
        "total_trading_value",
    )


def member_state(members: DataFrame, before: str | None = None) -> DataFrame:
    """One row per member: introduction data and the last average price (before a date)."""
    kept = members.filter(F.col("day") < F.lit(before).cast("date")) if before else members
    return kept.groupBy("ticker").agg(
        F.min("introduction_day").alias("introduction_day"),
        F.max_by("introduction_price", "day").alias("introduction_price"),
        F.max_by("index_value_when_introduced", "day").alias("index_value_when_introduced"),
        F.max("day").alias("prev_day"),
        F.max_by("avg_price", "day").alias("prev_avg_price"),
    )


def recompute_from(daily: DataFrame, stored_members: DataFrame, start: str, regular_hours: bool = True) -> DataFrame:
    """Member rows from ``start`` on, equal to those of a full run.

    Reads the bars from the last index day before ``start`` only; that day gives the
    level at which members new on ``start`` enter.
    """
    first = F.lit(start).cast("date")
    earlier = stored_members.filter(F.col("day") < first)
    last_day = earlier.select(F.max("day")).scalar()
    batch = daily.filter(F.col("day") >= F.coalesce(last_day, first))
    return index_members(batch, member_state(earlier), regular_hours).filter(F.col("day") >= first)


STATE = "ticker string, introduction_day date, introduction_price double, index_value_when_introduced double, prev_day date, prev_avg_price double"


def recompute_with_state(daily: DataFrame, state: DataFrame, start: str, regular_hours: bool = True) -> DataFrame:
    """``recompute_from`` with the members' state as of ``start`` in place of their history.

    The last index day before ``start`` is the newest of the state's last days.
    """
    first = F.lit(start).cast("date")
    last_day = state.select(F.max("prev_day")).scalar()
    batch = daily.filter(F.col("day") >= F.coalesce(last_day, first))
    return index_members(batch, state, regular_hours).filter(F.col("day") >= first)


def state_versions(members: DataFrame, earlier: DataFrame | None, until: str) -> DataFrame:
    """The members' state as of the first day of each month, in a row each: ``member_state`` with ``as_of``.

    ``members`` are the rows from some month on and ``earlier`` is the state as of that month. A member's last row of a
    month holds until the month of its next one, or to ``until``; months are few, and so are a member's versions.
    """
    rows = members.groupBy("ticker", F.trunc("day", "month").alias("month")).agg(
        F.min("introduction_day").alias("introduction_day"),
        F.max_by("introduction_price", "day").alias("introduction_price"),
        F.max_by("index_value_when_introduced", "day").alias("index_value_when_introduced"),
        F.max("day").alias("prev_day"),
        F.max_by("avg_price", "day").alias("prev_avg_price"),
    )
    if earlier is not None:
        rows = rows.unionByName(earlier.withColumn("month", F.trunc("prev_day", "month")).select(*rows.columns))
    by = Window.partitionBy("ticker").orderBy("month")
    end = F.trunc(F.lit(until).cast("date"), "month")
    valid = F.sequence(F.add_months("month", 1), F.least(F.coalesce(F.lead("month").over(by), end), end), F.expr("INTERVAL 1 MONTH"))
    starts = rows.withColumn("valid", F.when(F.add_months("month", 1) <= F.least(F.coalesce(F.lead("month").over(by), end), end), valid))
    names = [f.split()[0] for f in STATE.split(", ")]
    return starts.select(*names, F.explode("valid").alias("as_of"))


def start_date(stale_from: DataFrame, index: DataFrame, default: str) -> DataFrame:
    """Where a recompute has to begin: the earlier of the stale mark and the last index day.

    Either table may be empty; a missing one counts as ``default``.
    """
    fallback = F.lit(default).cast("date")
    mark = stale_from.agg(F.coalesce(F.min("stale_from"), fallback).alias("start"))
    latest = index.agg(F.coalesce(F.max("day"), fallback).alias("start"))
    return mark.unionByName(latest).agg(F.min("start").alias("start"))
