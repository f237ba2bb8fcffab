"""Operators over time series: resample, pivot, moving averages, shifts, fills.

A series holds at most one row per key and time step, so a window partitioned
by series key is bounded by the calendar, whatever the number of raw events.
"""

from __future__ import annotations

import re
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

AGGREGATES = ("first", "last", "max", "mean", "median", "min", "sum")

# Look-back range → resampling step for live dashboards.
LIVE_STEPS = {"-2d": "6 minutes", "-3d": "9 minutes", "-4d": "12 minutes", "-7d": "15 minutes"}


def live_step(look_back: str) -> str | None:
    """Longer look-back, coarser step; ``None`` leaves the rows as they are."""
    return LIVE_STEPS.get(look_back)


def aggregate(fn: str, column: str, ts: str) -> Column:
    if fn == "first":
        return F.min_by(column, ts)
    if fn == "last":
        return F.max_by(column, ts)
    if fn == "mean":
        return F.avg(column)
    if fn not in AGGREGATES:
        raise ValueError(f"unknown aggregate {fn!r}, expected one of {AGGREGATES}")
    return getattr(F, fn)(column)


def _months(every: str) -> int | None:
    found = re.fullmatch(r"\s*(\d+)\s*months?\s*", every)
    return int(found.group(1)) if found else None


def bucket_bounds(ts: str, every: str) -> tuple[Column, Column]:
    """Start and end of the bucket that holds ``ts``.

    Fixed-length buckets are aligned to the epoch (a Thursday); month buckets to
    January of year zero.
    """
    months = _months(every)
    if months is None:
        w = F.window(ts, every)
        return w["start"], w["end"]
    number = F.year(ts) * 12 + F.month(ts) - 1
    first = F.floor(number / months) * months

    def month_start(n: Column) -> Column:
        return F.make_date(F.floor(n / 12).cast("int"), (n % 12 + 1).cast("int"), F.lit(1)).cast("timestamp")

    return month_start(first), month_start(first + months)


def resample(
    df: DataFrame,
    every: str,
    columns: list[tuple[str, str, str]],
    keys: list[str],
    ts: str = "ts",
    create_empty: bool = False,
) -> DataFrame:
    """Aggregate ``(column, function, alias)`` triples over buckets of ``every``.

    Rows are labelled with the bucket's end.  ``create_empty`` keeps buckets without
    rows between the first and last one of each series (fixed-length buckets only).
    """
    grouped = _grouped_buckets(df, every, columns, keys, ts)
    if not create_empty:
        return grouped
    if _months(every) is not None:
        raise ValueError("empty buckets need a fixed-length step")
    grid = (
        grouped.groupBy(*keys)
        .agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
        .select(*keys, F.explode(F.sequence("_from", "_to", F.expr(f"INTERVAL {every}"))).alias("ts"))
    )
    return grid.join(grouped, [*keys, "ts"], "left")


def _grouped_buckets(df, every, columns, keys, ts):
    aggregates = [aggregate(fn, column, ts).alias(alias) for column, fn, alias in columns]
    if _months(every) is not None:
        _, end = bucket_bounds(ts, every)
        return df.groupBy(*keys, end.alias("ts" if ts != "ts" else "_end")).agg(*aggregates).withColumnsRenamed(
            {"_end": "ts"}
        )
    grouped = df.groupBy(*keys, F.window(ts, every).alias("_w")).agg(*aggregates)
    return grouped.select(*keys, F.col("_w.end").alias("ts"), *[alias for _, _, alias in columns])


def resample_aliased(
    df: DataFrame, every: str, fields: list[tuple[str, str, str]], keys: list[str], ts: str = "ts"
) -> DataFrame:
    """Several fields with a function and an alias each, in long form.

    One aggregation pass and an unpivot give what a union of separate resamples would.
    """
    wide = resample(df, every, fields, keys, ts)
    aliases = [alias for _, _, alias in fields]
    return wide.unpivot([*keys, "ts"], aliases, "field", "value").filter(F.col("value").isNotNull())


# --- reshape ---------------------------------------------------------------


def to_long(df: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """Wide → long: one ``(_field, _value)`` row per id row and present field."""
    return df.unpivot(ids, fields, "_field", "_value").filter(F.col("_value").isNotNull())


def to_wide(df: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """Long → wide for a known list of fields; a field written twice keeps its largest value."""
    return df.groupBy(*ids).pivot("_field", fields).agg(F.max("_value"))


def matching_fields(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(F.col("_field").rlike(pattern))


# --- ordered operators -----------------------------------------------------


def _ordered(keys: list[str], ts: str):
    return Window.partitionBy(*keys).orderBy(ts)


def difference(df: DataFrame, columns: list[str], keys: list[str], ts: str = "ts") -> DataFrame:
    """Columns replaced by their change since the previous row; first rows are dropped."""
    by = _ordered(keys, ts)
    changed = {c: F.col(c) - F.lag(c).over(by) for c in columns}
    return (
        df.select(
            *[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns],
            F.row_number().over(by).alias("_row"),
        )
        .filter(F.col("_row") > 1)
        .drop("_row")
    )


def cumulative_sum(column: str, keys: list[str], ts: str = "ts") -> Column:
    return F.sum(column).over(_ordered(keys, ts).rowsBetween(Window.unboundedPreceding, 0))


def moving_average(df: DataFrame, column: str, n: int, keys: list[str], ts: str = "ts", alias: str | None = None) -> DataFrame:
    """Mean of the last ``n`` rows; the first ``n - 1`` rows are dropped."""
    by = _ordered(keys, ts)
    return (
        df.select(
            "*",
            F.avg(column).over(by.rowsBetween(1 - n, 0)).alias(alias or "moving_average"),
            F.row_number().over(by).alias("_row"),
        )
        .filter(F.col("_row") >= n)
        .drop("_row")
    )


def kaufman(values: np.ndarray, n: int) -> np.ndarray:
    """Adaptive moving average of one ordered series; the first ``n`` places are NaN.

    The seed is the value before the first output row.
    """
    out = np.full(len(values), np.nan)
    if len(values) <= n:
        return out
    change = np.abs(values[n:] - values[:-n])
    travelled = np.concatenate([[0.0], np.cumsum(np.abs(np.diff(values)))])
    volatility = travelled[n:] - travelled[:-n]
    efficiency = np.divide(change, volatility, out=np.zeros_like(change), where=volatility > 0)
    fast, slow = 2 / (2 + 1), 2 / (30 + 1)
    smoothing = (efficiency * (fast - slow) + slow) ** 2
    level = values[n - 1]
    for i, weight in enumerate(smoothing, start=n):
        level += weight * (values[i] - level)
        out[i] = level
    return out


def kaufman_average(df: DataFrame, column: str, n: int, keys: list[str], ts: str = "ts", alias: str = "kaufman_average") -> DataFrame:
    """Kaufman's adaptive moving average per series; the first ``n`` rows are dropped.

    The value depends on the whole past of the series, so each series (one row per
    time step) goes to one task; series run in parallel.
    """
    kept = df.select(*keys, ts, column)

    def per_series(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ts, ignore_index=True)
        rows[alias] = kaufman(rows[column].to_numpy(dtype=float), n)
        return rows.iloc[n:]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{alias}` double"
    return kept.groupBy(*keys).applyInPandas(per_series, schema)


def time_shift(ts: Column | str, periods: int, multiplier: float) -> Column:
    """Move a label back by a fraction of a moving-average period, in whole days."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - F.make_dt_interval(days=F.lit(int(periods * multiplier)))


def fixed_lag(column: str, seconds: int, keys: list[str], ts: str = "ts") -> Column:
    """Value exactly ``seconds`` earlier in the same series, NULL when there is no such row.

    A range frame of one point, so no self join.
    """
    micros = seconds * 1_000_000
    by = Window.partitionBy(*keys).orderBy(F.unix_micros(ts)).rangeBetween(-micros, -micros)
    return F.max(column).over(by)


def first_value(column: str, keys: list[str], ts: str = "ts") -> Column:
    """First present value of the series, as seen from each row on."""
    by = _ordered(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
    return F.first(column, ignorenulls=True).over(by)


def forward_fill(df: DataFrame, column: str, keys: list[str], day: str = "day") -> DataFrame:
    """Carry the last present value forward and name the day it came from.

    Rows before the first present value are dropped.
    """
    by = _ordered(keys, day).rowsBetween(Window.unboundedPreceding, 0)
    source = F.last(F.when(F.col(column).isNotNull(), F.col(day)), ignorenulls=True).over(by)
    return (
        df.select(
            *keys,
            day,
            F.last(column, ignorenulls=True).over(by).alias(column),
            F.when(F.col(column).isNull(), source).alias("carry_forward_from"),
        )
        .filter(F.col(column).isNotNull())
    )


#: Above every bigint taken from the least one, so a time and an id fit in 38 digits.
ID_SPACE = 1 << 64


def packed_order(df: DataFrame, order: list[str]) -> Column | None:
    """A time, or a time and a whole number, as one decimal that sorts the same way.

    Aggregates over a decimal work by hash, those over a struct sort their input
    first. A null sorts first. None if the columns are of other types.
    """
    kinds = dict(df.dtypes)
    if not 1 <= len(order) <= 2 or kinds.get(order[0]) != "timestamp" or kinds.get(order[-1]) not in ("timestamp", "bigint", "int"):
        return None
    instant = F.coalesce(F.unix_micros(order[0]), F.lit(-(10**17) + 1)).cast("decimal(18,0)")
    if len(order) == 1:
        return instant
    if kinds[order[1]] == "timestamp":
        return None
    number = F.coalesce(F.col(order[1]).cast("decimal(20,0)") + F.lit(Decimal(1 << 63)), F.lit(Decimal(-1)))
    return (instant.cast("decimal(38,0)") * F.lit(Decimal(ID_SPACE)) + number).cast("decimal(38,0)")


def newest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key; among rows of equal order the largest by the other columns.

    Where the order can be packed, the newest order of each key is found by hash, where
    the rows lie, and only rows with that order are sorted.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = packed_order(df, order)
    if packed is not None:
        kept = df.withColumn("_order", packed)
        newest = kept.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max("_order").alias("_newest"))
        same = F.col("_order") == F.col("_newest")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        df = kept.join(newest, same).select(*df.columns)
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def numbered(df: DataFrame, keys: list[str], block: Column, order: list[str], into: str) -> DataFrame:
    """Adds the place of each row, from 0 on, in its key's ``order``.

    ``block`` never goes down along the order. Rows are numbered within a block, and the counts of the
    blocks before are added, so a key that holds most rows is spread over its blocks.
    """
    cut = df.withColumn("_block", block)
    counts = cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, "_block"]
    offsets = counts.select(*[F.col(c).alias(f"_of{c}") for c in names], F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_offset"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_of{c}"))
    within = Window.partitionBy(*names).orderBy(*order)
    placed = cut.withColumn("_within", F.row_number().over(within) - 1).join(offsets, same)
    return placed.withColumn(into, F.col("_within") + F.col("_offset")).select(*df.columns, into)


def latest_per_id(df: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """The newest row of every id, newest first."""
    return newest_rows(df, [id_column], order).orderBy(*[F.desc(c) for c in order], id_column)
