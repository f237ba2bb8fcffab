"""Validation: every check yields accepted rows and rejected rows with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickwise.functions.scalar import _c


def with_reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``reasons``: names of the checks a row fails.  A NULL check counts as failed."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*failed)))


def split(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; rejected rows keep their ``reasons``."""
    marked = with_reasons(df, checks)
    return (
        marked.filter(F.size("reasons") == 0).drop("reasons"),
        marked.filter(F.size("reasons") > 0),
    )


def bar_checks() -> dict[str, Column]:
    columns = ["opening_price", "closing_price", "high_price", "low_price", "volume_weighted_avg_price", "volume"]
    return {c: F.col(c) > 0 for c in columns}


def present(*columns: str) -> dict[str, Column]:
    return {c.replace(".", "_"): F.col(c).isNotNull() for c in columns}


def universe_checks() -> dict[str, Column]:
    return {
        "ticker": F.col("ticker").rlike("^[A-Z.]{1,5}$"),
        "company": F.trim("company") != "",
    }


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their count."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)


def stale_tickers(latest: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Tickers whose last row is older than a week: renamed or delisted."""
    return latest.filter(F.col("latest") < as_of - F.make_dt_interval(days=F.lit(days)))


def tickers_without_rows(universe: DataFrame, rows: DataFrame) -> DataFrame:
    """Universe tickers that no row refers to."""
    return universe.join(rows.select("ticker").distinct(), "ticker", "left_anti")


def resolve_aliases(symbols: DataFrame, universe: DataFrame) -> DataFrame:
    """Find a symbol under its market or its fundamentals ticker."""
    names = universe.select("*", F.explode(F.array_distinct(F.array_compact(F.array("ticker", "fundamentals_ticker")))).alias("alias"))
    return symbols.join(names, symbols["symbol"] == names["alias"]).drop("alias")


def result_message_checks() -> dict[str, Column]:
    return present("measure_id", "measurement", "symbol")


def check_columns(df: DataFrame, expected: list[str], label: str | None = None) -> DataFrame:
    """Raise unless the columns are exactly ``expected`` and the label leads."""
    missing, extra = sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))
    if missing or extra:
        raise TypeError(f"schema mismatch: missing={missing}, extra={extra}")
    if label and df.columns[0] != label:
        raise TypeError(f"the first column must be {label!r}, got {df.columns[0]!r}")
    return df.select(*expected)


def hold_out_tail(df: DataFrame, rows: int = 375, ts: str = "day", keys: list[str] | None = None) -> DataFrame:
    """All but the last ``rows`` rows of each series, so that predictions meet unseen days.

    Of one series, only the last times are sorted out, as a top-``rows`` of each task; rows
    of the time at the cut go as well.
    """
    if keys:
        by = Window.partitionBy(*keys).orderBy(F.desc(ts))
        return df.withColumn("_from_end", F.row_number().over(by)).filter(F.col("_from_end") > rows).drop("_from_end")
    if rows < 1:
        return df
    cut = df.select(F.col(ts).alias("_ts")).orderBy(F.desc("_ts")).limit(rows)
    return df.filter(F.col(ts) < cut.select(F.min("_ts")).scalar())


def throughput(df: DataFrame, ts: str = "market_ts", every: str = "1 minute") -> DataFrame:
    """Messages per minute."""
    counted = df.groupBy(F.window(_c(ts), every).alias("w")).agg(F.count(F.lit(1)).alias("messages"))
    return counted.select(F.col("w.start").alias("minute"), "messages")
