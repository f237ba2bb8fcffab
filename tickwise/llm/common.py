"""Helpers that several training-data operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.session import fresh_path

#: Words are runs of anything but the six ASCII blanks.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[ \\t-\\r]+"
#: ``spread`` gives numbers below this.
SPREAD = 1 << 28


def stage(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs see the same rows, whatever executor goes.

    ``narrow`` tables (ids and numbers, no texts) are dealt out evenly to one file a core, since
    a file for each task of the scan would be tiny.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.repartition(spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a non-null text, in order."""
    return F.array_remove(F.split(text, BLANK_RUN), "")


def spread(*columns: Column, seed: str = "") -> Column:
    """A number in [0, SPREAD) that depends on the values alone; nulls count as a value of their own."""
    parts = [F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("long")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


#: Rows of text that a Python worker holds at once; the session's default of ten thousand is meant for short rows.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lets whole texts go to Python workers in batches of at most ``BATCH_ROWS`` rows, for this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def batch_bytes(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """Jobs that run inside hand rows to Python workers in batches of at most ``most`` bytes; the setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, key: str, spread_by: str, order: list[str], value: str | None = None, into: str = "before", groups: int = 1) -> DataFrame:
    """Adds the sum of ``value`` (default: the count of rows) over the rows of the same key that come before.

    Rows of a key are ordered by ``spread_by`` (in [0, SPREAD)), then ``order``. The
    window runs over slices of the hash, and a small table carries the totals of
    the slices before, so a key that holds any share of the rows is spread over
    many tasks; the result doesn't depend on the number of slices. ``groups``
    is a guess of how many keys share the rows evenly. ``key`` must not be null.
    """
    slices = max(1, math.ceil(4 * shuffle_partitions(df.sparkSession) / groups))
    amount = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    cut = df.withColumn("__slice", F.floor(F.col(spread_by) * slices / F.lit(SPREAD)).cast("int")).withColumn("__amount", amount)
    totals = cut.groupBy(F.col(key).alias("__key"), F.col("__slice").alias("__of")).agg(F.sum("__amount").alias("__total"))
    earlier = W.partitionBy("__key").orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__key", "__of", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    within = W.partitionBy(key, "__slice").orderBy(spread_by, *order).rowsBetween(W.unboundedPreceding, -1)
    return (
        cut.withColumn("__inner", F.coalesce(F.sum("__amount").over(within), F.lit(0)))
        .join(offsets, (F.col(key) == F.col("__key")) & (F.col("__slice") == F.col("__of")))
        .withColumn(into, F.col("__inner") + F.col("__offset"))
        .drop("__slice", "__amount", "__key", "__of", "__offset", "__inner")
    )
