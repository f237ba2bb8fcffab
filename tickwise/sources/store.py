"""Stored tables with point semantics: writing a key again replaces its row.

A table is a parquet folder partitioned by a few low-cardinality columns
(``measurement`` and ``day`` for series).  Writes touch only the partitions that
hold incoming keys, and replacing a partition twice gives the same result, so a
retried batch is harmless.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickwise.operators.series import newest_rows


@dataclass(frozen=True)
class Table:
    """Where a table lies, what identifies a row, and which rows count as newer."""

    path: str
    keys: list[str]
    partitions: list[str]
    order: list[str] = field(default_factory=list)


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, found = _file_system(spark, path)
    return fs.exists(found)


def exists(spark: SparkSession, table: Table) -> bool:
    return path_exists(spark, table.path)


def load(spark: SparkSession, table: Table, schema: StructType | None = None) -> DataFrame:
    """The stored rows; a table that may still be empty needs its schema named."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(table.path)


def replace_partitions(df: DataFrame, table: Table) -> None:
    """Overwrite the partitions that ``df`` has rows for and leave the others.

    Rows of a partition meet in few files; a partition that is far larger is split over tasks.
    """
    (
        df.hint("rebalance", *table.partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*table.partitions)
        .parquet(table.path)
    )


def _matching(columns: list[str], other: DataFrame, prefix: str) -> Column:
    """Equality on ``columns`` with those of ``other`` named with a prefix; nulls match."""
    match = F.lit(True)
    for c in columns:
        match = match & F.col(c).eqNullSafe(other[prefix + c])
    return match


def _prefixed(df: DataFrame, columns: list[str], prefix: str = "_p_") -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns]).distinct()


def in_partitions(spark: SparkSession, df: DataFrame, table: Table, values: list[Row]) -> DataFrame:
    """Rows of ``df`` in the given partitions, as a filter that prunes the scan."""
    if not values:
        return df.limit(0)
    if len(table.partitions) == 1:
        name = table.partitions[0]
        known = [v[name] for v in values if v[name] is not None]
        kept = F.col(name).isin(known) if known else F.lit(False)
        return df.filter(kept | F.col(name).isNull() if len(known) < len(values) else kept)
    either = F.lit(False)
    for v in values:
        both = F.lit(True)
        for c in table.partitions:
            both = both & (F.col(c).isNull() if v[c] is None else F.col(c) == F.lit(v[c]))
        either = either | both
    return df.filter(either)


def upsert(rows: DataFrame, table: Table) -> None:
    """Add rows; a row with a stored key replaces it, and among equals the newest wins.

    A batch touches few partitions (the days it has rows for), so their names are
    collected and only these are read.
    """
    spark = rows.sparkSession
    incoming = newest_rows(rows, table.keys, table.order) if table.order else rows.dropDuplicates(table.keys)
    if not exists(spark, table):
        replace_partitions(incoming, table)
        return
    incoming = incoming.persist()
    try:
        touched = incoming.select(*table.partitions).distinct().collect()
        stored = in_partitions(spark, load(spark, table, rows.schema), table, touched)
        keys = _prefixed(incoming, table.keys)
        untouched = stored.join(keys, _matching(table.keys, keys, "_p_"), "left_anti")
        replace_partitions(incoming.unionByName(untouched.select(*incoming.columns)), table)
    finally:
        incoming.unpersist()


def scan(df: DataFrame, measurement: str | None = None, start: str | None = None, stop: str | None = None, ts: str = "ts", day: str | None = "day") -> DataFrame:
    """Rows of a measurement with ``start <= ts < stop``.

    When the table has a ``day`` partition column the bounds also prune partitions.
    """
    prune = day if day and day in df.columns else None
    if measurement:
        df = df.filter(F.col("measurement") == measurement)
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
        df = df.filter(F.col(prune) >= F.lit(start).cast("date")) if prune else df
    if stop:
        df = df.filter(F.col(ts) < F.lit(stop).cast("timestamp"))
        df = df.filter(F.col(prune) <= F.lit(stop).cast("date")) if prune else df
    return df


def _drop_folders(spark: SparkSession, files: list[str]) -> None:
    """Remove the partition folders that hold these files; there is one file a folder."""
    for file in files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _partition_files(stored: DataFrame, table: Table, *measures: Column) -> DataFrame:
    """A row per stored partition with one of its files, whose folder is the partition's whatever its value needs escaped."""
    return stored.groupBy(*table.partitions).agg(F.min("_metadata.file_path").alias("_file"), *measures)


def drop_missing(spark: SparkSession, table: Table, present: DataFrame, among: Column | None = None) -> None:
    """Remove the stored partitions (of those ``among`` selects) that ``present`` has no row for."""
    stored = load(spark, table)
    held = _partition_files(stored.filter(among) if among is not None else stored, table)
    names = _prefixed(present, table.partitions)
    gone = held.join(names, _matching(table.partitions, names, "_p_"), "left_anti")
    _drop_folders(spark, [r["_file"] for r in gone.select("_file").collect()])


def delete(spark: SparkSession, table: Table, predicate: Column) -> None:
    """Delete rows by predicate, rewriting only the partitions that hold such rows.

    The partitions' names are collected, never their rows.
    """
    stored = load(spark, table)
    hit = F.coalesce(predicate, F.lit(False))
    counted = _partition_files(stored, table, F.count_if(hit).alias("_gone"), F.count_if(~hit).alias("_kept"))
    touched = counted.filter(F.col("_gone") > 0).collect()
    partial = [r for r in touched if r["_kept"]]
    if partial:
        replace_partitions(in_partitions(spark, stored, table, partial).filter(~hit).select(*stored.columns), table)
    _drop_folders(spark, [r["_file"] for r in touched if not r["_kept"]])


def rename_ticker(spark: SparkSession, table: Table, old: str, new: str) -> None:
    """Move the rows of one ticker under a new name.

    Rows that the new name has already stay, unless a moved row has the same key: then
    the newer of the two by the table's order counts, the moved one if there is no order.
    """
    stored = load(spark, table)
    either = F.col("ticker").isin(old, new)
    touched = stored.filter(either).select(*table.partitions).distinct().collect()
    if old == new or stored.filter(F.col("ticker") == old).isEmpty():
        return
    rows = in_partitions(spark, stored, table, touched).withColumn("_moved", F.col("ticker") == old)
    renamed = rows.withColumn("ticker", F.when(F.col("_moved"), F.lit(new)).otherwise(F.col("ticker")))
    if "ticker" in table.partitions:
        emptied = _partition_files(stored.filter(F.col("ticker") == old), table).select("_file").collect()
    else:
        emptied = []
    resolved = newest_rows(renamed, table.keys, [*table.order, "_moved"]).select(*stored.columns)
    replace_partitions(resolved, table)
    _drop_folders(spark, [r["_file"] for r in emptied])


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate result once and read it back: later steps start from the table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- keyed documents ---------------------------------------------------------


def document_table(path: str) -> Table:
    """Documents ``(pk, sk, body)``; the newest version of a key counts.

    Keys are many, so they are spread over ``BUCKETS`` folders by hash.
    """
    return Table(path, keys=["pk", "sk"], partitions=["bucket"], order=["version"])


BUCKETS = 64


def bucket_of(pk: Column) -> Column:
    return F.pmod(F.xxhash64(pk), F.lit(BUCKETS)).cast("int")


def put_documents(documents: DataFrame, table: Table) -> None:
    upsert(documents.withColumn("bucket", bucket_of(F.col("pk"))), table)


def query_documents(spark: SparkSession, table: Table, pk: str, sk: str | None = None) -> DataFrame:
    bucket = spark.range(1).select(bucket_of(F.lit(pk))).first()[0]
    found = load(spark, table).filter((F.col("bucket") == bucket) & (F.col("pk") == pk)).drop("bucket")
    return found.filter(F.col("sk") == sk) if sk else found


# --- stale mark --------------------------------------------------------------


def suggest_stale_from(marks: DataFrame, suggestion: DataFrame) -> DataFrame:
    """One-row table with the earlier of the stored mark and the suggestion."""
    return marks.unionByName(suggestion).agg(F.min("stale_from").alias("stale_from"))
