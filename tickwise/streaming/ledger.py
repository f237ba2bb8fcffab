"""Results that are written once, however often a batch is delivered.

A query that is restarted gets its last batch again, and a batch that was killed between two
writes has done one of them. Each write goes to a folder of its own (query, run, batch) and is
replaced as a whole when it is done again; a ledger row says that it is complete. Readers see what
the ledger lists. A replay from the oldest record is a new run, which takes the place of the run before
once it has ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRIES = "query string, run int, batch long, target string"
#: Target of the entry that ends a run.
END = "end of run"


@dataclass(frozen=True)
class Ledger:
    """Entries ``(query, run, batch, target)`` in a folder; each is a file that appears whole or not at all."""

    path: str

    def entries(self, spark: SparkSession) -> DataFrame:
        from tickwise.sources.store import path_exists

        if not path_exists(spark, self.path):
            return spark.createDataFrame([], ENTRIES)
        return spark.read.schema(ENTRIES).parquet(self.path).distinct()

    def has(self, spark: SparkSession, query: str, run: int, batch: int, target: str) -> bool:
        found = (F.col("query") == query) & (F.col("run") == run) & (F.col("batch") == batch) & (F.col("target") == target)
        return not self.entries(spark).filter(found).isEmpty()

    def add(self, spark: SparkSession, query: str, run: int, batch: int, target: str) -> None:
        spark.createDataFrame([(query, run, batch, target)], ENTRIES).coalesce(1).write.mode("append").parquet(self.path)

    def new_run(self, spark: SparkSession, query: str) -> int:
        """The number after that of the last run."""
        last = self.entries(spark).filter(F.col("query") == query).agg(F.max("run")).first()[0]
        return 1 if last is None else last + 1

    def end_run(self, spark: SparkSession, query: str, run: int) -> None:
        self.add(spark, query, run, -1, END)

    def valid_run(self, spark: SparkSession, query: str) -> int | None:
        """The newest run that has ended; before the first has, the newest at all."""
        runs = self.entries(spark).filter(F.col("query") == query)
        ended: Row = runs.agg(F.max(F.when(F.col("target") == END, F.col("run"))).alias("ended"), F.max("run").alias("any")).first()
        return ended["any"] if ended["ended"] is None else ended["ended"]


def once(ledger: Ledger, query: str, run: int, writes: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: does each named write of a batch that the ledger doesn't list yet, and lists it.

    A write that was interrupted is done again, so it must replace what it has written for the batch.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        missing = {target: write for target, write in writes.items() if not ledger.has(spark, query, run, number, target)}
        if not missing:
            return
        batch.persist()
        try:
            for target, write in missing.items():
                write(batch, number)
                ledger.add(spark, query, run, number, target)
        finally:
            batch.unpersist()

    return deliver


def append_batch(path: str, query: str, run: int) -> Callable[[DataFrame, int], None]:
    """Appends a batch's rows below ``path``; done again it replaces them."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/query={query}/run={run}/delivery={number}")

    return write


def appended(spark: SparkSession, ledger: Ledger, path: str, query: str, target: str, schema: StructType | str) -> DataFrame:
    """Rows of the batches that the ledger lists for a target, in the query's valid run."""
    run = ledger.valid_run(spark, query)
    if run is None:
        return spark.createDataFrame([], schema)
    kept = ledger.entries(spark).filter((F.col("query") == query) & (F.col("run") == run) & (F.col("target") == target))
    folder = f"{path}/query={query}/run={run}"
    names = [f"{folder}/delivery={r.batch}" for r in kept.select("batch").orderBy("batch").collect()]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*names)
