"""An event log between jobs: written by one stream, read from its oldest record by others.

The log is a folder of segments, one a micro-batch, with the schema beside them. A
segment that is written again replaces itself. Within a segment rows are dealt by ranges of (symbol, time), so a
file has a symbol's events in order of time, and a symbol that holds most rows is spread over files.
``position`` orders the events of a symbol over the whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEGMENT = "segment"


def _schema_path(path: str) -> str:
    return f"{path}/_schema"


def write_segment(events: DataFrame, path: str, number: int, order: list[str]) -> None:
    """Writes the events of one micro-batch; the log's schema is that of its first segment."""
    spark = events.sparkSession
    if number == 0:
        spark.createDataFrame([(events.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(_schema_path(path))
    placed = events.repartitionByRange("symbol", *order).sortWithinPartitions("symbol", *order)
    placed.write.mode("overwrite").parquet(f"{path}/{SEGMENT}={number}")


def write(events: DataFrame, path: str, checkpoint: str, order: tuple[str, ...] = ("market_ts", "trade_id")):
    """A stream's events appended to the log; ties in ``order`` keep any order."""
    return events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: write_segment(batch, path, number, list(order))
    )


def schema(spark: SparkSession, path: str) -> StructType:
    """The schema that the writer has left beside the segments."""
    import json

    return StructType.fromJson(json.loads(spark.read.text(_schema_path(path)).first()[0]))


def read(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """All events from the oldest on, as a table or as a stream, without the log's own columns."""
    reader = (spark.readStream if stream else spark.read).schema(schema(spark, path).add(SEGMENT, "long"))
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).drop(SEGMENT)


def positions(spark: SparkSession, path: str, order: tuple[str, ...] = ("market_ts", "trade_id")) -> DataFrame:
    """The log's events with ``position``: by it a symbol's events have the order in which they came."""
    rows = spark.read.schema(schema(spark, path).add(SEGMENT, "long")).parquet(path)
    return rows.withColumn("position", F.struct(SEGMENT, *order)).drop(SEGMENT)
