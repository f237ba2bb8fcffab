"""Points as text: ``measurement,tags fields time``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.functions.scalar import epoch_nanos

SCALE = 10


def _tag(name: str) -> Column:
    escaped = F.regexp_replace(F.col(name).cast("string"), r"([,= ])", r"\\$1")
    return F.concat(F.lit(f"{name}="), escaped)


def _field(name: str, kind: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        text = F.concat(value.cast("string"), F.lit("i"))
    elif isinstance(kind, T.TimestampType):
        text = F.concat(epoch_nanos(value).cast("string"), F.lit("i"))
    elif isinstance(kind, T.StringType):
        quoted = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
        text = F.concat(F.lit('"'), quoted, F.lit('"'))
    elif isinstance(kind, T.BooleanType):
        text = value.cast("string")
    else:
        text = value.cast(T.DecimalType(38, SCALE)).cast("string")
    return F.concat(F.lit(f"{name}="), text)


def line_protocol(df: DataFrame, measurement: str, tags: list[str], fields: list[str], ts: str) -> DataFrame:
    """One text line per row: decimals with ten places, whole numbers with ``i``, times in ns.

    A missing field is left out of its line.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    head = F.concat_ws(",", F.lit(measurement), *[_tag(t) for t in tags])
    body = F.concat_ws(",", *[_field(f, kinds[f]) for f in fields])
    return df.select(F.concat_ws(" ", head, body, epoch_nanos(ts).cast("string")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file per partition; Spark batches the writes."""
    lines.write.mode("overwrite").text(path)
