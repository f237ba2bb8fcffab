"""The universe of tickers: a small configuration file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNIVERSE_SCHEMA = (
    "ticker STRING, company STRING, series STRING, start_date DATE, end_date DATE, fundamentals_ticker STRING, skip BOOLEAN"
)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Read the YAML list of tickers; a configuration file, so the driver parses it."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading the universe needs PyYAML; a JSON table with the same columns works too") from error

    text = "\n".join(row.value for row in spark.read.text(path, wholetext=True).collect())
    rows = []
    for entry in yaml.safe_load(text)["source-data"]["params"]:
        market, fundamentals = entry["market-data"], entry.get("fundamentals") or {}
        rows.append(
            (
                market["ticker"],
                market["company-name"],
                market.get("stock-series"),
                market.get("start-date"),
                market.get("end-date"),
                fundamentals.get("ticker"),
                bool(fundamentals.get("skip", False)),
            )
        )
    return spark.createDataFrame(rows, UNIVERSE_SCHEMA)


def read_universe_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UNIVERSE_SCHEMA).json(path)
