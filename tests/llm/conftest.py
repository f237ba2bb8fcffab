import pytest
from pyspark.sql import functions as F

from tickwise.sources.tables import read

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return read(spark, FOLDER, "documents").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like results."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "one two three. four five six!\nseven", "en", "a"),
        (1, "one two three. four five six!\nseven", "en", "a"),
        (2, "one two three. four five six!\nseven", "en", "a"),
        (3, "", None, None),
        (4, None, "en", None),
        (None, "call +1 (212) 555-0147 now", None, "b"),
        (None, None, None, None),
        (5, long_text, "de", "a"),
        (6, " \t\n ", "de", "b"),
        (7, "ünï cödé ß", "fr", "c"),
        (7, "another text of the same id", "fr", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["shard", "slot", "size", "kept", "base_failed", "digest", "bin", "draws", "target", "fp", "key", "capacity", "measures", "group", "id", "rank"]
    return df.withColumns({c: F.lit("x") for c in clash}).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter(F.lit(False))
