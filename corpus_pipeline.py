"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm import mixing, near, packing, pseudonyms, quality
from tickwise.llm.common import small_batches, stage
from tickwise.llm.queries import PSEUDONYM_KEY
from tickwise.sources.tables import read


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the quality rules reject.

    Null, empty and short texts are rejected; null languages and sources are groups of their own; repeated rows are judged alike.
    """
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the least id, of each group of near copies.

    Rows are documents whatever their ids, which may repeat or be null (null comes after all others). Texts without words, null ones too, are copies of each other.
    """
    return near.keep_one(docs, "doc_id", "text")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values by pseudonyms; n_chars follows the text. Null and empty texts stay as they are."""
    small_batches(spark)
    text = pseudonyms.pseudonymise(F.col("text"), PSEUDONYM_KEY)["text"]
    rows = docs.withColumn("text", text)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, three times at most.

    Rows that repeat or have no id are drawn each by itself. Null sources are a source; texts without words are drawn with what surrounds them.
    """
    return mixing.mixed(docs, "doc_id", "source", "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes. Rows of equal or null ids are packed each by itself; texts without words take no room."""
    return packing.pack(docs.select("doc_id", mixing.n_words("text").alias("n_words")), "doc_id", "n_words")


STAGES = [("quality", good), ("near_copies", distinct), ("pseudonyms", private), ("mixture", mix), ("packing", packed)]
#: Near copies, keyed permutations and best-fit packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
