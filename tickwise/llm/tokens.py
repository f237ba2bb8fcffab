"""Token counts through a cache keyed by digests of the content and of the tokenizer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm.common import small_batches, stage, text_or_empty

CACHE_SCHEMA = "version string, digest string, n_tokens long"


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer file by its bytes; ``version`` is their digest, so another file never shares counts."""

    kind: str
    data: bytes

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, "rb") as f:
            return cls("sentencepiece" if path.endswith(".model") else "tokenizers", f.read())

    @property
    def version(self) -> str:
        return hashlib.sha256(self.kind.encode() + b"|" + self.data).hexdigest()


@lru_cache(maxsize=2)
def counter(tokenizer: Tokenizer):
    """texts -> counts, without tokens at begin or end."""
    if tokenizer.kind == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=tokenizer.data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer as Fast

    fast = Fast.from_str(tokenizer.data.decode())
    fast.no_truncation()
    fast.no_padding()
    return lambda texts: [len(x.ids) for x in fast.encode_batch(texts, add_special_tokens=False)]


def content_digest(text: Column) -> Column:
    """Digest of the normalised text. Normalising must not change counts, so it only makes null the empty text."""
    return F.sha2(text_or_empty(text), 256)


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for a tokenizer; a digest that two runs appended counts once."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        stored = spark.range(0).selectExpr("'' AS version", "'' AS digest", "id AS n_tokens")
    return stored.filter(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def encode_misses(df: DataFrame, text: str, tokenizer: Tokenizer, path: str) -> None:
    """Counts the texts whose digests the cache lacks, each distinct text once, and appends them.

    Copies collapse where they are read, then each digest's text moves once, to
    the partition in which the cache is looked up.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(shared.value)
        version = shared.value.version
        for batch in batches:
            counts = []
            texts = batch["text"].tolist()
            for i in range(0, len(texts), 64):
                counts += count(texts[i : i + 64])
            yield pd.DataFrame({"version": version, "digest": batch["digest"], "n_tokens": pd.Series(counts, dtype="int64")})

    rows = df.select(content_digest(F.col(text)).alias("digest"), text_or_empty(text).alias("text"))
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, path, tokenizer.version), "digest", "left_anti")
    misses.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(path)


def token_counts(df: DataFrame, key: str, text: str, tokenizer: Tokenizer, path: str) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row of ``df``, by way of the cache at ``path``.

    Null texts count as empty. Only digests travel when all texts are known: misses are
    looked for first, and texts are read only if there are any. Counts are those of the time of the call. Rows of equal
    key are all returned. The cache may be appended to by several runs at once.
    """
    spark = df.sparkSession
    digests = df.select(F.col(key).alias("__key"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), content_digest(F.col(text)).alias("digest"))
    unknown = digests.select("digest").join(read_cache(spark, path, tokenizer.version), "digest", "left_anti")
    if not unknown.isEmpty():
        encode_misses(df, text, tokenizer, path)
    # a stored table is shuffled on its own, so that the join can split a digest that many rows share
    known = stage(read_cache(spark, path, tokenizer.version), "token-counts", narrow=True)
    return digests.join(known, "digest").select(F.col("__key").alias(key), "n_bytes", "n_tokens")
