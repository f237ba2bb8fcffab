"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm import collocations, lines, merkle, mixing, packing, pseudonyms, quality, sharding, simhash, templates, tokens, trie, warc
from tickwise.llm.common import small_batches, stage, text_or_empty
from tickwise.session import fresh_path
from tickwise.sources.tables import read

SHARDS = 40
TOKEN_LIMIT = 4096
PSEUDONYM_KEY = "tickwise-example-key"
RULES = [
    templates.Rule("org", "/", "allow"),
    templates.Rule("example.org", "/es/", "block"),
    templates.Rule("example.org", "/en/1", "block"),
    templates.Rule("com", "/fr/", "allow"),
    templates.Rule("com", "/de/", "block"),
]


def warc_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Writes the captures of all pages, reads the archives, and assembles the transactions."""
    path = fresh_path(spark, "warc")
    warc.write_archives(warc.captures(read(spark, d, "pages"), "page_id", "url", "html"), path)
    found = warc.read_archives(spark, path)
    found = found.withColumn("digest", F.when(F.col("type") == "response", warc.sha1_base32(F.col("body"))).otherwise(F.substring_index("digest", ":", -1)))
    rows = warc.assemble(stage(found, "warc-records"))
    number = lambda name: F.regexp_extract(name, r":(-?\d+):", 1).try_cast("long")
    return rows.filter(F.col("response").isNotNull()).select(
        number(F.col("capture")).alias("page_id"),
        F.col("response.body_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        number(F.col("response.refers_to")).alias("refers_to"),
        F.size("requests").alias("n_requests"),
        F.size("metadata").alias("n_metadata"),
    )


def best_fit(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return packing.pack(docs.select("doc_id", mixing.n_words("text").alias("n_words")), "doc_id", "n_words")


def rendezvous(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    sized = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty("text")) + 16).cast("long").alias("size"),
        F.crc32(text_or_empty("text")).alias("text_crc32"),
    )
    placed = sharding.assign(sized, ["doc_id"], [1.0] * SHARDS, [1.0] * (SHARDS + 1), keep=["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def digest_cache(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    tokenizer = tokens.Tokenizer.load(public_tokenizers.path("piece_bpe_32k.model"))
    counted = tokens.token_counts(read(spark, d, "documents"), "doc_id", "text", tokenizer, fresh_path(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def merkle_trees(spark: SparkSession, d: str) -> DataFrame:
    rows = merkle.beside_next(read(spark, d, "documents"), "doc_id", "text", merkle.edited_rows, merkle.EDITED)
    return rows.withColumnRenamed("key", "doc_id")


def path_templates(spark: SparkSession, d: str) -> DataFrame:
    """Pages are named by a document's number; the document's label is the page's."""
    labels = read(spark, d, "labels").groupBy(F.col("doc_id").alias("n")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    pages = read(spark, d, "pages").select("page_id", "url")
    number = F.regexp_extract(templates.host_and_path(F.col("url"))[1], r"/(\d{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long")
    labelled = pages.join(labels, number == F.col("n"), "left")
    return templates.judge(labelled, "page_id", "url", "good", RULES).drop("template")


def mix(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    sized = stage(docs.select("doc_id", "source", mixing.n_words("text").alias("size")), "sizes")
    drawn = mixing.draws(sized, "doc_id", "source", "size")
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"))


def feistel(spark: SparkSession, d: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, d, "documents")
    return docs.select("doc_id", pseudonyms.pseudonymise(F.col("text"), PSEUDONYM_KEY).alias("p")).select("doc_id", "p.*")


def near_copies(spark: SparkSession, d: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, d, "documents")
    prints = stage(docs.select("doc_id", simhash.fingerprint(F.col("text"), words=3).alias("fp")), "fingerprints-of-rows")
    found = simhash.classes(prints, "doc_id", "fp")
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def adaptive_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    rows = stage(quality.with_measures(docs, "text").select("doc_id", "lang", "source", "measures"), "measures")
    limits = quality.thresholds(quality.sketches(rows, "measures", "lang", "source", quality.Rules()))
    return quality.judged(rows, "measures", "lang", "source", limits).select("doc_id", "measures.*", "base_failed", "kept")


def prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    """Groups of five conversations share their first turns, up to eight of them."""
    return trie.trie(read(spark, d, "conversations"), "conv_id", "turn", "role", "text", rebuild=(5, 9))


def phrases(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(read(spark, d, "documents"), "text", "lang")


def line_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = lines.without_common(read(spark, d, "documents").select("doc_id", "text"), "text", "lines")
    return rows.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text"), 256).alias("kept_sha256"))


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


QUERIES = {
    "op1_warc_transactions": warc_transactions,
    "op2_best_fit_packing": best_fit,
    "op3_rendezvous_shards": rendezvous,
    "op4_digest_cache": digest_cache,
    "op5_merkle_trees": merkle_trees,
    "op6_path_templates": path_templates,
    "op7_mixture": mix,
    "op8_pseudonyms": feistel,
    "op9_simhash": near_copies,
    "op10_adaptive_rules": adaptive_rules,
    "op11_prefix_trie": prefix_trie,
    "op12_collocations": phrases,
    "op13_line_dedup": line_dedup,
}
