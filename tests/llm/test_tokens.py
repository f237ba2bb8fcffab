import public_tokenizers
import pytest
import sentencepiece

from tickwise.llm import queries, tokens
from tickwise.session import fresh_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.Tokenizer.load(public_tokenizers.path("piece_bpe_32k.model"))


def test_counts_are_the_library_s(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.digest_cache(spark, FOLDER).collect()}
    want = {i: (len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts.items()}
    assert got == want


def test_only_distinct_misses_are_encoded(spark, docs, tokenizer):
    path = fresh_path(spark, "test-cache")
    first = docs.filter("doc_id < 100")
    tokens.token_counts(first, "doc_id", "text", tokenizer, path).count()
    stored = spark.read.parquet(path)
    assert stored.count() == first.select("text").distinct().count()
    files = set(stored.inputFiles())
    tokens.token_counts(first, "doc_id", "text", tokenizer, path).count()
    assert set(spark.read.parquet(path).inputFiles()) == files
    rows = tokens.token_counts(docs, "doc_id", "text", tokenizer, path)
    assert rows.count() == docs.count()
    assert spark.read.parquet(path).count() == docs.select("text").distinct().count()
    again = spark.read.parquet(path)
    again.limit(20).write.mode("append").parquet(path)
    assert tokens.token_counts(docs, "doc_id", "text", tokenizer, path).count() == docs.count()


def test_another_tokenizer_has_its_own_counts(spark, docs, tokenizer):
    path = fresh_path(spark, "test-cache")
    fast = tokens.Tokenizer.load(public_tokenizers.path("byte_bpe_50k.json"))
    few = docs.limit(20).cache()
    a = {r.doc_id: r.n_tokens for r in tokens.token_counts(few, "doc_id", "text", tokenizer, path).collect()}
    b = {r.doc_id: r.n_tokens for r in tokens.token_counts(few, "doc_id", "text", fast, path).collect()}
    assert a != b and {r.doc_id: r.n_tokens for r in tokens.token_counts(few, "doc_id", "text", tokenizer, path).collect()} == a


def test_odd_rows(spark, odd, none, tokenizer):
    rows = tokens.token_counts(odd, "doc_id", "text", tokenizer, fresh_path(spark, "test-cache")).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.n_bytes == 0} == {0}
    assert tokens.token_counts(none, "doc_id", "text", tokenizer, fresh_path(spark, "test-cache")).count() == 0
