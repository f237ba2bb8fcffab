import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickwise.llm import queries, sharding
FOLDER = "/root/testdata/sf0.001"


def test_more_shards_take_rows_only_into_themselves(spark, docs):
    rows = queries.rendezvous(spark, FOLDER).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_weights_and_changes(spark):
    df = spark.range(40_000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r for r in sharding.assign(df, ["doc_id"], [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 1.0], keep=["doc_id"]).collect()}
    share = Counter(r.shard for r in before.values())
    assert abs(share[1] / 40_000 - 0.5) < 0.02 and abs(share[0] / 40_000 - 0.25) < 0.02
    moved = [r for r in before.values() if r.shard != r.grown_shard]
    assert all(r.grown_shard == 3 for r in moved) and abs(len(moved) / 40_000 - 0.2) < 0.02
    heavier = {r.doc_id: r.shard for r in sharding.assign(df, ["doc_id"], [1.0, 3.0, 1.0], keep=["doc_id"]).collect()}
    assert all(heavier[k] in (r.shard, 1) for k, r in before.items())


def test_number_of_partitions_does_not_matter(spark, odd):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(str, sharding.assign(odd, ["doc_id"], [1.0] * 3, keep=["doc_id", "text"]).collect()))

    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert rows("3") == rows("17")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_odd_rows(odd, none):
    out = sharding.assign(odd, ["doc_id"], [1.0] * 4, [1.0] * 5, keep=["doc_id", "text", "slot"]).collect()
    assert len(out) == odd.count()
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    assert sharding.assign(none, ["doc_id"], [1.0], keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(odd, ["doc_id"], [])


def test_one_shard(odd):
    assert {r.shard for r in sharding.assign(odd, ["doc_id"], [1.0], keep=["doc_id"]).select(F.col("shard")).collect()} == {0}
