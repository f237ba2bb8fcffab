from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickwise.llm import mixing, queries

FOLDER = "/root/testdata/sf0.001"


@given(st.lists(st.tuples(st.integers(1, 10**9), st.sampled_from([1, 2, 5])), min_size=1, max_size=30))
def test_targets(pairs):
    sizes, weights = map(list, zip(*pairs))
    got = mixing.targets(sizes, weights, sum(sizes), 3)
    assert abs(sum(got) - sum(sizes)) < 1e-6 * sum(sizes)
    free = [t / w for t, s, w in zip(got, sizes, weights) if t < 3 * s]
    assert all(t <= 3 * s for t, s in zip(got, sizes))
    if free:
        assert max(free) - min(free) < 1e-9 * max(free)
        assert all(3 * s / w <= max(free) * (1 + 1e-9) for t, s, w in zip(got, sizes, weights) if t >= 3 * s)


@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 5))
def test_split_deals_every_block_once(blocks, shards, seed):
    quotas = mixing.split(blocks, shards, seed)
    assert quotas.sum(axis=1).tolist() == blocks and quotas.min() >= 0
    loads = quotas.sum(axis=0)
    assert loads.max() - loads.min() <= 1
    assert (mixing.split(blocks, shards, seed) == quotas).all()


def test_split_follows_the_hypergeometric_distribution():
    draws = np.array([mixing.split([30, 70], 4, seed)[0, 0] for seed in range(3000)])
    assert abs(draws.mean() - 7.5) < 0.15 and abs(draws.var() - 25 * 0.3 * 0.7 * 75 / 99) < 0.4


def test_query(spark, docs):
    rows = queries.mix(spark, FOLDER).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.mix(spark, FOLDER).collect()))
    sources = {r.doc_id: r.source for r in docs.collect()}
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        taken[sources[r.doc_id]] += r.taken
        size[sources[r.doc_id]] += r.size
        target[sources[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    biggest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= biggest for s in target)
    assert all(r.source_size == size[sources[r.doc_id]] for r in rows)
    assert abs(sum(target.values()) - sum(size.values())) < 1


def test_blocks_go_to_one_shard_each(spark):
    sized = spark.createDataFrame([(i, "ab"[i % 2], 10 + i % 7) for i in range(2000)], "doc_id long, source string, size long").cache()
    drawn = mixing.draws(sized, "doc_id", "source", "size", {"a": 3, "b": 1}, shards=8, block=500)
    rows = [(r.source, d.block, d.shard, r.size) for r in drawn.collect() for d in r.draws]
    place = {}
    for source, block, shard, _ in rows:
        assert place.setdefault((source, block), shard) == shard
    words = Counter()
    for _, _, shard, n in rows:
        words[shard] += n
    assert set(words) == set(range(8)) and max(words.values()) - min(words.values()) <= 2 * 500 + 4 * 16


def test_mixed_rows(spark, docs):
    out = mixing.mixed(docs, "doc_id", "source", "text")
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    want = {r.doc_id: r.taken // r.size for r in queries.mix(spark, FOLDER).collect() if r.size}
    assert {k: v for k, v in times.items() if k in want} == {k: v for k, v in want.items() if v}


def test_odd_rows(odd, none):
    sized = odd.select("doc_id", "source", mixing.n_words("text").alias("words")).cache()
    rows = mixing.draws(sized, "doc_id", "source", "words").collect()
    assert len(rows) == odd.count() and all(r.words == 0 or len(r.draws) <= 3 for r in rows)
    assert mixing.mixed(odd, "doc_id", "source", "text").columns == odd.columns
    assert mixing.draws(none.select("doc_id", "source", F.lit(1).alias("n")), "doc_id", "source", "n").count() == 0


def test_rows_that_share_a_key_are_drawn_by_themselves(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "ab"[i % 2], f"x{i} " * (5 + i % 4), i) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, row long")
    times = Counter(r.row for r in mixing.mixed(df, "doc_id", "source", "text").collect())
    assert max(times.values()) <= 3
    size = {row: len(text.split()) for _, _, text, row in rows}
    assert abs(sum(size[i] * n for i, n in times.items()) - sum(size.values())) <= 2 * max(size.values())


def test_a_repeated_row_changes_its_own_source_alone(spark):
    rows = [(i, "abc"[i % 3], f"x{i} " * (5 + i % 4)) for i in range(300)]
    frame = lambda some, n: spark.createDataFrame(some, "doc_id long, source string, text string").repartition(n)
    count = lambda df: Counter((r.doc_id, r.source) for r in mixing.mixed(df, "doc_id", "source", "text").collect())
    before = count(frame(rows, 3))
    more = [*rows, rows[3], rows[3], (None, "a", "null id"), (None, "a", "null id")]
    after = count(frame(more, 3))
    assert after == count(frame(more, 5))
    shares = lambda c, s: {k: n for k, n in c.items() if k[1] == s}
    assert {k[0] for k in after} <= {r[0] for r in more} and max(n for k, n in after.items() if k[0] not in (3, None)) <= 3
    changed = sum(before[k] != after[k] for k in before if k[1] != "a")
    assert changed <= 4 and len(shares(after, "b")) > 0  # targets move a little, since all sizes count


def test_equal_rows_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRIDE", 7)
    df = spark.createDataFrame([(1, "a", "w w w")] * 100 + [(i, "b", "w w w w") for i in range(2, 60)], "doc_id long, source string, text string").withColumns({"id": F.lit(1), "row": F.lit(2), "of": F.lit(3), "n": F.lit(4), "drawn": F.lit(5)})
    got = mixing.mixed(df, "doc_id", "source", "text")
    assert got.columns == df.columns
    sizes = Counter()
    for r in got.collect():
        sizes[r.source] += len(r.text.split())
    total = 300 + 58 * 4
    assert abs(sum(sizes.values()) - total) <= 8 and sizes["a"] <= 900 and sizes["b"] <= 3 * 232
