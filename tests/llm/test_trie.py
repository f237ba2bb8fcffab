import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tickwise.llm import queries, trie

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v, key=lambda x: (x[:2], hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()))] for c, v in found.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, held in members.items():
        below = [x for x in members if x[: len(node)] == node]
        inner = {x[:-1] for x in below if x}
        ends = ",".join(map(str, sorted(c for c in held if len(convs[c]) == len(node))))
        out.append((
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), sum(len(x) == len(node) + 1 for x in below), sum(x not in inner for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_query_finds_what_brute_force_finds(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.prefix_trie(spark, FOLDER)) == brute(rebuilt(conversations(rows)))


@pytest.fixture(scope="module")
def many():
    """Few distinct turns, one first turn in most conversations, many equal conversations, one long one."""
    draw = random.Random(5)
    rows = []
    for c in range(0, 240):
        n = draw.choice([1, 2, 3, 4, 5])
        turns = ["hot"] + [draw.choice("ab") for _ in range(n - 1)] if c % 3 else ["x", "y", "z"] if c % 2 else [draw.choice("pq") * 4 for _ in range(n)]
        rows += [(c * 3, t, "user" if t % 2 else None, x) for t, x in enumerate(turns)]
    rows += [(1000, t, "user", "hot" if t == 0 else "ab"[t % 2]) for t in range(700)] + [(1001, None, "user", str(t)) for t in range(60)]
    return rows


@pytest.mark.parametrize("shard, partitions", [(1, 5), (7, 3), (4096, 1)])
def test_shards_merge_to_one_trie(spark, many, shard, partitions):
    df = spark.createDataFrame(many, "conv long, turn long, role string, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        turns = trie.numbered(df, "conv", "turn", "role", "text")
        got = rows_of(trie.nodes(trie.whole(turns), shard, 50 if shard > 1 else 1 << 16))
        again = rows_of(trie.nodes(trie.rebuilt(turns, 5, 9), shard))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    convs = conversations(many)
    assert got == brute(convs)
    assert again == brute(rebuilt(convs))


def test_turns_are_numbered_in_blocks(spark):
    rows = [(1, t, "r", str(t)) for t in range(2000, 0, -1)] + [(1, None, "r", f"n{t}") for t in range(300)] + [(1, -5, "r", "less"), (None, 1, "r", "lost")]
    got = trie.numbered(spark.createDataFrame(rows, "c long, t long, r string, x string"), "c", "t", "r", "x")
    seen = got.orderBy("pos").collect()
    assert [r.pos for r in seen] == list(range(2301))
    said = [bytes(r.digest) for r in seen]
    assert said[300] == hashlib.md5(b"1:rless").digest() and said[301:] == [hashlib.md5(f"1:r{t}".encode()).digest() for t in range(1, 2001)]


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "x"), (None, 0, "user", "y"), (2, 0, "", ""), (2, 0, "", ""), (2, 1, "user", "x" * 70_000), (3, None, "user", "x"), (-4, 0, "u", "ü")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.withColumns({c: F.lit("x") for c in ("conv", "pos", "digest", "bytes", "len", "n", "h", "base", "node", "block", "shard", "depth")})
    assert rows_of(trie.trie(clash, "conv_id", "turn", "role", "text")) == brute(conversations(rows))
    assert rows_of(trie.trie(clash.filter("false"), "conv_id", "turn", "role", "text", (5, 9))) == []
    assert rows_of(trie.trie(clash.filter("conv_id IS NULL"), "conv_id", "turn", "role", "text")) == []
    turnless = [(7, 0, "u", "only")]
    got = rows_of(trie.trie(spark.createDataFrame(turnless, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text", (5, 9)))
    assert got == brute(rebuilt(conversations(turnless)))
