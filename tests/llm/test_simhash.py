import random
import re

import pytest
import xxhash

from tickwise.llm import near, queries, simhash
FOLDER = "/root/testdata/sf0.001"


def brute_print(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, distance):
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = list(root)
    for i, a in enumerate(items):
        for b in items[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {x: find(x) for x in items}


def test_fingerprints_and_components(spark, docs):
    got = {r.doc_id: r for r in queries.near_copies(spark, FOLDER).collect()}
    prints = {r.doc_id: brute_print(r.text, 3) for r in docs.collect()}
    roots = brute_components(set(prints.values()), 2)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


@pytest.mark.parametrize("pair_limit", [1, 4, 1000])
def test_links_connect_what_is_close(spark, pair_limit):
    """Large and small blocks alike, with chains of close fingerprints."""
    draw = random.Random(5)
    prints = set()
    for _ in range(12):
        x = draw.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(draw.choice([1, 2, 2, 3])):
                x ^= 1 << draw.randrange(64)
    prints |= {0, 1, 3, (1 << 64) - 1, 1 << 63}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    found = simhash.links(fps, pair_limit=pair_limit)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in found.collect())
    got = {r.node: r.root for r in simhash.components(found).collect()}
    want = brute_components({signed(x) & (1 << 64) - 1 for x in prints}, 2)
    groups = {}
    for x, r in want.items():
        groups.setdefault(r, set()).add(signed(x))
    mine = {}
    for x in map(signed, prints):
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    assert all(r == min(members) for r, members in mine.items())


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_near_copies_match_exact_similarity(spark, docs):
    """All pairs with a similarity of 0.8 or more over five-word shingles, against the stage's groups."""
    sets = {r.doc_id: frozenset(simhash.shingle_hashes(r.text or "", 5, 42).tolist()) for r in docs.collect()}
    base = "the quick brown fox jumps over a lazy dog while rain falls on seven tall grey stones beside".split()
    draw = random.Random(3)
    words = [f"{draw.choice(base)}{draw.randrange(500)}" for _ in range(400)]
    extra = []
    for i in range(60):
        copy = list(words)
        for _ in range(draw.randrange(9)):
            copy[draw.randrange(400)] = f"other{i}"
        extra.append((10_000 + i, " ".join(copy)))
    sets |= {i: frozenset(simhash.shingle_hashes(t, 5, 42).tolist()) for i, t in extra}
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    assert {r.id: r.group for r in near.groups(rows, "doc_id", "text").collect()} == {i: find(i) for i in sets}
    assert sorted(r.doc_id for r in near.keep_one(rows, "doc_id", "text").collect()) == sorted({find(i) for i in sets})


def test_odd_rows(odd, none):
    prints = odd.select("doc_id", simhash.fingerprint(odd["text"], 3).alias("fp"))
    found = simhash.classes(prints, "doc_id", "fp").collect()
    assert len(found) == odd.count()
    assert {r.component_id for r in found if r.fp == 0} == {3}
    kept = near.keep_one(odd, "doc_id", "text")
    assert kept.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == ["1", "3", "5", "7", "7", "None"]
    assert near.keep_one(none, "doc_id", "text").count() == 0
    assert simhash.classes(none.select("doc_id", simhash.fingerprint(none["text"], 3).alias("fp")), "doc_id", "fp").count() == 0
