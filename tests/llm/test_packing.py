import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickwise.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"
CAPACITIES = (512, 1024, 2048, 4096, 8192)


def brute(lengths, capacities, cost_of):
    """Best-fit decreasing item by item, with the operator's choice of the size to open: contents of the bins."""
    lengths = sorted(lengths, reverse=True)
    bins = []
    left = Counter(lengths)

    def rate(capacity, length, items):
        room = capacity - min(capacity // length, items) * length
        for n in sorted((n for n in left if n < length), reverse=True):
            fits = min(room // n, left[n])
            room -= fits * n
        content = capacity - room
        return cost_of(next(c for c in sorted(capacities) if c >= content)) / content

    for length in sorted(left, reverse=True):
        items = left.pop(length)
        while items:
            open_ = [b for b in bins if b[0] >= length]
            if not open_:
                size = min((c for c in capacities if c >= length), key=lambda c: (rate(c, length, items), c))
                bins += [[size, []] for _ in range(-(-items // (size // length)))]
                continue
            best = min(open_, key=lambda b: b[0])
            best[0] -= length
            best[1].append(length)
            items -= 1
    return sorted(tuple(sorted(x)) for _, x in bins)


def contents(counts, capacities, cost_of=packing.cost):
    bins = packing.Bins(counts, capacities, cost_of).run()
    found = defaultdict(list)
    for length, rank, first, each, offset in bins.slots:
        following = [s[1] for s in bins.slots if s[0] == length and s[1] > rank]
        until = min(following, default=counts[length])
        for q in range(until - rank):
            found[first + q // each].append((offset + q % each * length, length))
    assert sorted((n, *x) for n, found in bins.placed(counts).items() for x in found) == sorted(
        {(n, r, b, e, o, c) for n, found in bins.placed(counts).items() for r, b, e, o, c in found}
    )
    sizes = {first + i: content for first, n, content in bins.filled for i in range(n)}
    for number, items in found.items():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at == sizes[number]
    return sorted(tuple(sorted(n for _, n in x)) for x in found.values())


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_histogram_packing_is_best_fit_decreasing(counts):
    capacities = (10, 25, 40)
    lengths = [n for n, c in counts.items() for _ in range(c)]
    assert contents(counts, capacities) == brute(lengths, capacities, packing.cost)


def test_rows_lie_in_their_bins(spark, docs):
    rows = queries.best_fit(spark, FOLDER).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.best_fit(spark, FOLDER).collect()))
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
        by_bin[r.bin, r.capacity].append((r.offset, r.length))
    assert {d: sum(n for _, n in x) for d, x in by_doc.items()} == {d: n for d, n in words.items() if n}
    for spans in (by_doc, by_bin):
        for x in spans.values():
            at = 0
            for start, n in sorted(x):
                assert start == at
                at += n
    assert len({b for b, _ in by_bin}) == len(by_bin)
    for (_, capacity), x in by_bin.items():
        assert capacity == min(c for c in CAPACITIES if c >= sum(n for _, n in x))
    got = sorted(tuple(sorted(n for _, n in x)) for x in by_bin.values())
    assert got == brute([r.length for r in rows], CAPACITIES, packing.cost)


def test_cost_decides_the_size(spark):
    df = spark.range(162).select(F.col("id").alias("doc_id"), F.lit(100).alias("n"))
    wide = packing.pack(df, "doc_id", "n", cost_of=lambda c: 1000.0 + c).collect()
    narrow = packing.pack(df, "doc_id", "n", cost_of=lambda c: float(c * c)).collect()
    assert {r.capacity for r in wide} == {8192} and max(r.capacity for r in narrow) == 512


def test_waste_is_small():
    draw = random.Random(1)
    counts = Counter(min(8192, int(draw.lognormvariate(5.5, 1.1)) + 1) for _ in range(50_000))
    bins = packing.Bins(counts, CAPACITIES).run()
    used = sum(n * c for n, c in counts.items())
    opened = sum(bins.downsized(content) * n for _, n, content in bins.filled if content)
    assert used / opened > 0.99


def test_odd_rows(odd, none):
    df = odd.withColumn("n", F.when(F.col("doc_id") == 5, F.lit(60_000)).when(F.col("doc_id") == 4, F.lit(None)).otherwise(F.lit(7)))
    rows = packing.pack(df, "doc_id", "n").collect()
    assert sum(r.length for r in rows if r.doc_id == 5) == 60_000 and sum(r.doc_id == 5 for r in rows) == 8
    assert sum(r.doc_id is None for r in rows) == 2 and not any(r.doc_id == 4 for r in rows)
    assert packing.pack(none.withColumn("n", F.lit(1)), "doc_id", "n").count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc_id", "n", [])
