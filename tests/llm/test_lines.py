import hashlib

import numpy as np
import pytest

from tickwise.llm import lines, queries

FOLDER = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(texts, min_docs, min_chars=1):
    of = [[key_of(x) for x in (t or "").split("\n")] for t in texts]
    seen = {}
    for keys in of:
        for k in set(keys):
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t, keys in zip(texts, of):
        kept = [x for x, k in zip((t or "").split("\n"), keys) if len(k) < min_chars or seen[k] < min_docs]
        out.append((len(keys), len(keys) - len(kept), "\n".join(kept)))
    return out


def test_a_perfect_hash_numbers_its_keys_and_tells_others():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    rows[1:4, 0] = rows[0, 0]
    rows[5:9, 1] = rows[4, 1]
    perfect = lines.PerfectHash.build(rows)
    assert sorted(perfect.numbers(rows)) == list(range(5000))
    others = perfect.numbers(rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64))
    assert ((others >= -1) & (others < 5000)).all()
    assert (lines.PerfectHash.build(rows[:0]).numbers(rows) == -1).all()
    assert len(perfect.bits) * 64 < 4.5 * 5000


def test_the_query_drops_what_brute_force_drops(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for r, (n, gone, t) in zip(rows, brute([r.text for r in rows], 10))}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.line_dedup(spark, FOLDER).collect()}
    assert got == want and any(gone for _, gone, _ in want.values())


@pytest.mark.parametrize("send_bytes", [lines.SEND_BYTES, -1])
@pytest.mark.parametrize("min_docs, min_chars", [(2, 1), (3, 4), (1, 1)])
def test_arrays_sent_and_lines_sent_agree_with_brute_force(spark, send_bytes, min_docs, min_chars):
    texts = ["Ab\ncd\n\n ef \t", "AB \r\nx\nx\nx", "x", None, "", "ab\nÄ\nä", "ÄÄÄÄ\nääää\nÄÄÄÄ", " ÄÄÄÄ\x0b", "ÄÄÄÄ", "ab"] + ["common line\nown %d" % i for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(7)
    got = lines.without_common(df, "text", "out", min_docs, min_chars, send_bytes, shard_lines=5).collect()
    assert {r.id: tuple(r.out) for r in got} == dict(enumerate(brute(texts, min_docs, min_chars)))


@pytest.mark.parametrize("send_bytes", [lines.SEND_BYTES, -1])
def test_odd_rows(spark, odd, none, send_bytes):
    rows = odd.withColumn("lines", odd.doc_id).withColumn("number", odd.doc_id).withColumn("common", odd.doc_id)
    out = lines.without_common(rows, "text", "lines of it", 2, send_bytes=send_bytes)
    assert out.columns == [*rows.columns, "lines of it"] and out.count() == rows.count()
    got = sorted((r.text or "", *r["lines of it"]) for r in out.collect())
    texts = [r.text for r in rows.collect()]
    assert got == sorted((t or "", *b) for t, b in zip(texts, brute(texts, 2)))
    assert lines.without_common(none, "text", "out", send_bytes=send_bytes).collect() == []


def test_thresholds_are_bounded(odd):
    with pytest.raises(ValueError):
        lines.without_common(odd, "text", "out", 0)
