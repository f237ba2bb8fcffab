import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickwise.llm import collocations as co
from tickwise.llm import queries

FOLDER = "/root/testdata/sf0.001"


def brute(rows, longest, least, cover, top):
    counts = {}
    for lang, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = tuple(re.findall("[^ \t]+", piece))
            for size in range(1, longest + 1):
                f.update(words[i : i + size] for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = []
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in frequent.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
            if any(inside(q) and 100 * b >= cover * a for q, b in frequent.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_the_query_finds_what_brute_force_finds(spark, docs):
    want = brute([(r.lang, r.text) for r in docs.collect()], 3, 10, 50, 2000)
    assert rows_of(queries.phrases(spark, FOLDER)) == want and len(want) > 100


@pytest.mark.parametrize("longest, least, cover, top, text_bytes", [(3, 2, 50, 5, 1), (4, 3, 80, 100, 200), (2, 1, 50, 7, 1 << 20)])
def test_parts_and_settings_agree_with_brute_force(spark, docs, longest, least, cover, top, text_bytes):
    few = docs.orderBy("doc_id").limit(25)
    got = rows_of(co.collocations(few.repartition(3), "text", "lang", longest, least, cover, top, text_bytes))
    assert got == brute([(r.lang, r.text) for r in few.collect()], longest, least, cover, top)


def test_full_filters_only_let_more_through(spark, docs):
    texts = docs.selectExpr("coalesce(lang, 'und') AS lang", "cast(text AS binary) AS text")
    seen = []
    for most in (8, 1 << 20):
        filters = co.summaries(texts, [2, 3], 10, 4, most, 5000, 100)
        seen.append({(r.lang, r.phrase, r.f) for r in co.counted(texts, [2, 3], filters, 4, 10).collect()})
    assert seen[0] == seen[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=80), max_size=6), st.integers(1, 9))
def test_a_summary_misses_nothing_frequent(parts, threshold):
    mass = sum(map(len, parts))
    summary, merged = co.Summary(mass // threshold + 1, 10), co.Summary(mass // threshold + 1)
    for part in parts:
        prints, counts = np.unique(np.array(part, np.uint32), return_counts=True)
        summary.add(prints, counts)
        merged.add(prints, counts)
        merged.merge()
    true = Counter(x for part in parts for x in part)
    for s in (summary, merged):
        assert {x for x, n in true.items() if n >= threshold} <= set(s.reaching(threshold).tolist())
        assert len(s.prints) <= s.capacity and s.taken < threshold
        left = dict(zip(s.prints.tolist(), s.counts.tolist()))
        assert all(left.get(x, 0) <= n <= left.get(x, 0) + s.taken for x, n in true.items())


@given(st.lists(st.integers(0, (1 << 32) - 1)))
def test_packed_numbers_come_back(numbers):
    data = np.sort(np.array(numbers, np.uint32))
    assert (co.unpacked(co.packed(data)) == data).all()


def test_odd_rows(spark, odd, none):
    clash = odd.withColumns({c: odd.doc_id for c in ("phrase", "f", "part", "a", "l", "r", "n", "score", "words")})
    got = rows_of(co.collocations(clash, "text", "lang", 3, 2))
    assert got == brute([(r.lang, r.text) for r in odd.collect()], 3, 2, 50, 2000)
    assert co.collocations(none, "text", "lang").collect() == []
    assert co.collocations(odd.filter("text IS NULL OR doc_id = 6"), "text", "lang").collect() == []
