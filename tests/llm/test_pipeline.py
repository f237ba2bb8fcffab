from collections import Counter

import pytest

import corpus_pipeline
from tickwise.llm import near, pseudonyms, quality, queries
from tickwise.llm.common import stage

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, docs):
    out, rows = {}, docs
    for name, step in corpus_pipeline.STAGES:
        before = rows
        rows = stage(step(spark, rows, FOLDER), f"test-{name}")
        out[name] = before, rows
    return out


def test_columns(steps, docs):
    for name, (_, after) in list(steps.items())[:-1]:
        assert after.columns == docs.columns and after.count() > 0


def test_quality(steps):
    before, after = steps["quality"]
    kept = {r.doc_id for r in quality.keep_good(before).collect()}
    assert sorted(map(tuple, after.collect())) == sorted(tuple(r) for r in before.collect() if r.doc_id in kept)


def test_one_of_each_group(steps):
    before, after = steps["near_copies"]
    least = {r.group for r in near.groups(before, "doc_id", "text").collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(least)


def test_pseudonyms(steps):
    before, after = steps["pseudonyms"]
    swap = pseudonyms.Pseudonymiser(queries.PSEUDONYM_KEY)
    want = {r.doc_id: swap(r.text)[0] for r in before.collect()}
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_mixture(steps):
    before, after = steps["mixture"]
    size = {r.doc_id: len(r.text.encode().split()) for r in before.collect()}
    times = Counter(r.doc_id for r in after.collect())
    assert max(times.values()) <= 3 and set(times) <= set(size)
    assert abs(sum(size[i] * n for i, n in times.items()) - sum(size.values())) <= 20 * max(size.values())


def test_packing(steps):
    before, after = steps["packing"]
    words = Counter()
    for r in before.collect():
        words[r.doc_id] += len(r.text.encode().split())
    packed = Counter()
    for r in after.collect():
        packed[r.doc_id] += r.length
    assert packed == words


def test_run_gives_the_last_stage(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, steps["packing"][1].collect()))


def test_empty_table(spark, docs):
    rows = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        rows = stage(step(spark, rows, FOLDER), "test-empty")
    assert rows.count() == 0


def test_odd_rows(spark, odd):
    """Nulls, empty and long texts, repeated rows and ids, columns named like results: no crash, defined results."""
    rows = odd.withColumns({"row": odd.doc_id, "sha": odd.doc_id, "words": odd.doc_id, "of": odd.doc_id, "drawn": odd.doc_id, "draw": odd.doc_id, "__gone": odd.doc_id, "__id": odd.doc_id})
    seen = {}
    for name, step in corpus_pipeline.STAGES[1:]:
        before = rows
        rows = stage(step(spark, rows, FOLDER), f"odd-{name}")
        seen[name] = rows
        assert name == "packing" or rows.columns == before.columns
    assert sorted(str(r.doc_id) for r in seen["near_copies"].collect()) == ["1", "3", "5", "7", "7", "None"]
    assert seen["pseudonyms"].count() == 6
    assert max(Counter(r.text for r in seen["mixture"].collect()).values()) <= 3
    kept = corpus_pipeline.STAGES[0][1](spark, odd, FOLDER)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {5}
