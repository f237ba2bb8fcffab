from hashlib import sha256

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickwise.llm import merkle, queries

FOLDER = "/root/testdata/sf0.001"
TEXTS = st.text(alphabet="ab.!? \n\u00e9", max_size=120)


def brute(rows):
    rows = sorted(rows)
    out = {}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        a, b, c = (merkle.Tree(x).printed for x in (text, changed, after))
        out[key] = (len(text), sha256(changed.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, c))
    return out


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_each_document_meets_the_next(spark, docs, partitions):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: tuple(r)[1:] for r in queries.merkle_trees(spark, FOLDER).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got == brute([(r.doc_id, r.text or "") for r in docs.collect()])


@given(TEXTS, TEXTS)
def test_roots_test_equality(a, b):
    x, y = merkle.Tree(a).printed, merkle.Tree(b).printed
    assert (x == y) == (a == b)
    assert (merkle.likeness(x, y) == 1.0) == (a == b) and 0 <= merkle.likeness(x, y) <= 1
    assert merkle.likeness(x, y) == merkle.likeness(y, x)
    assert merkle.Tree(a, {}).printed == x


@given(TEXTS)
def test_leaves_make_up_the_text(text):
    assert "".join(s for p in merkle.PARAGRAPHS.findall(text) for s in merkle._sentences(p)) == text


def test_differences_locate_edits():
    text = "One is here. Two is here.\nThree is here.\n\nFour is here. Five is here.\n"
    a = merkle.Tree(text).printed
    assert merkle.differences(a, a) == []
    b = merkle.Tree(text.replace("Five", "Six")).printed
    found = merkle.differences(a, b)
    assert len(found) == 1 and found[0][1:] == (0, 1) and found[0][0] > 0
    assert merkle.differences(a, merkle.Tree(text + "New.").printed)[-1:] != []
    assert 0.5 < merkle.likeness(a, b) < 1


def test_long_runs_take_linear_time():
    for text in ("!" * 300_000, "a. " * 100_000, "x" * 300_000, "\n" * 100_000, " " * 300_000):
        merkle.Tree(text)


def test_columns(spark):
    df = spark.createDataFrame([("a. b.", "a. c."), (None, "")], "x string, y string")
    df = df.select(merkle.fingerprint(F.col("x")).alias("x"), merkle.fingerprint(F.col("y")).alias("y"))
    rows = df.select(merkle.like(F.col("x"), F.col("y")).alias("l"), merkle.edits(F.col("x"), F.col("y")).alias("e")).collect()
    assert 0 < rows[0].l < 1 and [tuple(x) for x in rows[0].e] == [(0, 0, 1)] and rows[1].l == 1.0 and rows[1].e == []


def test_odd_rows(spark, odd, none):
    rows = merkle.beside_next(odd, "doc_id", "text", merkle.edited_rows, merkle.EDITED).collect()
    assert len(rows) == odd.count() and sum(r.key is None for r in rows) == 2
    assert merkle.beside_next(none, "doc_id", "text", merkle.edited_rows, merkle.EDITED).count() == 0
    one = spark.createDataFrame([(9, "abcd")], "doc_id long, text string")
    row = merkle.beside_next(one, "doc_id", "text", merkle.edited_rows, merkle.EDITED).first()
    assert row.edited_sha256 == sha256(b"abab").hexdigest() and row.near_next == 1.0
