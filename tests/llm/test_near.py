"""Near copies against brute force, for edits of several kinds."""

import random

from tickwise.llm import near


def shingles(text, words=5):
    tokens = text.lower().split()
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))}


def brute(texts):
    """id -> the least id that pairs with a Jaccard similarity of 0.8 lead to."""
    sets = {i: shingles(x) for i, x in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a]) >= 0.8 * len(sets[b]) and len(sets[b]) >= 0.8 * len(sets[a]):
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def grouped(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.id: r.group for r in near.groups(df, "doc_id", "text").collect()}


def words(draw, n):
    return [f"w{draw.randrange(40_000)}" for _ in range(n)]


def test_a_repeated_phrase_is_a_copy(spark):
    draw = random.Random(5)
    texts = {}
    for i in range(40):
        text = words(draw, 250)
        at = draw.randrange(250)
        texts[2 * i] = " ".join(text)
        texts[2 * i + 1] = " ".join(text[:at] + words(draw, 5) * 20 + text[at:])
    want = brute(texts)
    assert all(want[2 * i + 1] == 2 * i for i in range(40))
    assert grouped(spark, texts) == want


def test_contiguous_edits_are_found(spark):
    """Truncated, appended and replaced passages at similarities of 0.80 to 0.92."""
    draw = random.Random(6)
    texts, kinds = {}, 3
    for i in range(90):
        text = words(draw, 300)
        cut = round(300 * (0.07 + 0.13 * (i // kinds) / 30))
        edited = [text[: 300 - cut], text + words(draw, cut), text[: 300 - cut // 2] + words(draw, cut // 2)][i % kinds]
        texts[2 * i], texts[2 * i + 1] = " ".join(text), " ".join(edited)
    want = brute(texts)
    assert sum(want[2 * i + 1] == 2 * i for i in range(90)) >= 85
    assert grouped(spark, texts) == want


def test_pairs_in_a_large_family_are_found(spark):
    """Hundreds of pages of a template, below 0.8 to each other, hold pairs that are near copies."""
    draw = random.Random(7)
    template, texts = words(draw, 300), {}
    for i in range(700):
        own = iter(words(draw, 60))
        text = template + list(own) if i % 2 else [w for j, x in enumerate(template) for w in ([x, next(own)] if j % 5 == 0 else [x])]
        texts[2 * i] = " ".join(text)
        if i % 5 == 0:
            for at in draw.sample(range(len(text)), 6):
                text[at] = f"x{draw.randrange(40_000)}"
            texts[2 * i + 1] = " ".join(text)
    want = brute(texts)
    assert sum(want[i] != i for i in want) >= 110
    assert grouped(spark, texts) == want


def test_members_far_from_the_centre_are_found(spark):
    """A family of copies in chains: each is near to the one before alone, and many share all places."""
    draw = random.Random(8)
    base, texts = words(draw, 200), {}
    for chain in range(30):
        text = list(base)
        for at in range(8):
            for x in draw.sample(range(200), 3):
                text[x] = f"y{draw.randrange(40_000)}"
            texts[8 * chain + at] = " ".join(text)
    want = brute(texts)
    assert grouped(spark, texts) == want


def test_rows_are_documents_whatever_their_ids(spark):
    """Repeated and null ids: one row of each group stays, and both texts of an id keep their links."""
    draw = random.Random(9)
    one, two, three = (words(draw, 60) for _ in range(3))
    edit = lambda text: " ".join([*text[:-1], "edited"])
    rows = [(5, " ".join(three)), (5, " ".join(three)), (None, " ".join(three)), (None, edit(three))]
    rows += [(1, " ".join(one)), (1, " ".join(two)), (2, edit(one)), (3, edit(two)), (None, "alone"), (None, "alone"), (None, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS sha", "3 AS root", "4 AS __gone", "5 AS id").repartition(3)
    kept = near.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert got == sorted([("5", " ".join(three)), ("1", " ".join(one)), ("1", " ".join(two)), ("None", "alone"), ("9", "")])
    assert sorted((str(r.id), str(r.group)) for r in near.groups(df, "doc_id", "text").collect()) == sorted(
        [("5", "5")] * 2 + [("None", "5")] * 2 + [("1", "1")] * 2 + [("2", "1"), ("3", "1")] + [("None", "None")] * 2 + [("None", "9"), ("9", "9")]
    )


def test_filters_and_bitmaps_lose_nothing(spark, docs):
    """Full filters let everything through; the result is the same."""
    rows = docs.selectExpr("doc_id AS id", "coalesce(text, '') AS text", "unhex(sha2(coalesce(text, ''), 256)) AS sha")
    seen = near.prints(rows, 5, 0.8).cache()
    found = near.listing(seen).collect()
    listed = {r.digest: set(r.key) for r in found}
    order = {r.digest: list(r.keys) for r in seen.collect()}
    assert all(r.key == [order[r.digest][i] for i in r.pos] for r in found)
    texts = {}
    for r in seen.collect():
        texts[r.digest] = set(r.keys)
    count = {}
    for keys in texts.values():
        for k in keys:
            count[k] = count.get(k, 0) + 1
    for digest, keys in texts.items():
        assert {k for k in keys if count[k] > 1} <= listed.get(digest, set()) <= keys
    few, parts = near.repeated(seen, 8)
    assert parts == 4 and all(len(b) == 1 for b in few.values())
    found = near.shingle_set(docs.first().text, 5)
    assert (near._unpacked_set(near._packed_set(found)) == found >> 16).all() and len(near._unpacked_set(near._packed_set(found[:0]))) == 0


def test_close_fingerprints_are_candidates_and_sets_take_one_python_step(spark):
    draw = random.Random(10)
    texts = [words(draw, 400) for _ in range(30)]
    edited = [[*text[:-1], "edited"] for text in texts]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts + edited)], "id long, text string")
    seen = near.prints(df.selectExpr("*", "unhex(sha2(text, 256)) AS sha"), 5, 0.8)
    classes = seen.selectExpr("id AS node", "digest", "fp").cache()
    fps = {r.node: r.fp & (1 << 64) - 1 for r in classes.collect()}
    want = {(i, i + 30) for i in range(30) if (fps[i] ^ fps[i + 30]).bit_count() <= 2}
    assert len(want) > 20
    pairs = near.close(classes.select("node", "fp"))
    assert {(r.a, r.b) for r in pairs.collect()} == want
    steps = []
    stage, near.stage = near.stage, lambda x, name, *more: steps.append(x) or stage(x, name, *more)
    try:
        sets = near.sets_of(pairs, classes.select("node", "digest"), df.select("text"), 5)
    finally:
        near.stage = stage
    plan = steps[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "ArrowEvalPython" not in plan
    found = {r.node: r.shingles for r in sets.collect()}
    assert found.keys() == {x for p in want for x in p}
    assert all((near._unpacked_set(found[i]) == near.shingle_set(" ".join(texts[i]), 5) >> 16).all() for i, _ in want)
