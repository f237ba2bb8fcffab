import re
from collections import Counter

from pyspark.sql import functions as F

from tickwise.llm import quality


def want(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(docs, odd):
    for df in (docs, odd):
        for r in quality.with_measures(df.select("text"), into="m").collect():
            assert tuple(r.m) == want(r.text)


def test_overlapping_windows(spark):
    texts = ["a a a a", "a b c a b c", "a b c d a b c", "a b", "", "x y z\n\nx y z\n \n", "a b a b a"]
    for r in quality.with_measures(spark.createDataFrame([(t,) for t in texts], "text string"), into="m").collect():
        assert tuple(r.m) == want(r.text), r.text


def brute_limits(rows, rules):
    def edge(v):
        drop = max(v.bit_length() - 6, 0)
        return v >> drop << drop

    def quartiles(values):
        values = sorted(values)
        return [next(v for i, v in enumerate(values) if 4 * (i + 1) >= k * len(values)) for k in (1, 2, 3)]

    out = {}
    for i, name in enumerate(quality.RATIOS):
        of = lambda keep: [edge(r.m[name] * 1000 // r.m["n_words"]) for r in rows if keep(r)]
        for lang, source in {(r.lang, r.source) for r in rows}:
            own, in_lang = of(lambda r: (r.lang, r.source) == (lang, source)), of(lambda r: r.lang == lang)
            q25, q50, q75 = quartiles(own if len(own) >= rules.min_rows else in_lang if len(in_lang) >= rules.min_rows else of(lambda r: True))
            reach = max(q75 - q50, q50 - q25, rules.floors[i]) * rules.width
            out[lang, source, name] = q50 - reach, q50 + reach
    return out


def test_rules_match_brute_force(docs):
    rules = quality.Rules(min_rows=8)
    measured = quality.with_measures(docs, into="m").cache()
    limits = quality.thresholds(quality.sketches(measured, "m", "lang", "source", rules), rules)
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judged(measured, "m", "lang", "source", limits, rules).collect()}
    rows = measured.collect()
    failed = {r.doc_id: r.m.n_words < 50 or 100 * r.m.n_repeat_words > 50 * r.m.n_words for r in rows}
    bounds = brute_limits([r for r in rows if not failed[r.doc_id]], rules)

    def kept(r):
        if failed[r.doc_id]:
            return False
        for name, both in quality.RATIOS.items():
            low, high = bounds[r.lang, r.source, name]
            v = r.m[name] * 1000 // r.m.n_words
            if v > high or (both and v < low):
                return False
        return True

    assert got == {r.doc_id: (failed[r.doc_id], kept(r)) for r in rows}


def test_sketches_merge(docs):
    measured = quality.with_measures(docs, into="m")
    rules = quality.Rules()
    whole = quality.sketches(measured, "m", "lang", "source", rules)
    halves = [quality.sketches(measured.filter(F.col("doc_id") % 2 == k), "m", "lang", "source", rules) for k in (0, 1)]
    merged = halves[0].unionByName(halves[1])
    assert sorted(map(str, quality.thresholds(whole).collect())) == sorted(map(str, quality.thresholds(merged).collect()))


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.keep_good(docs).join(labels, "doc_id")
    measured = quality.with_measures(docs, into="m").filter(~quality.base_failed(F.col("m"), quality.Rules())).join(labels, "doc_id")
    share = lambda df, q: df.filter(F.col("quality") == q).count()
    assert share(kept, 1) >= 0.98 * share(measured, 1)
    assert share(kept, 0) <= 0.3 * share(labels, 0)


def test_odd_rows(odd, none):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    measured = quality.with_measures(odd, into="m")
    limits = quality.thresholds(quality.sketches(measured, "m", "lang", "source", quality.Rules()))
    judged = quality.judged(measured, "m", "lang", "source", limits)
    assert judged.count() == odd.count() and judged.filter("kept is null or base_failed is null").count() == 0
    assert quality.keep_good(none).count() == 0
