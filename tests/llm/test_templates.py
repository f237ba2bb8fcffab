import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickwise.llm import queries, templates
from tickwise.sources.tables import read

FOLDER = "/root/testdata/sf0.001"


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_for(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def brute(rows, rules, settings):
    """rows: (key, url, good) -> key -> (host, path, rule, verdict)"""
    parsed = []
    for key, url, good in rows:
        host, path = split_url(url)
        for sign, code in zip("*|{}", ("%2A", "%7C", "%7B", "%7D")):
            path_ = (path_ if sign != "*" else path).replace(sign, code)
        words = re.sub(r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{12,}(?![0-9A-Za-z])", "{h}", path_)
        parts = re.sub("[0-9]+", "{n}", words).split("/")
        if len(parts) > settings.depth + 1:
            parts = parts[: settings.depth] + ["/".join(parts[settings.depth :])]
        parsed.append((key, host, path, tuple(parts), good))
    template = {(h, s): "" for _, h, _, s, _ in parsed}
    for level in range(1, max((len(s) for _, s in template), default=0)):
        children = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for _, h, _, s, good in parsed:
            if len(s) > level:
                counts = children[h, template[h, s]][s[level]]
                if good is not None:
                    counts[0 if good else 1] += 1
        steps = {}
        for place, below in children.items():
            all_good, all_bad = (sum(x[i] for x in below.values()) for i in (0, 1))
            labels, sums = {}, defaultdict(lambda: [0, 0])
            for name, (good, bad) in below.items():
                n, total = good + bad, all_good + all_bad
                across = n * (total - n) * all_good * all_bad
                if across and total * (good * (all_bad - bad) - bad * (all_good - good)) ** 2 / across >= settings.apart:
                    labels[name] = f"*{good * 64 // n:02d}"
                    sums[labels[name]][0] += good
                    sums[labels[name]][1] += bad
            names = sorted(sums)
            merged = templates.merge_branches(names, [sums[x][0] for x in names], [sums[x][1] for x in names], settings.chi_square)
            steps[place] = {name: merged[label] for name, label in labels.items()}
        for h, s in list(template):
            if len(s) > level:
                place = (h, template[h, s])
                template[h, s] += "/" + steps[place].get(s[level], "*")
    stats, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for _, h, _, s, good in parsed:
        if good is not None:
            stats[h, template[h, s]][not good] += 1
            hosts[h][not good] += 1
    g, b = (sum(x[i] for x in hosts.values()) for i in (0, 1))
    overall, m = (g + 1) / (g + b + 2), settings.prior
    out = {}
    for key, h, path, s, _ in parsed:
        base = (hosts[h][0] + m * overall) / (sum(hosts[h]) + m)
        good, bad = stats[h, template[h, s]]
        rule = rule_for(h, path, rules)
        low = (good + m * base) / (good + bad + m) < settings.purity
        out[key] = (h, path, rule and rule.host + rule.path, rule.verdict if rule else "block" if low else "allow")
    return out


@pytest.mark.parametrize("settings", [templates.TreeSettings(), templates.TreeSettings(depth=2, apart=1.0, purity=0.8, prior=2.0)])
def test_verdicts_match_brute_force(spark, settings):
    pages = read(spark, FOLDER, "pages").select("page_id", "url").withColumn("good", F.when(F.col("page_id") % 3 < 2, F.col("page_id") % 5 != 0))
    rows = [(r.page_id, r.url, r.good) for r in pages.collect()]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in templates.judge(pages, "page_id", "url", "good", queries.RULES, settings).collect()}
    assert got == brute(rows, queries.RULES, settings)


def test_bad_section_is_rejected(spark):
    rows = [(i, f"http://a.net/{'spam' if i % 2 else 'news'}/{i}", i % 2 == 0 if i % 3 else None) for i in range(200)]
    rows += [(1000 + i, f"http://a.net/tag/{chr(97 + i % 26)}{chr(97 + i // 26)}", True) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    got = {r.page_id: r for r in templates.judge(df, "page_id", "url", "good").collect()}
    assert {got[i].verdict for i in range(1, 200, 2)} == {"block"} and {got[i].verdict for i in range(0, 200, 2)} == {"allow"}
    assert {got[1000 + i].template.rsplit("/", 1)[1] for i in range(60)} == {"*"}


def test_alike_siblings_merge():
    merged = templates.merge_branches(["a", "b", "c", "d"], [50, 48, 2, 0], [5, 4, 50, 0], 2.706)
    assert merged == {"a": "a|b", "b": "a|b", "c": "c", "d": "d"}


def test_urls(spark):
    urls = [None, "", "example.org/x", "HTTP://EXAMPLE.org", "http://example.org/es/1", "x://b.example.org/en/12?q#f", "x://notexample.org/es/", "x://h:80?a/b", "x://org/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("good", F.lit(None).cast("boolean"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in templates.judge(df, "page_id", "url", "good", queries.RULES).collect()}
    assert got == brute([(i, u, None) for i, u in enumerate(urls)], queries.RULES, templates.TreeSettings())
    assert got[3][:3] == ("example.org", "", None) and got[4][2:] == ("example.org/es/", "block") and got[6][2:] == ("org/", "allow")


def test_odd_rows(odd, none):
    rows = odd.withColumn("good", F.lit(True)).withColumn("host", F.lit("x")).withColumn("template", F.lit("x"))
    assert templates.judge(rows, "doc_id", "text", "good").count() == odd.count()
    assert templates.judge(none.withColumn("good", F.lit(True)), "doc_id", "text", "good").count() == 0


@pytest.mark.parametrize("sections", [23, 24, 60])
def test_a_bad_section_is_rejected_among_any_number(spark, sections):
    """Further sections don't change the verdicts of a section's pages; a long tail of rare ones is still one branch."""
    words = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(sections)]
    rows = [(w, True, i) for w in words for i in range(20)] + [("spam", False, i) for i in range(300)]
    rows += [(f"rare{w}", True, 0) for w in words] * (sections > 24)
    df = spark.createDataFrame([(k, f"http://a.net/{w}/{i}", good) for k, (w, good, i) in enumerate(rows)], "page_id long, url string, good boolean")
    got = {r.page_id: r for r in templates.judge(df, "page_id", "url", "good").collect()}
    assert {(rows[k][0] == "spam", r.verdict) for k, r in got.items()} == {(True, "block"), (False, "allow")}
    if sections > 24:
        assert {got[k].template.split("/")[1] for k, (w, _, _) in enumerate(rows) if w.startswith("rare")} == {"*"}


def test_many_bad_sections_are_rejected(spark):
    """More sections stand apart than are listed by name."""
    words = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(120)]
    rows = [(w, j % 3 > 0, i) for j, w in enumerate(words) for i in range(40)]
    df = spark.createDataFrame([(k, f"http://a.net/{w}/{i}", good) for k, (w, good, i) in enumerate(rows)], "page_id long, url string, good boolean")
    got = {r.page_id: r.verdict for r in templates.judge(df, "page_id", "url", "good").collect()}
    assert all(got[k] == ("allow" if good else "block") for k, (_, good, _) in enumerate(rows))


def test_verdicts_stay_while_siblings_grow(spark):
    """A section with seven bad pages beside sections that are good to four fifths, from 5 of them to 200."""
    for sections in (5, 24, 25, 200):
        words = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(sections)]
        rows = [(w, i > 0, i) for w in words for i in range(5)] + [("spam", False, i) for i in range(7)]
        df = spark.createDataFrame([(k, f"http://a.net/{w}/{i}", good) for k, (w, good, i) in enumerate(rows)], "page_id long, url string, good boolean")
        got = {r.page_id: r.verdict for r in templates.judge(df, "page_id", "url", "good").collect()}
        assert {(rows[k][0] == "spam", v) for k, v in got.items()} == {(True, "block"), (False, "allow")}, sections


def test_signs_of_templates_in_paths_are_just_letters(spark):
    rows = [("*", False, i) for i in range(20)] + [(f"good{chr(97 + j)}", True, i) for j in range(30) for i in range(3)] + [("*00", True, 0), ("a|b", True, 0), ("{n}", True, 0)]
    df = spark.createDataFrame([(k, f"http://a.net/{w}/p{i}", good) for k, (w, good, i) in enumerate(rows)], "page_id long, url string, good boolean")
    got = {r.page_id: r for r in templates.judge(df, "page_id", "url", "good").collect()}
    assert {(rows[k][0] == "*", r.verdict) for k, r in got.items()} == {(True, "block"), (False, "allow")}
    assert {got[k].path for k, (w, _, _) in enumerate(rows) if w == "a|b"} == {"/a|b/p0"}
