"""URL filter: rules first, then path templates per host, judged by their labelled pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import bind, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class TreeSettings:
    """``depth``: segments that are looked at one by one, what follows is one more. ``apart``: the chi-square from which a
    child's labels differ from those of all its siblings (6.635: one per cent). ``chi_square``: branches whose labels differ less are one
    (2.706: ten per cent). ``prior``: pages that the host's purity counts as, and all pages' for the host. ``purity``: the least
    share of good pages."""

    depth: int = 5
    apart: float = 6.635
    chi_square: float = 2.706
    prior: float = 8.0
    purity: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters in lower case) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together) and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name = F.when(fits, F.lit(r.host + r.path)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def shape(path: Column, depth: int) -> Column:
    """The path's segments with runs of digits as {n} and long hexadecimal words as {h}; what lies deeper than ``depth`` is one segment.

    Signs that stand for something in a template are written as in urls where a path has them itself.
    """
    for sign, code in zip("*|{}", ("%2A", "%7C", "%7B", "%7D")):
        path = F.replace(path, F.lit(sign), F.lit(code))
    words = F.regexp_replace(path, "(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{12,}(?![0-9A-Za-z])", "{h}")
    general = F.regexp_replace(words, "[0-9]+", "{n}")
    return bind(
        F.split(general, "/"),
        lambda s: F.when(F.size(s) <= depth + 1, s).otherwise(
            F.concat(F.slice(s, 1, depth), F.array(F.array_join(F.slice(s, depth + 1, F.size(s)), "/")))
        ),
    )


def merge_branches(names: list[str], good: list[int], bad: list[int], limit: float) -> dict[str, str]:
    """Joins siblings whose shares of good pages don't differ: those next to each other by
    share, the closest pair first, while its chi-square is below ``limit``. Maps each to the names of its branch.

    Siblings without labels say nothing and stay by themselves.
    """
    rows = sorted((g / (g + b), n, g, b) for n, g, b in zip(names, good, bad) if g + b)
    groups = [([n], g, b) for _, n, g, b in rows]

    def apart(x, y) -> float:
        (_, g1, b1), (_, g2, b2) = x, y
        n = g1 + b1 + g2 + b2
        across = (g1 + b1) * (g2 + b2) * (g1 + g2) * (b1 + b2)
        return n * (g1 * b2 - g2 * b1) ** 2 / across if across else 0.0

    while len(groups) > 1:
        score, at = min((apart(groups[i], groups[i + 1]), i) for i in range(len(groups) - 1))
        if score >= limit:
            break
        (n1, g1, b1), (n2, g2, b2) = groups[at : at + 2]
        groups[at : at + 2] = [(n1 + n2, g1 + g2, b1 + b2)]
    out = {n: n for n in names}
    for members, _, _ in groups:
        label = "|".join(sorted(members))
        out.update(dict.fromkeys(members, label))
    return out


#: Children that stand apart are told apart by their share of good pages in so many steps.
STEPS = 64


def standing_apart(children: DataFrame, settings: TreeSettings) -> DataFrame:
    """(host, template, segment, label, good, bad): children whose labels differ from those of all others of their place.

    The rule is the same for any number of children: one child's labels against the others' sum. Children are labelled by their share of good pages.
    """
    totals = children.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    good, bad, g, b = (F.col(x).cast("double") for x in ("good", "bad", "g", "b"))
    n, total = good + bad, g + b
    across = n * (total - n) * g * b
    score = F.when(across > 0, total * F.pow(good * (b - bad) - bad * (g - good), 2) / across).otherwise(0.0)
    share = F.format_string("*%02d", F.floor(good * STEPS / n).cast("int"))
    kept = children.join(totals, ["host", "template"]).filter(score >= settings.apart)
    return kept.select("host", "template", "segment", share.alias("label"), "good", "bad")


def grow_tree(shapes: DataFrame, settings: TreeSettings) -> DataFrame:
    """``shapes`` (host, shape, n, good, bad; one row each) with a column ``template``.

    Level by level: the children of a place that stand apart go by their share of good pages, and shares that don't differ are
    joined; all other children are variable, ``*``. So a place's list has at most ``STEPS`` + 1 entries whatever its children are. Hosts and places are
    aggregated where they are read; a host's shapes are never gathered.
    """

    @F.pandas_udf("map<string,string>")
    def merged(names: pd.Series, good: pd.Series, bad: pd.Series) -> pd.Series:
        return pd.Series([merge_branches(list(n), list(g), list(b), settings.chi_square) for n, g, b in zip(names, good, bad)], dtype=object)

    deepest = shapes.agg(F.max(F.size("shape"))).first()[0] or 0
    tree = shapes.withColumn("template", F.lit(""))
    for level in range(2, deepest + 1):
        segment = F.get("shape", F.lit(level - 1))
        children = tree.filter(segment.isNotNull()).groupBy("host", "template", segment.alias("segment")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        apart = stage(standing_apart(stage(children, "url-children"), settings), "url-apart")
        sums = apart.groupBy("host", "template", "label").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        lists = sums.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("label", "good", "bad"))).alias("x"))
        names = lists.select("host", "template", merged("x.label", "x.good", "x.bad").alias("names"))
        branch = apart.join(names, ["host", "template"]).select("host", "template", "segment", F.element_at("names", F.col("label")).alias("branch"))
        same = (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (segment == F.col("s"))
        tree = tree.join(branch.toDF("h", "t", "s", "branch"), same, "left")
        step = F.concat("template", F.lit("/"), F.coalesce("branch", F.lit("*")))
        tree = tree.withColumn("template", F.when(segment.isNull(), F.col("template")).otherwise(step))
        tree = stage(tree.drop("h", "t", "s", "branch"), "url-tree")
    return tree


def judge_templates(tree: DataFrame, settings: TreeSettings) -> DataFrame:
    """(host, shape, template, purity, rejected): purity is smoothed towards the host's, that towards all pages'."""
    stats = tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    hosts = stats.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    total = hosts.agg(F.sum("g"), F.sum("b")).first()
    overall = ((total[0] or 0) + 1) / ((total[0] or 0) + (total[1] or 0) + 2)
    m = settings.prior
    hosts = hosts.select("host", ((F.col("g") + F.lit(m * overall)) / (F.col("g") + F.col("b") + F.lit(m))).alias("base"))
    purity = (F.col("good") + F.col("base") * m) / (F.col("good") + F.col("bad") + F.lit(m))
    judged = stats.join(hosts, "host").select("host", "template", purity.alias("purity"))
    return tree.join(judged, ["host", "template"]).select("host", "shape", "template", "purity", (F.col("purity") < settings.purity).alias("rejected"))


def judge(
    pages: DataFrame, key: str, url: str, good: str, rules: Sequence[Rule] = (), settings: TreeSettings = TreeSettings()
) -> DataFrame:
    """(key, host, path, rule, verdict, template) of every row; ``good`` is true, false, or null for pages without a label.

    A rule decides where one fits, otherwise the verdict is block if the template's smoothed purity is too
    low, else allow. Templates are learnt from all pages. Null urls have the empty host and path and a template of their own; repeated
    rows count as often as they occur.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("__key"), host.alias("host"), path.alias("path"), F.col(good).alias("__good"))
    rows = rows.withColumn("shape", shape(F.col("path"), settings.depth))
    shapes = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("__good"), 1)).alias("good"),
        F.count(F.when(~F.col("__good"), 1)).alias("bad"),
    )
    judged = judge_templates(grow_tree(stage(shapes, "url-shapes"), settings), settings)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(judged, ["host", "shape"]).select(
        F.col("__key").alias(key),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
        "template",
    )
