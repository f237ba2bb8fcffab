"""Merkle trees over the sections and paragraphs of a text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import shuffle_partitions, small_batches, text_or_empty

PARAGRAPHS = re.compile(r"[^\n]*\n|[^\n]+")
SENTENCE_END = re.compile(r"[.!?]\s+")
#: A paragraph whose digest's first byte is a multiple of this ends a section, as an empty line does.
SECTION = 8
#: Longer sentences are cut after this many characters.
LONGEST = 400
SHOWN = 4


def _sentences(paragraph: str) -> list[str]:
    cuts = [0, *(m.end() for m in SENTENCE_END.finditer(paragraph))]
    if cuts[-1] < len(paragraph):
        cuts.append(len(paragraph))
    return [paragraph[i : min(i + LONGEST, b)] for a, b in zip(cuts, cuts[1:]) for i in range(a, b, LONGEST)]


def _digest(parts) -> bytes:
    return blake2b(b"".join(parts), digest_size=16).digest()


class Tree:
    """Leaves are sentences with the white space behind them, so that the leaves together are the text.

    A paragraph's digest covers its leaves' digests, a section's its paragraphs',
    and the root's the sections'. The printed form has the root in full and the
    first bytes of each leaf: ``root:leaves,leaves/leaves``, ``,`` between paragraphs
    and ``/`` between sections. The empty text has a root and no leaves.
    """

    def __init__(self, text: str, known: dict[str, tuple[bytes, str]] | None = None):
        sections, paragraphs, shown, group = [], [], [], []
        for paragraph in PARAGRAPHS.findall(text):
            found = known.get(paragraph) if known is not None else None
            if found is None:
                leaves = [_digest([s.encode()]) for s in _sentences(paragraph)]
                found = _digest(leaves), "".join(x[:SHOWN].hex() for x in leaves)
                if known is not None:
                    known[paragraph] = found
            paragraphs.append(found[0])
            group.append(found[1])
            if found[0][0] % SECTION == 0 or not paragraph.strip():
                sections.append(_digest(paragraphs))
                shown.append(",".join(group))
                paragraphs, group = [], []
        if paragraphs:
            sections.append(_digest(paragraphs))
            shown.append(",".join(group))
        self.root = _digest(sections).hex()
        self.printed = f"{self.root}:{'/'.join(shown)}"


def _leaves(paragraph: str) -> list[str]:
    return [paragraph[i : i + 2 * SHOWN] for i in range(0, len(paragraph), 2 * SHOWN)]


def _branches(printed: str) -> tuple[str, list[list[str]]]:
    root, _, rest = printed.partition(":")
    return root, [s.split(",") for s in rest.split("/")] if rest else []


def _pair_off(left: list, right: list) -> tuple[list, list]:
    """What is left of each list when equal entries are paired off."""
    common = Counter(left) & Counter(right)
    mine, theirs = Counter(common), Counter(common)

    def rest(items, counts):
        out = []
        for x in items:
            if counts[x] > 0:
                counts[x] -= 1
            else:
                out.append(x)
        return out

    return rest(left, mine), rest(right, theirs)


def likeness(a: str, b: str) -> float:
    """Twice the shared leaves over all leaves of two printed trees; 1 for equal roots.

    Goes down the differing branches alone: equal sections, then equal paragraphs are paired off.
    """
    (root_a, sections_a), (root_b, sections_b) = _branches(a), _branches(b)
    if root_a == root_b:
        return 1.0
    size = lambda sections: sum(len(p) for s in sections for p in s) // (2 * SHOWN)
    total = size(sections_a) + size(sections_b)
    if not total:
        return 0.0
    left, right = _pair_off([",".join(s) for s in sections_a], [",".join(s) for s in sections_b])
    left, right = _pair_off(",".join(left).split(","), ",".join(right).split(","))
    mine = Counter(x for p in left for x in _leaves(p))
    theirs = Counter(x for p in right for x in _leaves(p))
    apart = sum((mine - theirs).values()) + sum((theirs - mine).values())
    return (total - apart) / total


def differences(a: str, b: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, leaf) of each leaf of ``b`` that ``a`` doesn't have, in order; none for equal roots."""
    (root_a, sections_a), (root_b, sections_b) = _branches(a), _branches(b)
    if root_a == root_b:
        return []
    have_sections = Counter(",".join(s) for s in sections_a)
    changed = []
    for i, s in enumerate(sections_b):
        if have_sections[",".join(s)] > 0:
            have_sections[",".join(s)] -= 1
        else:
            changed.append((i, s))
    rest = [p for s, n in have_sections.items() for p in s.split(",") for _ in range(n)]
    have, leaves = Counter(rest), Counter(x for p in rest for x in _leaves(p))
    found = []
    for i, s in changed:
        for j, p in enumerate(s):
            if have[p] > 0:
                have[p] -= 1
                leaves.subtract(_leaves(p))
                continue
            for k, x in enumerate(_leaves(p)):
                if leaves[x] > 0:
                    leaves[x] -= 1
                else:
                    found.append((i, j, k))
    return found


def fingerprint(text: Column) -> Column:
    """The printed tree of a text; null counts as empty."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([Tree(x or "").printed for x in texts], dtype=object)

    return of(text)


def like(a: Column, b: Column) -> Column:
    """``likeness`` of two columns of printed trees."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(p, q) for p, q in zip(x, y)], dtype="float64")

    return of(a, b)


def edits(a: Column, b: Column) -> Column:
    """``differences`` of two columns of printed trees."""

    @F.pandas_udf("array<struct<section:int,paragraph:int,leaf:int>>")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"section": i, "paragraph": j, "leaf": k} for i, j, k in differences(p, q)] for p, q in zip(x, y)], dtype=object)

    return of(a, b)


# --- each document beside the next ------------------------------------------

LEAST_ID = -(1 << 63)


def beside_next(df: DataFrame, key: str, text: str, body, schema: str) -> DataFrame:
    """``body(rows)`` over the rows of each range of keys; ``rows`` yields (key, text, next key, next text).

    The next row is that with the next key, the last row's is the first; rows of one
    key follow each other by text, null keys come first, null texts count as
    empty. Keys are cut into ranges of about equal counts; the first row of a
    range is also sent to the range before, so one shuffle of the texts is enough and no task holds more than its sort buffer.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST_ID)).alias("__key"), F.col(key).isNull().alias("__null"), text_or_empty(text).alias("__text"))
    ranges = 8 * shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("__key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).first()["c"]
    bounds = spark.sparkContext.broadcast(np.unique(np.array(cuts or [], np.int64)))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, keys.to_numpy(np.int64), "right").astype(np.int32))

    # at most one row a range, and the number of ranges is set above
    heads = sorted((r["n"], r["k"]) for r in rows.select(range_of("__key").alias("n"), "__key").groupBy("n").agg(F.min("__key").alias("k")).collect())
    before = spark.createDataFrame(
        pa.table({"head": pa.array([k for _, k in heads], pa.int64()), "before": pa.array([heads[i - 1][0] for i in range(len(heads))], pa.int32())})
    )
    own = F.struct(F.col("__range").alias("range"), F.lit(0).alias("extra"))
    sent = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("range"), F.lit(1).alias("extra"))))
    dealt = (
        rows.withColumn("__range", range_of("__key"))
        .join(F.broadcast(before), F.col("__key") == F.col("head"), "left")
        .select(F.explode(sent).alias("__to"), "__key", "__null", "__text")
        .select("__to.range", "__to.extra", "__key", "__null", "__text")
        .repartition("range")
        .sortWithinPartitions("range", "extra", "__key", "__text")
    )

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        last, done = None, False
        for batch in batches:
            for number, extra, k, null, value in zip(batch["range"], batch["extra"], batch["__key"], batch["__null"], batch["__text"]):
                row = (number, None if null else k, value)
                if last is not None and last[0] != number:
                    last, done = None, False
                if last is not None and not done:
                    yield last[1], last[2], row[1], row[2]
                done = bool(extra)
                if not extra:
                    last = row
                    done = False

    return dealt.mapInPandas(lambda batches: body(pairs(batches)), schema)


# --- a text against its edited form -----------------------------------------

EDITED = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_rows(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """For ``beside_next``: each text's tree beside that of its edited form and of the next text."""
    columns = [x.split()[0] for x in EDITED.split(", ")]
    out, size = [], 0
    text = known = tree = None
    for key, now, _, following in rows:
        if now != text or tree is None:
            known = {}
            tree = Tree(now, known)
        ahead: dict = {}
        follower = Tree(following, ahead)
        changed = edited(now, following)
        other = Tree(changed, {**ahead, **known})
        out.append((key, len(now), sha256(changed.encode()).hexdigest(), tree.printed, other.printed, likeness(tree.printed, other.printed), likeness(tree.printed, follower.printed)))
        size += len(now) + 200
        text, known, tree = following, ahead, follower
        if size > 1 << 23:
            yield pd.DataFrame(out, columns=columns)
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns)
