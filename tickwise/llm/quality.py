"""Quality rules with thresholds taken from quantile sketches per language and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.llm.common import BLANK_RUN, BLANKS, bind, stage, text_or_empty

SYMBOLS = "[^#*$%&|<>]+"


def measures(text: Column) -> Column:
    """One struct of counts over the whole text; null counts as empty.

    n_words, word_chars (code points within words), n_symbols, n_dup_lines (lines with
    a word that equal an earlier line), n_repeat_words (words that lie in a
    three-word window found twice or more). Windows are compared by 64-bit hashes
    within one text.
    """
    text = text_or_empty(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return bind(
        F.array_remove(F.split(text, BLANK_RUN), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
            bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            F.when(F.size(w) > 3, _repeated_words(w)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        ),
    )


def _repeated_words(words: Column) -> Column:
    """Sorts the hashes of all windows, each packed with its position; equal neighbours repeat.

    A long holds the position and as much of the hash as fits beside it, so the
    upper and the lower part of the hash are sorted apart; a window repeats if it
    does in both.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def in_both(h: Column, width: Column) -> Column:
        shift = F.call_function

        def positions(part) -> Column:
            packed = F.transform(h, lambda x, i: part(x).bitwiseOR(i.cast("long")))
            return bind(F.sort_array(packed), repeated)

        def repeated(s: Column) -> Column:
            # the hash parts of two numbers are equal if the numbers differ in the position's bits alone
            same = lambda x, y: F.coalesce(shift("shiftright", x.bitwiseXOR(y), width) == 0, F.lit(False))
            beside = F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1)))
            return F.transform(beside, lambda x: x.bitwiseAND(shift("shiftleft", F.lit(1).cast("long"), width) - 1))

        upper = positions(lambda x: shift("shiftleft", shift("shiftrightunsigned", x, width + 1), width))
        lower = positions(lambda x: shift("shiftrightunsigned", shift("shiftleft", x, width + 1), F.lit(1)))
        return bind(upper, lambda u: F.when(F.size(u) > 0, F.sort_array(F.array_intersect(u, lower))).otherwise(u))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, j + 1) - x, F.lit(3).cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return bind(
        hashes,
        lambda h: bind(bind(F.length(F.bin(F.size(h))), lambda width: in_both(h, width)), covered),
    )


# --- adaptive thresholds ----------------------------------------------------

#: What a rule looks at: a count per thousand words, and whether too little fails as well.
RATIOS = {"word_chars": True, "n_symbols": False, "n_dup_lines": False, "n_repeat_words": False}


@dataclass(frozen=True)
class Rules:
    """Parameters; ratios are counts per thousand words, rounded down.

    With the quartiles of its group, a ratio fails beyond ``q50 + width * max(q75 - q50,
    q50 - q25, floor)``, and word_chars below ``q50 - width * ...`` too. Groups of fewer than
    ``min_rows`` rows take the merged sketch of their language, or else that of all rows.
    ``floors`` keep a group of equal texts from rejecting what differs a little.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    min_rows: int = 50
    width: int = 6
    floors: tuple[int, ...] = (300, 20, 10, 50)


def base_failed(m: Column, rules: Rules) -> Column:
    return (m["n_words"] < rules.min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * rules.max_repeat_percent)


def _ratio(m: Column, name: str) -> Column:
    return F.floor(m[name] * 1000 / F.greatest(m["n_words"], F.lit(1))).cast("long")


def _edge(ratio: Column) -> Column:
    """The lower edge of a ratio's bin: its six leading bits, so a bin is at most a 32nd wide."""
    drop = F.greatest(F.length(F.bin(ratio)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", ratio, drop), drop)


def sketches(df: DataFrame, measured: str, lang: str, source: str, rules: Rules) -> DataFrame:
    """Quantile sketches of the ratios: (lang, source, ratio, edge, n), merged by adding the counts.

    Rows that fail the base rules stay out. Rows are counted where they are read
    and only counts move, so a source may hold any share of the rows.
    """
    m = F.col(measured)
    ratios = F.array(*[F.struct(F.lit(x).alias("ratio"), _edge(_ratio(m, x)).alias("edge")) for x in RATIOS])
    return (
        df.filter(~base_failed(m, rules))
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(ratios).alias("r"))
        .groupBy("lang", "source", "r.ratio", "r.edge")
        .agg(F.count("*").alias("n"))
    )


def _quartiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of the bins that hold the quartiles, and the rows of the group."""
    merged = bins.groupBy(*keys, "ratio", "edge").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "ratio")
    counted = merged.select(
        *keys, "ratio", "edge",
        F.sum("n").over(group.orderBy("edge").rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(group).alias("rows"),
    )
    quarter = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * k, F.col("edge")))
    return counted.groupBy(*keys, "ratio").agg(
        F.first("rows").alias("rows"), F.struct(quarter(1).alias("q25"), quarter(2).alias("q50"), quarter(3).alias("q75")).alias("q")
    )


def thresholds(bins: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per lang and source with its limits: low_<ratio> (word_chars alone) and high_<ratio>."""
    own = _quartiles(bins, ["lang", "source"])
    of_lang = _quartiles(bins, ["lang"]).select(F.col("lang").alias("l"), F.col("ratio").alias("lr"), F.col("rows").alias("lrows"), F.col("q").alias("lq"))
    of_all = _quartiles(bins, []).select(F.col("ratio").alias("ar"), F.col("q").alias("aq"))
    chosen = (
        own.join(of_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("lr")))
        .join(of_all, F.col("ratio") == F.col("ar"))
        .withColumn(
            "q",
            F.when(F.col("rows") >= rules.min_rows, F.col("q")).when(F.col("lrows") >= rules.min_rows, F.col("lq")).otherwise(F.col("aq")),
        )
    )
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in zip(RATIOS, rules.floors) for x in kv]), F.col("ratio"))
    reach = F.greatest(F.col("q.q75") - F.col("q.q50"), F.col("q.q50") - F.col("q.q25"), floor) * rules.width
    limits = chosen.select("lang", "source", "ratio", (F.col("q.q50") - reach).alias("low"), (F.col("q.q50") + reach).alias("high"))
    of = lambda side, x: F.max(F.when(F.col("ratio") == x, F.col(side))).alias(f"{side}_{x}")
    return limits.groupBy("lang", "source").agg(
        *[of("high", x) for x in RATIOS], *[of("low", x) for x, both in RATIOS.items() if both]
    )


def judged(df: DataFrame, measured: str, lang: str, source: str, limits: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``df`` with base_failed and kept (columns of these names are replaced).

    A row is kept if it passes the base rules and all ratios lie within the
    limits of its lang and source; nulls in these are groups of their own. A row whose group
    has no limits (all its rows fail the base rules) isn't kept, for it fails them too.
    """
    m = F.col("__row")[measured]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))
    joined = packed.join(
        limits, F.col("__row")[lang].eqNullSafe(limits["lang"]) & F.col("__row")[source].eqNullSafe(limits["source"]), "left"
    )
    passes = F.lit(True)
    for x, both in RATIOS.items():
        passes = passes & (_ratio(m, x) <= F.col(f"high_{x}"))
        if both:
            passes = passes & (_ratio(m, x) >= F.col(f"low_{x}"))
    failed = base_failed(m, rules)
    return joined.select(
        *[F.col("__row")[c].alias(c) for c in df.columns if c.lower() not in ("base_failed", "kept")],
        failed.alias("base_failed"),
        (~failed & F.coalesce(passes, F.lit(False))).alias("kept"),
    )


def with_measures(df: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    return df.withColumn(into, measures(F.col(text)))


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", rules: Rules = Rules(), measured: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` that the rules keep, unchanged. ``measured``: the rows with ``with_measures``, if they are stored already.

    Otherwise rows are measured twice, once for the sketches and once to be judged, and no copy of the texts is stored.
    """
    if measured is None:
        # beside a row number, which isn't used, Spark doesn't move conditions in front of the measures, where they would be evaluated again
        measured = with_measures(df, text, "__measures").withColumn("__row_number", F.monotonically_increasing_id())
    # a stored table of few rows goes to the texts, which stay where they are
    limits = stage(thresholds(sketches(measured, "__measures", lang, source, rules), rules), "limits")
    return judged(measured, "__measures", lang, source, limits, rules).filter("kept").select(*[f"`{c}`" for c in df.columns])
