"""Phrase collocations: frequent word sequences found by Misra-Gries summaries, then counted exactly.

A first pass hashes every phrase of two to ``longest`` words and deals the hashes to partitions.
Each partition keeps a Misra-Gries summary of more counters than its mass divided by the threshold,
so a phrase that reaches the threshold can't be missing from it. Summaries of parts merge by
adding counters and taking the (k+1)-th largest from all. The second pass counts words, and
the phrases that the summaries let through, by their words and not by hashes.

Counts are per language; a null language is ``und``, null texts are empty. Repeated rows count each time.
Texts without words and empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickwise.llm.common import batch_bytes, shuffle_partitions, spread, stage, text_or_empty

#: Marks that end a piece become line ends, tabs become blanks.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
#: Bytes of text that a task handles at once, and of one split into words.
TEXT_BYTES, SPLIT_BYTES = 8 << 20, 1 << 20
#: Phrases in a partition of the summaries, about, and prints that wait there to be merged.
PARTITION_MASS, WAITING = 1 << 22, 1 << 21
#: Bits of a partition's filter for each hash in it, and of all filters together at most (32 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 28


# --- words of a chunk of text -----------------------------------------------


class Codes(dict):
    """Numbers words in the order in which they come; 0 is the end of a piece, 1 the empty word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


class Chunk:
    """Words of several texts of a language: ``at`` has their codes, with 0 where a piece or text ends."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.lang, codes, parts, i = lang, Codes(), [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < SPLIT_BYTES):
                size += len(texts[j])
                j += 1
            words = b"\n".join([*texts[i:j], b""]).lower().translate(ENDS).replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
            parts.append(found[found != 1])
            i = j
        self.at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.words = list(codes)

    def starts(self, size: int) -> np.ndarray:
        """Where phrases of ``size`` words begin."""
        n = len(self.at) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        whole = self.at[:n] != 0
        for k in range(1, size):
            whole &= self.at[k : n + k] != 0
        return np.flatnonzero(whole)

    def hashes(self, size: int, starts: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each phrase, which depends on its words and the language alone."""
        if not hasattr(self, "of_word"):
            self.of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        total = np.full(len(starts), xxhash.xxh3_64_intdigest(self.lang, seed=size), np.uint64)
        for k in range(size):
            total = _mixed(total + self.of_word[self.at[starts + k]])
        return total

    def counted(self, size: int, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The distinct phrases that begin at ``starts``, and how many of them do."""
        key = self.at[starts]
        for k in range(1, size):
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.words) + self.at[starts + k]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        begin = starts[first]
        columns = [[self.words[c] for c in self.at[begin + k].tolist()] for k in range(size)]
        return [b" ".join(words).decode("utf-8", "replace") for words in zip(*columns)], n


def chunks(batches: Iterator[pd.DataFrame], text_bytes: int) -> Iterator[Chunk]:
    """Texts of a task as chunks of one language and a bounded size each."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= text_bytes:
                yield from (Chunk(k, v) for k, v in held.items())
                held, size = {}, 0
    yield from (Chunk(k, v) for k, v in held.items())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# --- first pass: summaries --------------------------------------------------


class Summary:
    """Misra-Gries counters of 32-bit prints: true counts are at most ``taken`` above them.

    ``capacity`` counters; ``taken`` stays below (mass - what is left) / capacity.
    """

    def __init__(self, capacity: int, waiting: int = WAITING):
        self.capacity, self.taken, self.most_waiting = capacity, 0, max(capacity, waiting)
        self.prints, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, prints: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((prints, counts))
        self.n_waiting += len(prints)
        if self.n_waiting > self.most_waiting:
            self.merge()

    def merge(self) -> None:
        parts = [(self.prints, self.counts), *self.waiting]
        self.waiting, self.n_waiting = [], 0
        prints = np.concatenate([p for p, _ in parts])
        order = np.argsort(prints, kind="stable")  # parts are sorted, so this merges them
        prints = prints[order]
        first = np.flatnonzero(np.diff(prints, prepend=prints[:1] ^ np.uint32(1)))
        self.prints = prints[first]
        counts = np.add.reduceat(np.concatenate([c for _, c in parts])[order], first) if len(first) else np.zeros(0, np.int64)
        if len(counts) > self.capacity:
            least = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            left = counts > least
            self.prints, counts = self.prints[left], counts[left] - least
            self.taken += least
        self.counts = counts

    def reaching(self, threshold: int) -> np.ndarray:
        """The prints whose true count may be ``threshold`` or more; none that has it is missing."""
        self.merge()
        return self.prints[self.counts + self.taken >= threshold]


def packed(numbers: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as their differences, all lowest bytes first, so that high bytes compress to nothing."""
    return np.diff(numbers, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def slots(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a print in a filter of ``bits`` bits, a power of two."""
    mixed = _mixed(prints.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64(bits - 1)
    return (mixed & mask).astype(np.int64), ((mixed >> np.uint64(32)) & mask).astype(np.int64)


def summaries(texts: DataFrame, sizes: list[int], threshold: int, partitions: int, most_bits: int = MOST_BITS, text_bytes: int = TEXT_BYTES, waiting: int = WAITING) -> DataFrame:
    """(part, n_prints, taken, bits): for each partition of phrases a filter that lets all frequent ones through.

    A filter has a power of two of bits, at most ``most_bits`` for all partitions together; where that is
    few, it lets more phrases through, which the second pass counts and drops.
    """
    per_part = max(8, most_bits // partitions)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches, text_bytes):
            every = np.concatenate([chunk.hashes(k, chunk.starts(k)) for k in sizes])
            if not len(every):
                continue
            every.sort()
            distinct = np.flatnonzero(np.diff(every, prepend=every[:1] ^ np.uint64(1)))
            counts = np.diff(distinct, append=len(every))
            every = every[distinct]
            part = ((every >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)
            edges = np.searchsorted(part, np.arange(partitions + 1, dtype=np.uint64))
            filled = np.flatnonzero(np.diff(edges))
            rows = []
            for p in filled.tolist():
                low, own = (every[edges[p] : edges[p + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts[edges[p] : edges[p + 1]]
                order = np.argsort(low, kind="stable")
                low, own = low[order], own[order]
                more = np.flatnonzero(own > 1)
                rows.append((p, int(own.sum()), packed(low), more.astype("<i4").tobytes(), own[more].astype("<i8").tobytes()))
            # the masses go ahead of the hashes, since they set the number of counters
            yield pd.DataFrame([(p, False, m, None, None, None) for p, m, *_ in rows] + [(p, True, 0, *x) for p, _, *x in rows], columns=["part", "filled", "mass", "prints", "more", "counts"])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, mass, summary = None, 0, None

        def ended() -> pd.DataFrame:
            found = summary.reaching(threshold)
            bits = 8
            while bits < min(FILTER_BITS * len(found), per_part // 2 + 1):
                bits *= 2
            flags = np.zeros(bits, bool)
            for at in slots(found, bits):
                flags[at] = True
            return pd.DataFrame({"part": [part], "n_prints": [len(found)], "taken": [summary.taken], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.part != part:
                    if summary is not None:
                        yield ended()
                    part, mass, summary = row.part, 0, None
                if not row.filled:
                    mass += row.mass
                    continue
                if summary is None:
                    summary = Summary(mass // threshold + 1, waiting)
                prints = unpacked(row.prints)
                counts = np.ones(len(prints), np.int64)
                counts[np.frombuffer(row.more, "<i4")] = np.frombuffer(row.counts, "<i8")
                summary.add(prints, counts)
        if summary is not None:
            yield ended()

    rows = texts.mapInPandas(dealt, "part int, filled boolean, mass long, prints binary, more binary, counts binary")
    # masses are sorted before hashes; partitions beyond one a task come one after the other
    sorted_rows = rows.repartition("part").sortWithinPartitions("part", "filled")
    return stage(sorted_rows.mapInPandas(summed, "part int, n_prints long, taken long, bits binary"), "phrase-summaries")


# --- second pass: exact counts ----------------------------------------------


def counted(texts: DataFrame, sizes: list[int], filters: DataFrame, partitions: int, threshold: int, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """(lang, size, phrase, f), stored: words and phrases found ``threshold`` times or more; size 0 has the count of all words."""
    sent = texts.sparkSession.sparkContext.broadcast({r.part: r.bits for r in filters.select("part", "bits").collect()})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = np.zeros(partitions + 1, np.int64)
        for p, bits in sent.value.items():
            starts[p + 1] = len(bits)
        room = (starts[1:] * 8).astype(np.uint64)
        starts = np.cumsum(starts)
        flags = np.frombuffer(b"".join(sent.value[p] for p in sorted(sent.value)), np.uint8)
        for chunk in chunks(batches, text_bytes):
            words = chunk.starts(1)
            yield pd.DataFrame({"lang": chunk.lang, "size": 0, "phrase": "", "f": [len(words)]})
            for size in [1, *sizes]:
                begin = words if size == 1 else chunk.starts(size)
                if size > 1 and len(begin):
                    hashes = chunk.hashes(size, begin)
                    part = (((hashes >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)).astype(np.int64)
                    known = np.ones(len(begin), bool)
                    mixed = _mixed((hashes & np.uint64(0xFFFFFFFF)) + np.uint64(0x9E3779B97F4A7C15))
                    for half in (mixed, mixed >> np.uint64(32)):
                        slot = (half & (room[part] - np.uint64(1))).astype(np.int64)
                        known &= (flags[starts[part] + (slot >> 3)] >> (slot & 7)) & 1 == 1
                    begin = begin[known]
                if len(begin):
                    phrases, n = chunk.counted(size, begin)
                    yield pd.DataFrame({"lang": chunk.lang, "size": size, "phrase": phrases, "f": n})

    rows = texts.mapInPandas(of, "lang string, size int, phrase string, f long")
    total = rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return stage(total.filter((F.col("size") == 0) | (F.col("f") >= threshold)), "phrase-counts")


# --- scores -----------------------------------------------------------------


def scored(counts: DataFrame, sizes: list[int], cover: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase that no longer one stands for.

    A phrase is dropped if a longer one that holds it has ``cover`` per cent of its count or more. Scores
    are exact up to counts of 10^15.
    """
    phrases = counts.filter(F.col("size") > 1).select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = counts.filter(F.col("size") > 0)
    join = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    left = part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("(1000000 * a1 * a1) div (l1 * r1)")
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    best = (
        joined.withColumns({"a1": exact("a"), "l1": exact("l"), "r1": exact("r")})
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    )
    longer = phrases.filter(F.col("size") > 2).withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    inner = longer.select("lang", join(F.col("at"), F.col("n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a")))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best_of(rows: DataFrame, top: int, slices: int = 64) -> DataFrame:
    """The first ``top`` of each language with their ``rank``: first of slices of each, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    cut = rows.withColumn("slice", spread(F.col("phrase")) % slices)
    few = cut.withColumn("rank", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("slice")


def n_partitions(spark: SparkSession, texts: DataFrame, sizes: list[int]) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word and its blank take two bytes at least, and most take six
    return max(shuffle_partitions(spark), math.ceil(size * len(sizes) / 6 / PARTITION_MASS))


def collocations(df: DataFrame, text: str, lang: str, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``longest`` words.

    ``a`` counts the phrase (``least`` at least), ``l`` and ``r`` the two parts of the cut that scores
    lowest, ``n`` all words; ``score`` is floor(10^6 a a / (l r)). Ties go to the larger ``a``, then to the phrase.
    """
    texts = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), text_or_empty(text).cast("binary").alias("text"))
    sizes = list(range(2, longest + 1))
    partitions = n_partitions(df.sparkSession, texts, sizes)
    with batch_bytes(df.sparkSession):
        filters = summaries(texts, sizes, least, partitions, text_bytes=text_bytes)
        counts = counted(texts, sizes, filters, partitions, least, text_bytes)
    words = counts.filter(F.col("size") == 0).select("lang", F.col("f").alias("n"))
    best = best_of(scored(counts, sizes, cover), top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
