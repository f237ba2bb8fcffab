"""Line dedup: common lines are looked up in sharded minimal perfect hashes.

Lines are hashed to 128 bits. Those that repeat are dealt to shards of a bounded number of
lines; a shard has a minimal perfect hash and, by its numbers, a fingerprint and a document
count of each line. Documents look their lines up in these arrays: a line that isn't in the
index gets some number too, and its fingerprint tells. Lines of one document are in no array,
since no threshold above one document can meet them.

The arrays go to the documents if they are smaller than a limit; beyond it, the lines' hashes
go to the arrays, and numbers of lines come back.

Every row is a document of its own, also rows of repeated or null ids. Null and empty texts
are one empty line. An empty line has no key and always stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import shuffle_partitions, stage, text_or_empty

BLANK_BYTES = b" \t\n\x0b\x0c\r"
#: Lines in a shard, about; bytes of arrays that are sent to all tasks at most.
SHARD_LINES = 1 << 16
SEND_BYTES = 64 << 20
#: Bits a line takes in a level of the perfect hash.
ROOM = 2
INDEX_SCHEMA = "shard int, n int, sizes binary, bits binary, prints binary, counts binary"
#: Counts are kept in 16 bits and stay at the largest value.
MOST = 65_535


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line; None for lines too short to count."""
    found = [line.strip(BLANK_BYTES) for line in text.lower().split(b"\n")]
    if min_chars <= 1:
        return [key or None for key in found] if min_chars == 1 else found
    return [key if len(key.decode("utf-8", "replace")) >= min_chars else None for key in found]


def hashed(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each key, as rows."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0 to n-1 for n distinct 128-bit hashes.

    A level has ``ROOM`` bits a hash; hashes alone at their bit take it, the others go on
    to the next level. The number of a hash is the count of bits set before its own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.bits = bits
        self.words = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def _place(rows: np.ndarray, level: int, size: int) -> np.ndarray:
        step = np.uint64(((level + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
        return (_mixed(_mixed(rows[:, 0] + step) ^ rows[:, 1]) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, rows: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(rows):
            size = -(-ROOM * len(rows) // 64) * 64
            at = cls._place(rows, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rows = rows[~alone[at]]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def numbers(self, rows: np.ndarray) -> np.ndarray:
        """Each hash's number; -1 or any number for hashes it wasn't built from."""
        out = np.full(len(rows), -1, dtype=np.int64)
        left = np.arange(len(rows))
        for level, size in enumerate(self.sizes.tolist()):
            at = self._place(rows[left], level, size) + self.starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (self.bits[word] >> bit) & np.uint64(1) == 1
            word, bit = word[here], bit[here]
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[here]] = self.words[word] + np.bitwise_count(below)
            left = left[~here]
        return out


class Shard:
    """Fingerprint and count of a line by the number that the perfect hash gives it."""

    def __init__(self, row):
        self.n = row.n
        self.hash = PerfectHash(np.frombuffer(row.sizes, np.int64), np.frombuffer(row.bits, np.uint64))
        self.prints, self.counts = np.frombuffer(row.prints, np.uint64), np.frombuffer(row.counts, np.uint16)

    def look_up(self, rows: np.ndarray) -> np.ndarray:
        """In how many documents each line is found; 0 if it isn't in the index."""
        number = self.hash.numbers(rows)
        known = number >= 0
        known[known] = self.prints[number[known]] == rows[known, 1]
        return np.where(known, self.counts[np.where(known, number, 0)], 0)


def look_up(shards: dict[int, Shard], n_shards: int, rows: np.ndarray) -> np.ndarray:
    """``Shard.look_up`` for lines of any shard."""
    out = np.zeros(len(rows), dtype=np.int64)
    of = rows[:, 0] % np.uint64(n_shards)
    order = np.argsort(of, kind="stable")
    edges = np.flatnonzero(np.diff(of[order])) + 1
    for group in np.split(order, edges) if len(rows) else []:
        if (shard := shards.get(int(of[group[0]]))) is not None:
            out[group] = shard.look_up(rows[group])
    return out


def repeated_lines(df: DataFrame, text: str, min_chars: int = 1, least: int = 2) -> DataFrame:
    """(a, b, n): the two halves of a line's hash and the count of its documents, from ``least`` documents on."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys: dict[bytes, int] = {}
            for value in batch["text"]:
                for key in set(keys_of(value, min_chars)):
                    if key is not None:
                        keys[key] = keys.get(key, 0) + 1
            rows = hashed(list(keys)).view(np.int64)
            yield pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1], "n": np.fromiter(keys.values(), np.int64, len(keys))})

    texts = df.select(text_or_empty(text).cast("binary").alias("text"))
    counted = texts.mapInPandas(count, "a long, b long, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def line_index(lines: DataFrame, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int]:
    """The arrays of all shards, stored, and the number of shards."""
    lines = stage(lines, "repeated-lines")
    n_shards = max(1, math.ceil(lines.count() / shard_lines))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack([group["a"].to_numpy(), group["b"].to_numpy()], axis=1).view(np.uint64)
        perfect = PerfectHash.build(rows)
        at = perfect.numbers(rows)
        prints, counts = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint16)
        prints[at], counts[at] = rows[:, 1], np.minimum(group["n"].to_numpy(), MOST)
        return pd.DataFrame({
            "shard": [group["shard"].iloc[0]], "n": [len(rows)], "sizes": [perfect.sizes.tobytes()], "bits": [perfect.bits.tobytes()],
            "prints": [prints.tobytes()], "counts": [counts.tobytes()],
        })

    # the unsigned remainder: the upper and the lower half of the bits are taken one after the other
    high, low = F.shiftrightunsigned("a", 32), F.col("a").bitwiseAND((1 << 32) - 1)
    shard = ((high % n_shards) * ((1 << 32) % n_shards) + low) % n_shards
    built = lines.withColumn("shard", shard.cast("int")).groupBy("shard").applyInPandas(build, INDEX_SCHEMA)
    return stage(built, "line-index"), n_shards


def _dropper(least: int, min_chars: int, found: Callable[[np.ndarray], np.ndarray]) -> Callable[[list[bytes]], list[np.ndarray]]:
    """Which lines of each text of a batch are common; a line is looked up once in a batch."""

    def common(texts: list[bytes]) -> list[np.ndarray]:
        keys = [keys_of(x, min_chars) for x in texts]
        distinct = {k: i for i, k in enumerate(dict.fromkeys(k for of in keys for k in of if k is not None))}
        hit = np.zeros(len(distinct) + 1, dtype=bool)
        if distinct:
            hit[:-1] = found(hashed(list(distinct))) >= least
        at = np.fromiter((distinct.get(k, -1) for of in keys for k in of), np.int64, sum(map(len, keys)))
        return np.split(hit[at], np.cumsum([len(of) for of in keys])[:-1])

    return common


def without_common(df: DataFrame, text: str, into: str, min_docs: int = 10, min_chars: int = 1, send_bytes: int = SEND_BYTES, shard_lines: int = SHARD_LINES) -> DataFrame:
    """Adds ``into``, a struct of ``n_lines``, ``n_dropped`` and ``text`` without the lines found in ``min_docs`` documents or more.

    ``min_docs`` is at most 65,535, the largest count kept. All columns of ``df`` stay.
    """
    if not 1 <= min_docs <= MOST:
        raise ValueError(f"min_docs is from 1 to {MOST}")
    index, n_shards = line_index(repeated_lines(df, text, min_chars, min(2, min_docs)), shard_lines)
    size = index.agg(F.sum(F.length("sizes") + F.length("bits") + F.length("prints") + F.length("counts"))).first()[0] or 0
    if size <= send_bytes:
        return df.withColumn(into, _looked_up(df, index, n_shards, min_docs, min_chars)(text_or_empty(text).cast("binary"))).withColumn(
            into, F.struct(F.col(into).n_lines.alias("n_lines"), F.col(into).n_dropped.alias("n_dropped"), F.col(into).text.cast("string").alias("text"))
        )
    return _routed(df, text, into, index, n_shards, min_docs, min_chars)


def _looked_up(df: DataFrame, index: DataFrame, n_shards: int, min_docs: int, min_chars: int):
    sent = df.sparkSession.sparkContext.broadcast({row.shard: row for row in index.collect()})

    @F.pandas_udf("n_lines long, n_dropped long, text binary")
    def kept(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shards = {k: Shard(row) for k, row in sent.value.items()}
        common = _dropper(min_docs, min_chars, lambda rows: look_up(shards, n_shards, rows))
        for batch in texts:
            values = batch.tolist()
            drops = common(values)
            left = [b"\n".join([x for x, gone in zip(v.split(b"\n"), d) if not gone]) if d.any() else v for v, d in zip(values, drops)]
            yield pd.DataFrame({"n_lines": [len(d) for d in drops], "n_dropped": [int(d.sum()) for d in drops], "text": left})

    return kept


def _routed(df: DataFrame, text: str, into: str, index: DataFrame, n_shards: int, min_docs: int, min_chars: int) -> DataFrame:
    """Sends hashes of lines to their shards and brings the numbers of common lines back to the texts.

    A batch of texts sends a shard one row with each of its lines once, so that a line which a
    third of all documents have is no heavier than another. A shard's rows are spread over as
    many tasks as the batches ask for, each of which gets the shard's arrays before them.
    """
    spread = max(1, math.ceil(shuffle_partitions(df.sparkSession) / n_shards))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at: dict[bytes, list] = {}
            for digest, value in batch.drop_duplicates("digest").itertuples(index=False):
                for i, key in enumerate(keys_of(value, min_chars)):
                    if key is not None:
                        at.setdefault(key, []).append((digest, i))
            if not at:
                continue
            rows, lists = hashed(list(at)), list(at.values())
            of = (rows[:, 0] % np.uint64(n_shards)).astype(np.int64)
            salt = int(rows[:, 1].min()) % spread
            for shard in np.unique(of):
                chosen = np.flatnonzero(of == shard)
                where = [x for i in chosen for x in lists[i]]
                yield pd.DataFrame({
                    "shard": [int(shard)], "salt": [salt], "asked": [rows[chosen].tobytes()], "lists": [np.array([len(lists[i]) for i in chosen], np.int64).tobytes()],
                    "digests": [b"".join(d for d, _ in where)], "numbers": [np.array([i for _, i in where], np.int64).tobytes()],
                })

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, shard = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.bits is not None:
                    now, shard = row.shard, Shard(row)
                elif now == row.shard:
                    hit = shard.look_up(np.frombuffer(row.asked, np.uint64).reshape(-1, 2)) >= min_docs
                    where = np.flatnonzero(np.repeat(hit, np.frombuffer(row.lists, np.int64)))
                    yield pd.DataFrame({"digest": [row.digests[32 * i : 32 * i + 32] for i in where], "number": np.frombuffer(row.numbers, np.int64)[where]})

    texts = df.select(F.unhex(F.sha2(text_or_empty(text), 256)).alias("digest"), text_or_empty(text).cast("binary").alias("text"))
    probes = texts.mapInPandas(asked, "shard int, salt int, asked binary, lists binary, digests binary, numbers binary")
    arrays = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    both = arrays.unionByName(probes, allowMissingColumns=True)
    sorted_rows = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("bits").isNull())
    hits = sorted_rows.mapInPandas(answered, "digest binary, number long")
    hits = stage(hits.groupBy("digest").agg(F.collect_set(F.col("number").cast("int")).alias("__numbers")), "common-lines")
    rows = df.select(F.struct("*").alias("__row"), F.unhex(F.sha2(text_or_empty(text), 256)).alias("digest"))
    lines = F.split(text_or_empty(F.col("__row")[text]), "\n", -1)
    gone = F.coalesce(F.col("__numbers"), F.array().cast("array<int>"))
    left: Callable[[Column, Column], Column] = lambda _, i: ~F.array_contains(gone, i)
    kept = F.struct(F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), F.array_join(F.filter(lines, left), "\n").alias("text"))
    return rows.join(hits, "digest", "left").select("__row.*", kept.alias(into))
