"""Near copies: candidates by SimHash fingerprints and by a prefix filter over five-word shingles, then similarity is verified.

Texts whose fingerprints differ in two bits at most are found by the blocks that these share, as in ``simhash``. Texts of a similarity
of 0.8 may differ in far more bits; the prefix filter finds these.

Shingles are ordered, rare ones first. Two sets with a Jaccard similarity of t share at least
t / (1 + t) of both sizes together, so their first common shingle lies early in both: within the first
1 - t of each, and the earlier the longer the other set. Texts that share a shingle at such places are candidates,
so no pair is missed, whatever the edits; the order of shingles only decides how many candidates there are.

What moves is cut first: shingles that one text alone lists go by a filter made from packed 32-bit prints, pairs by
bitmaps of the sets, and sets are moved for one pair of each text before the others are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.llm.collocations import FILTER_BITS, MOST_BITS, PARTITION_MASS, packed, slots, unpacked
from tickwise.llm.common import batch_bytes, shuffle_partitions, stage, text_or_empty
from tickwise.llm.simhash import bits_of, components, links, shingle_hashes

#: Shingles are counted in one text of so many, and count as frequent from so many of these.
SAMPLE, OFTEN = 16, 4
#: Frequent shingles that are held by each Python worker at most; others keep their place among the rare ones.
HELD = 1 << 20
EMPTY = 1e-6
#: Bits of a set's bitmap.
BITS = 1024


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", words, 42))


def frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in many of the sampled texts, sorted, and in how many they do."""

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x, words).view(np.int64) for x in texts], dtype=object)

    sample = rows.filter(F.pmod(F.xxhash64("sha"), F.lit(SAMPLE)) == 0).select(F.explode(shingles("text")).alias("key"))
    counts = stage(sample.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN), "near-frequent")
    least, held = 0, 0
    for r in counts.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("shingles")).orderBy(F.desc("size")).collect():
        held += r["shingles"]
        if held > HELD:
            break
        least = r["size"]
    else:
        least = 0
    found = counts.filter(F.floor(F.log2("n")) >= least).toPandas()
    keys, n = found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def word_digest(text: str) -> str:
    """A digest of the sequence of words, ASCII case aside."""
    return blake2b(b" ".join(text.encode().lower().split()), digest_size=16).hexdigest()


def bitmap(found: np.ndarray) -> np.ndarray:
    """Which of ``BITS`` bits the shingles of a set fall on, as 64-bit numbers."""
    flags = np.zeros(BITS, bool)
    flags[(found % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.int64)


def prints(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of each text: a digest of its words, its fingerprint, the size of its set of shingles, its bitmap, and the first of the shingles, rare ones first."""
    held = rows.sparkSession.sparkContext.broadcast(frequent(rows, words))

    @F.pandas_udf("digest string, fp long, size int, bits array<long>, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        often, counts = held.value
        digests, fps, sizes, bits, keys = [], np.empty(len(texts), np.uint64), [], [], []
        for i, x in enumerate(texts):
            digests.append(word_digest(x))
            every = shingle_hashes(x, words, 42)
            fps[i] = bits_of(every)
            found = np.unique(every)
            bits.append(bitmap(found))
            if len(often) and len(found):
                at = np.minimum(np.searchsorted(often, found), len(often) - 1)
                found = found[np.argsort(np.where(often[at] == found, counts[at], 0), kind="stable")]
            sizes.append(len(found))
            keys.append(found[: len(found) - ceil(similarity * len(found) - EMPTY) + 1].view(np.int64))
        return pd.DataFrame({"digest": digests, "fp": fps.view(np.int64), "size": np.array(sizes, np.int32), "bits": pd.Series(bits, dtype=object), "keys": pd.Series(keys, dtype=object)})

    return rows.select("id", "sha", of("text").alias("p")).select("id", "sha", "p.*")


def close(classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that connect all whose fingerprints are equal or linked by steps of one or two bits.

    ``classes`` (node, fp) has a row per different text. The least node of a fingerprint stands for it, so a fingerprint that many texts share
    costs a pair each.
    """
    least = stage(classes.groupBy("fp").agg(F.min("node").alias("least")), "near-fingerprints", narrow=True)
    equal = classes.join(least, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of = lambda name: least.select(F.col("fp").alias(name), F.col("least").alias(f"node_{name}"))
    beside = links(least.select("fp")).join(of("a"), "a").join(of("b"), "b")
    return equal.unionByName(beside.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def repeated(seen: DataFrame, most_bits: int = MOST_BITS) -> tuple[dict[int, bytes], int]:
    """A filter, and in how many parts it is, that lets through every listed shingle of two different texts.

    Shingles move as 32-bit prints beside 32 bits of their text's digest, so that copies don't count. The filter takes at
    most ``most_bits``; where that is few it lets more through, which only costs time.
    """
    spark = seen.sparkSession
    listed = seen.agg(F.sum(F.size("keys"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), ceil(listed / PARTITION_MASS))
    per_part = max(8, most_bits // parts)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates("digest")
            lists = [np.asarray(k).view(np.uint64) for k in batch["keys"]]
            if not sum(map(len, lists)):
                continue
            keys = np.concatenate(lists)
            texts = np.repeat([int(x[:8], 16) for x in batch["digest"]], list(map(len, lists))).astype(np.uint64)
            part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            rows = []
            for p in np.unique(part):
                mine = np.sort((keys[part == p] << np.uint64(32)) | texts[part == p])
                rows.append((int(p), packed((mine >> np.uint64(32)).astype(np.uint32)), mine.astype(np.uint32).tobytes()))
            yield pd.DataFrame(rows, columns=["part", "prints", "texts"])

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, []

        def ended() -> pd.DataFrame:
            both = np.unique(np.concatenate(held))
            shingles = both >> np.uint64(32)
            twice = np.unique(shingles[1:][shingles[1:] == shingles[:-1]]).astype(np.uint32)
            bits = 8
            while bits < min(FILTER_BITS * len(twice), per_part // 2 + 1):
                bits *= 2
            flags = np.zeros(bits, bool)
            for at in slots(twice, bits):
                flags[at] = True
            return pd.DataFrame({"part": [part], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.part != part:
                    if held:
                        yield ended()
                    part, held = row.part, []
                held.append((unpacked(row.prints).astype(np.uint64) << np.uint64(32)) | np.frombuffer(row.texts, np.uint32))
        if held:
            yield ended()

    with batch_bytes(spark):
        rows = seen.select("digest", "keys").mapInPandas(dealt, "part int, prints binary, texts binary")
        found = stage(rows.repartition("part").sortWithinPartitions("part").mapInPandas(met, "part int, bits binary"), "near-filter")
    return {r.part: r.bits for r in found.collect()}, parts


def listing(seen: DataFrame) -> DataFrame:
    """(digest, size, pos, key): each text's first shingles that other texts list too, with their places in the order."""
    held, parts = repeated(seen)
    sent = seen.sparkSession.sparkContext.broadcast(held)

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = [sent.value.get(p, b"\0") for p in range(parts)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in filters])])
        room = np.array([8 * len(x) for x in filters], np.uint64)
        flags = np.frombuffer(b"".join(filters), np.uint8)
        for batch in batches:
            lists = [np.asarray(k) for k in batch["keys"]]
            keys = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
            part = (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            known = np.ones(len(keys), bool)
            for at in slots(keys.astype(np.uint32), room[part]):
                known &= (flags[starts[part] + (at >> 3)] >> (at & 7)) & 1 == 1
            ends = np.cumsum([len(x) for x in lists])
            kept = [np.flatnonzero(x) for x in np.split(known, ends[:-1])] if len(lists) else []
            rows = [i for i, x in enumerate(kept) if len(x)]
            yield pd.DataFrame({
                "digest": batch["digest"].iloc[rows], "size": batch["size"].iloc[rows],
                "pos": pd.Series([kept[i].astype(np.int32) for i in rows], dtype=object, index=batch.index[rows]),
                "key": pd.Series([lists[i][kept[i]] for i in rows], dtype=object, index=batch.index[rows]),
            })

    found = seen.select("digest", "size", "keys").mapInPandas(shared, "digest string, size int, pos array<int>, key array<long>")
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("size", "pos", "key")])


def can_reach(size: Column, pos: Column, other: Column, similarity: float) -> Column:
    """Whether a set of ``size`` whose first common shingle with a set of size ``other`` is at ``pos`` can be similar to it."""
    return (size - pos) * F.lit(1 + similarity) >= (size + other) * F.lit(similarity) - F.lit(EMPTY)


def meeting(listed: DataFrame, place: list[str], similarity: float, pair_limit: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Of ``listed`` (place, id, size, pos): pairs (a, b) of places where at most ``pair_limit`` texts meet, and the rows of the other places.

    Places are counted by hash, so only texts of small places are sorted into a group.
    """
    counts = listed.groupBy(*[F.col(c).alias(f"of_{c}") for c in place]).agg(F.count("*").alias("members")).filter("members > 1")
    same = [F.col(c) == F.col(f"of_{c}") for c in place]
    met = stage(listed.join(counts, same).drop(*[f"of_{c}" for c in place]), name)
    after = W.partitionBy(*place).orderBy("id").rowsBetween(1, pair_limit)
    fits = lambda x: can_reach(F.col("size"), F.col("pos"), x["size"], similarity) & can_reach(x["size"], x["pos"], F.col("size"), similarity)
    few = met.filter(F.col("members") <= pair_limit).withColumn("later", F.collect_list(F.struct("id", "size", "pos")).over(after))
    pairs = few.select(F.col("id").alias("a"), F.explode(F.transform(F.filter("later", fits), lambda x: x["id"])).alias("b"))
    return pairs, met.filter(F.col("members") > pair_limit).drop("members")


def candidates(listed: DataFrame, similarity: float, pair_limit: int = 16, centres: int = 4) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of ids that may be similar, and the crowded places (key, bucket, id, size, pos).

    ``listed`` (id, size, pos, key) has a text's first shingles. Texts that share a shingle are paired if they are
    at most ``pair_limit``. Where more do, they are dealt again by the size of the smaller set of a pair, in steps
    of two per cent, each to the sizes that its place in the order allows: shingles of a template lie too late for most.
    What is still crowded is paired with the place's centres first: copies of one text meet their original nearly
    everywhere, so a centre is the text that lies in most crowded places, in each of ``centres`` parts. ``rest`` gives the other pairs.
    """
    pairs, crowded = meeting(listed, ["key"], similarity, pair_limit, "near-met")

    step = lambda x: F.floor(F.log(x.cast("double")) / F.lit(np.log(1.02).item()) + F.lit(EMPTY))
    least = F.ceil(F.col("size") * F.lit(similarity) - F.lit(EMPTY))
    dealt = crowded.withColumn("bucket", F.explode(F.sequence(step(least), step(F.col("size")))))
    edge = F.greatest(least, F.pow(F.lit(1.02), F.col("bucket")) * F.lit(1 - EMPTY))
    dealt = dealt.filter(can_reach(F.col("size"), F.col("pos"), edge, similarity))
    more, many = meeting(dealt, ["key", "bucket"], similarity, pair_limit, "near-dealt")

    often = many.groupBy(F.col("id").alias("of")).agg(F.count("*").alias("n"))
    ranked = many.join(often, F.col("id") == F.col("of"))
    centre = F.max(F.struct("n", (-F.col("id")).alias("least"), "size", "pos"))
    chosen = ranked.groupBy("key", "bucket", F.pmod(F.xxhash64("id"), F.lit(centres)).alias("part")).agg(centre.alias("c"))
    chosen = chosen.select("key", "bucket", (-F.col("c.least")).alias("other"), F.col("c.size").alias("osize"), F.col("c.pos").alias("opos"))
    starred = possible(many.join(chosen, ["key", "bucket"]), similarity)
    return pairs.unionByName(more).unionByName(starred).distinct(), many


def possible(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``met`` (id, size, pos, other, osize, opos) whose places allow the similarity."""
    fits = can_reach(F.col("size"), F.col("pos"), F.col("osize"), similarity) & can_reach(F.col("osize"), F.col("opos"), F.col("size"), similarity)
    return met.filter("id <> other").filter(fits).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def rest(crowds: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The pairs of the crowded places whose texts aren't connected yet.

    Of a place, the texts of the component with most texts needn't be paired with each other; each other text is paired with all
    that are in another component than its own.
    """
    rooted = crowds.join(roots, F.col("id") == F.col("node"), "left")
    rooted = stage(rooted.select("key", "bucket", "id", "size", "pos", F.coalesce("root", "id").alias("root")), "near-crowds")
    shares = rooted.groupBy("key", "bucket", "root").agg(F.count("*").alias("n"))
    largest = shares.groupBy("key", "bucket").agg(F.max(F.struct("n", "root")).alias("x"), F.count("*").alias("parts")).filter("parts > 1")
    open_ = rooted.join(largest.select("key", "bucket", F.col("x.root").alias("most")), ["key", "bucket"])
    few = open_.filter("root <> most")
    other = few.select("key", "bucket", F.col("id").alias("other"), F.col("size").alias("osize"), F.col("pos").alias("opos"), F.col("root").alias("oroot"))
    return possible(open_.join(other, ["key", "bucket"]).filter("root <> oroot"), similarity).distinct()


def within_bitmaps(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose bitmaps allow the similarity: each bit that differs is a shingle that one of the two lacks."""
    side = lambda name: classes.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("bits").alias(f"bits_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = (F.col("size_a") + F.col("size_b")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(EMPTY)
    return both.filter(apart <= most).select("a", "b")


def _packed_set(found: np.ndarray) -> bytes:
    """48 bits of each shingle, sorted, as differences, bytes of equal weight side by side."""
    cut = np.unique(found >> np.uint64(16))
    return np.diff(cut, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unpacked_set(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :6] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


#: Bits of the filter that says of which texts sets are asked for (16 MB); the first seven digits of a digest choose one.
ASKED_BITS = 1 << 27


def sets_of(pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of all texts in ``pairs``, made where the texts lie: texts don't move, and each set moves once.

    A filter of bounded size tells the tasks which texts are asked for; the join leaves out those it lets through besides.
    """
    spark = pairs.sparkSession
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = stage(asked.join(classes, "node").select("node", "digest"), "near-asked")
    place = F.conv(F.substring("digest", 1, 7), 16, 10).cast("long") % ASKED_BITS
    words_ = asked.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    blocks = words_.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    flags = np.zeros(ASKED_BITS >> 6, np.int64)
    found = blocks.toArrow()  # at most ASKED_BITS / 64 rows
    flags[found["word"].to_numpy()] = found["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(flags)

    # one step in Python for the digest, the filter and the set, so that a task has one worker
    def packed_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch["text"]:
                digest = word_digest(x)
                at = int(digest[:7], 16) % ASKED_BITS
                if int(sent.value[at >> 6]) >> (at & 63) & 1:
                    out.append((digest, _packed_set(shingle_set(x, words))))
            yield pd.DataFrame(out, columns=["digest", "shingles"])

    held = rows.select("text").mapInPandas(packed_sets, "digest string, shingles binary")
    each = held.groupBy("digest").agg(F.first("shingles").alias("shingles"))
    return stage(each.join(asked, "digest").select("node", "shingles"), "near-sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles have a Jaccard similarity of at least ``similarity``."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            x, y = _unpacked_set(x), _unpacked_set(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(alike("set_a", "set_b")).select("a", "b")


def linked(pairs: DataFrame, sets: DataFrame, similarity: float, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Verified links that connect what all ``pairs`` that are similar connect, and the components of these and ``known`` links.

    Of the pairs that end in a text, that with the least other text goes first; the others count only if they join texts that
    aren't connected by then, so a family's sets move about once a text and not once a pair.
    """
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stage(verified(first, sets, similarity), "near-links")
    links = links if known is None else links.unionByName(known)
    roots = components(links)
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    open_ = pairs.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    open_ = stage(open_.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "near-open")
    if not open_.isEmpty():
        links = links.unionByName(stage(verified(open_, sets, similarity), "near-links"))
        roots = components(links)
    return links, roots


def classed(df: DataFrame, id_: str, text: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, sha, digest, root) of each row, stored: rows of near copies have the same root.

    Texts of equal words (ASCII case aside) are copies, whatever their number, and cost one row; other texts are linked if
    they are ``close`` or ``candidates`` and similar, and links are followed. Texts without words are copies of
    each other. Rows are told apart by content: ids may repeat or be null.
    """
    rows = df.select(F.col(id_).cast("long").alias("id"), text_or_empty(text).alias("text"))
    with batch_bytes(df.sparkSession):
        seen = stage(prints(rows.withColumn("sha", F.unhex(F.sha2("text", 256))), words, similarity), "near-prints")
        classes = seen.groupBy("digest").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("fp").alias("fp"))
        classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
        listed = listing(seen).join(classes.select("digest", "node"), "digest").select(F.col("node").alias("id"), "size", F.explode(F.arrays_zip("pos", "key")).alias("x"))
        found, crowds = candidates(stage(listed.select("id", "size", "x.pos", "x.key"), "near-listed"), similarity)
        found = found.unionByName(close(classes.select("node", "fp"))).distinct()
        pairs = stage(within_bitmaps(found, classes, similarity), "near-pairs")
        links, roots = linked(pairs, sets_of(pairs, classes, rows, words), similarity)
        if not crowds.isEmpty():
            more = within_bitmaps(rest(crowds, roots, similarity).join(pairs, ["a", "b"], "left_anti"), classes, similarity)
            more = stage(more, "near-rest")
            if not more.isEmpty():
                _, roots = linked(more, sets_of(more, classes, rows, words), similarity, links)
    named = classes.join(roots, "node", "left").select(F.col("digest").alias("d"), F.coalesce("root", "node").alias("root"))
    return stage(seen.select("id", "sha", "digest").join(named, F.col("digest") == F.col("d")).select("id", "sha", "root"), "near-rows")


def groups(df: DataFrame, id_: str, text: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, group) of each row: the least id of its near copies, null if all of these are null."""
    rows = classed(df, id_, text, words, similarity)
    least = rows.groupBy("root").agg(F.min("id").alias("group"))
    return rows.join(least, "root").select("id", "group")


def keep_one(df: DataFrame, id_: str, text: str, **parameters) -> DataFrame:
    """One row of ``df`` for each group of near copies: that with the least id (null after all others), of these that with the least text hash.

    Of rows that are equal in both the least by its other columns stays. Columns keep their names, whatever these are.
    """
    rows = classed(df, id_, text, **parameters)
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "sha")).alias("x")).select("x.id", "x.sha")
    counts = rows.groupBy("id", "sha").agg(F.count("*").alias("n"))
    match = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["sha"] == b["sha"])
    gone = stage(counts.join(kept, match(counts, kept), "left_anti").select("id", "sha"), "near-gone")
    several = stage(counts.join(kept, match(counts, kept), "left_semi").filter("n > 1").select("id", "sha"), "near-several")
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    whole = whole.select("row", F.col("row")[id_].cast("long").alias("id"), F.unhex(F.sha2(text_or_empty(F.col("row")[text]), 256)).alias("sha"))
    left = whole.join(gone, match(whole, gone), "left_anti")
    if not several.isEmpty():
        # a third of all rows may be equal: they are reduced where they are read
        equal = left.join(several, match(left, several), "left_semi").groupBy("id", "sha").agg(F.min("row").alias("row"))
        left = left.join(several, match(left, several), "left_anti").select("row").unionByName(equal.select("row"))
    return left.select("row.*")
