"""SimHash fingerprints, pigeonhole blocks, and components of close fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.llm.common import stage

BITS = 64


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words (ASCII letters lower-cased, joined by a blank), repeats included.

    A shorter text is one run; a text without words has none.
    """
    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(tokens) - words + 1)
    hashed = xxhash.xxh64_intdigest
    pairs = zip(starts[:count].tolist(), ends[-count:].tolist())
    return np.fromiter((hashed(joined[a:b], seed) for a, b in pairs), np.uint64, count)


def bits_of(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half the hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: Column, words: int = 5, seed: int = 42) -> Column:
    """The fingerprint of a text as a signed long; null counts as empty, and empty texts have 0."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        found = (bits_of(shingle_hashes(x, words, seed)) if x else 0 for x in texts)
        return pd.Series(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    return of(text)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- links ------------------------------------------------------------------


#: Fingerprints are linked up to this distance; ``links`` relies on it being 2.
DISTANCE = 2


def _masks(extra: int) -> list[int]:
    """Masks of the bits that two close fingerprints may share.

    The 64 bits are cut into ``DISTANCE + 1 + extra`` blocks. Fingerprints that
    differ in at most ``DISTANCE`` bits share all bits of some ``1 + extra`` blocks.
    """
    count = DISTANCE + 1 + extra
    edges = [round(i * BITS / count) for i in range(count + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, 1 + extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, extra: int = 2, pair_limit: int = 32) -> DataFrame:
    """Links (a, b) between different fingerprints that differ in one or two bits, so that
    all fingerprints that such steps connect are connected.

    ``fps`` has one row per distinct ``fp``. Each is listed under its blocks' bits;
    those that share a block are joined and their Hamming distance is verified.
    A block shared by more than ``pair_limit`` fingerprints isn't paired: since these differ in
    the other bits alone, each is listed under itself and under what flipping one of those bits gives, and
    two are close exactly if they meet there (one bit from each, or two from one); a meeting place
    links its members, at most 65, to their least. Nothing is left out, and work per fingerprint is bounded.
    """
    masks = _masks(extra)
    listed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])).alias("k"))
    listed = stage(listed.select("fp", "k.block", "k.bits"), "blocks", narrow=True)
    sizes = listed.groupBy("block", "bits").agg(F.count("*").alias("members")).filter("members > 1")
    shared = stage(listed.join(sizes, ["block", "bits"]), "shared-blocks", narrow=True)

    few = shared.filter(F.col("members") <= pair_limit).select("block", "bits", "fp")
    paired = few.alias("l").join(few.alias("r"), ["block", "bits"]).filter("l.fp < r.fp")
    close = paired.filter(F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= DISTANCE)
    close = close.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))

    flips = F.element_at(
        F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS) if not m >> b & 1]) for m in masks]),
        F.col("block") + 1,
    )
    many = shared.filter(F.col("members") > pair_limit).select("fp", F.explode(flips).alias("flip"))
    met = many.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("place")).distinct()
    least = met.groupBy("place").agg(F.min("fp").alias("a"), F.count("*").alias("members")).filter("members > 1")
    crowded = met.join(least.select("place", "a"), "place").filter("a < fp").select("a", F.col("fp").alias("b"))
    return close.unionByName(crowded).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node that links reach, for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps, which join each node's neighbours
    to the least of them, until no link changes; each step is stored. A node's
    neighbours are never gathered, only their minimum is.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links", narrow=True)
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y"), "u")
        step = small.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(small.select("u", F.col("y").alias("v")))
        edges = stage(step.filter("u <> v").distinct(), "links", narrow=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def classes(df: DataFrame, id_: str, fp: str) -> DataFrame:
    """(id, fp, component_id): the least id that links between fingerprints reach, itself included.

    Equal fingerprints are one node, so copies cost nothing. Null ids can't be named:
    such rows belong to their component, but the least id is that of the others
    (null if all are null). Rows of equal id are all returned.
    """
    rows = df.select(F.col(id_).alias("__id"), F.col(fp).alias("fp"))
    nodes = stage(rows.groupBy("fp").agg(F.min("__id").alias("first")), "fingerprints", narrow=True)
    found = components(links(nodes.select("fp")))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("__fp")).select(F.col("__id").alias(id_), F.col("fp").alias(fp), "component_id")
