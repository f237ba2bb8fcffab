"""Rendezvous hashing: records go to the shard with the best score for their key."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import bind, running, spread, stage

#: Scores are taken modulo this prime, so that products stay within a long.
PRIME = (1 << 31) - 1


def shard_constants(shard: int, seed: int = 0) -> tuple[int, int]:
    """The multiplier and the addend of a shard; a shard keeps them whatever shards there are."""
    draw = random.Random(f"{seed}:{shard}")
    return draw.randrange(1, PRIME), draw.randrange(PRIME)


def _best(first: Column, second: Column, weights: Sequence[float], shards: range, equal: bool, seed: int) -> Column:
    """The best of some shards for a key given as two hashes: a struct of shard and score, ties to the lower shard."""
    rows = [(*shard_constants(s, seed), float(weights[s])) for s in shards]
    constants = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(w).alias("w")) for a, b, w in rows])

    def score(c: Column) -> Column:
        mixed = lambda m: (m * ((second + m) % PRIME) + c["b"]) % PRIME
        drawn = lambda n: (n * ((first + n) % PRIME) + second) % PRIME
        number = bind(bind((first * c["a"] + c["b"]) % PRIME, mixed), drawn)
        return number.cast("double") if equal else F.log((number + F.lit(0.5)) / F.lit(float(PRIME))) / c["w"]

    return bind(
        F.transform(constants, score),
        lambda x: F.struct((F.array_position(x, F.array_max(x)) - 1 + shards.start).cast("int").alias("shard"), F.array_max(x).alias("score")),
    )


def shards_of(first: Column, second: Column, weights: Sequence[float], grown: Sequence[float] | None = None, seed: int = 0) -> Column:
    """A struct of the key's shard and, for other weights, its shard under these (``grown``, else null).

    Each shard draws a number in (0, 1) from the key; the shard with the largest
    ``ln(number) / weight`` wins, ties go to the lower shard. A key's numbers for
    the other shards stay the same when a shard is added, removed or reweighted,
    so only keys that the changed shard wins or loses move; where shards are only added, only theirs are drawn anew.
    """
    for w in (weights, grown or weights):
        if not w or min(w) <= 0:
            raise ValueError("weights must be positive, one a shard")
    equal = len({*weights, *(grown or ())}) == 1
    own = _best(first, second, weights, range(len(weights)), equal, seed)
    if not grown:
        other = lambda x: F.lit(None).cast("int")
    elif list(grown[: len(weights)]) == list(weights) and len(grown) > len(weights):
        added = _best(first, second, grown, range(len(weights), len(grown)), equal, seed)
        other = lambda x: bind(added, lambda y: F.when(y["score"] > x["score"], y["shard"]).otherwise(x["shard"]))
    else:
        other = lambda x: _best(first, second, grown, range(len(grown)), equal, seed)["shard"]
    return bind(own, lambda x: F.struct(x["shard"].alias("shard"), other(x).alias("grown")))


def assign(df: DataFrame, key: Sequence[str], weights: Sequence[float], grown: Sequence[float] | None = None, seed: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, then shard, slot and grown_shard (null without ``grown``) of every row.

    The key columns alone decide the shard; a null in them is a value like any
    other. ``slot`` numbers the rows of a shard from 0 without gaps, in the order
    of a hash of the key, then the key, then the kept columns; rows equal in all of these
    share their slots in any order. Empty tables give no rows. Columns of ``df``
    beyond key and ``keep`` don't matter. Keys, kept columns and shards are stored once, then numbered.
    """
    keys = [F.col(c) for c in key]
    hashed = df.select(
        *keep,
        *(F.col(c).alias(f"__k{i}") for i, c in enumerate(key)),
        spread(*keys, seed=f"a{seed}").alias("__first"),
        spread(*keys, seed=f"b{seed}").alias("__second"),
    )
    first, second = F.col("__first"), F.col("__second")
    placed = hashed.withColumn("__of", shards_of(first, second, weights, grown, seed))
    columns = [c for c in placed.columns if c != "__of"]
    placed = stage(placed.select(*columns, F.col("__of.shard").alias("__shard"), F.col("__of.grown").alias("__grown")), "shards")
    order = [*(f"__k{i}" for i in range(len(key))), *keep]
    slotted = running(placed, "__shard", "__second", order, into="__slot", groups=len(weights))
    return slotted.select(
        *keep, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.col("__grown").alias("grown_shard")
    )

