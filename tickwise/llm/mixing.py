"""Mixing sources to target weights: exact block quotas, split among shards by hypergeometric draws."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import running, spread, stage, text_or_empty, words_of


@dataclass(frozen=True)
class Share:
    """One source of a mix: its size, its target, and how its blocks go to the shards."""

    source: str | None
    source_size: int
    target: float
    blocks: int
    step: int
    start: int
    upto: tuple[int, ...]


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its source's size.

    What a source can't take is shared again by weight among the others, so sources
    below their limit have targets in proportion to their weights. If the limits together are
    below ``total``, all are at their limit.
    """
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, weight, level = total, sum(weights), False
    found = [0.0] * len(sizes)
    for i in order:
        limit = most * sizes[i]
        level = level or limit * weight > left * weights[i]
        found[i] = float(left * weights[i] / weight if level else limit)
        if not level:
            left, weight = left - limit, weight - weights[i]
    return found


def split(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks per source (rows) and shard (columns), as a shuffle of all blocks would deal them.

    A tree over the shards: a node divides its quotas between its halves by a
    multivariate hypergeometric draw of exactly the blocks that fall to the left half.
    """
    quotas = np.zeros((len(blocks), shards), np.int64)
    total = sum(blocks)
    starts = [total * s // shards for s in range(shards + 1)]
    nodes = [(0, shards, np.array(blocks, np.int64))]
    while nodes:
        lo, hi, own = nodes.pop()
        if hi - lo == 1:
            quotas[:, lo] = own
            continue
        mid = (lo + hi) // 2
        draw = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = draw.multivariate_hypergeometric(own, starts[mid] - starts[lo], method="marginals")
        nodes += [(lo, mid, left), (mid, hi, own - left)]
    return quotas


def plan(sizes: dict[str | None, int], weights: dict[str | None, float], most: float, shards: int, block: int, seed: int) -> list[Share]:
    """The shares of all sources; the list of sources is as long as the list of weights that someone wrote."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    if not names:
        return []
    wanted = targets([sizes[s] for s in names], [weights[s] for s in names], sum(sizes.values()), most)
    while sum(wanted) / block > 5e8:  # the draws are exact up to 10^9 blocks
        block *= 2
    counts = [math.ceil(t / block) for t in wanted]
    quotas = split(counts, shards, seed)
    shares = []
    for i, name in enumerate(names):
        draw = random.Random(f"{seed}:{name}")
        step = next(x for x in iter(lambda: draw.randrange(1, max(2, counts[i])), None) if math.gcd(x, max(1, counts[i])) == 1)
        upto = tuple(int(x) for x in np.cumsum(quotas[i]))
        shares.append(Share(name, sizes[name], wanted[i], counts[i], step, draw.randrange(max(1, counts[i])), upto))
    return shares


def n_words(text: str | Column) -> Column:
    return F.size(words_of(text_or_empty(text))).cast("long")


def draws(
    sized: DataFrame, key: str, source: str, size: str, weights=None, most: int = 3, shards: int = 64, block: int = 50_000, seed: int = 7
) -> DataFrame:
    """(key, source, size, source_size, target, draws) of each row of ``sized``, which should be stored: it is read twice.

    A source's rows lie in the order of a hash of the key, again and again up to
    its target; a copy is drawn if its middle lies before the target, so the words drawn miss
    the target by at most half a row, and a row is drawn at most ``ceil(most)`` times. The stream is cut into
    blocks of ``block`` words; a permutation of the block numbers and the quotas of the
    splitting tree give each block its shard. ``draws`` is an array of (copy, block,
    shard, position); rows of a shard are shuffled by sorting on position. ``weights`` maps
    sources to weights; by default they are 5, 2, 1 in turn. Null sources are a source of their own, null or empty
    texts have size 0 and are drawn with what surrounds them. Equal rows differ in their draws alone.
    """
    spark = sized.sparkSession
    totals = {r["s"]: int(r["n"]) for r in sized.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("n")).collect()}
    if weights is None:
        named = sorted(s for s in totals if s is not None) + [None]
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(named)}
    shares = plan(totals, weights, most, shards, block, seed)
    numbers = ("source_size", "target", "blocks", "step", "start")
    table = spark.createDataFrame(
        pa.table(
            {
                "i": pa.array(range(len(shares)), pa.int32()),
                "s": pa.array([x.source for x in shares], pa.string()),
                **{n: pa.array([getattr(x, n) for x in shares], pa.float64() if n == "target" else pa.int64()) for n in numbers},
                "upto": pa.array([list(x.upto) for x in shares], pa.list_(pa.int64())),
            }
        )
    )
    # one row a source and as many numbers as shards: as small as the list of weights
    rows = sized.select(F.col(key).alias("__id"), F.col(source).alias("__source"), F.col(size).cast("long").alias("__size"))
    planned = rows.join(F.broadcast(table), F.col("__source").eqNullSafe(F.col("s")))
    planned = planned.withColumn("__spread", spread(F.col("__id"), seed=str(seed)))
    placed = running(planned, "i", "__spread", ["__id", "__size"], "__size", "__at", groups=1)

    def drawn(copy: Column) -> Column:
        begin = copy * F.col("source_size") + F.col("__at")
        number = F.least(F.floor(begin / F.lit(float(block))).cast("long"), F.col("blocks") - 1)
        dealt = (number * F.col("step") + F.col("start")) % F.greatest(F.col("blocks"), F.lit(1))
        return F.struct(
            copy.cast("int").alias("copy"),
            number.alias("block"),
            F.size(F.filter(F.col("upto"), lambda x: x <= dealt)).cast("int").alias("shard"),
            F.xxhash64(F.lit(seed), F.col("__id"), F.col("__size"), copy).alias("position"),
        )

    inside = lambda c: (c * F.col("source_size") + F.col("__at")) * 2 + F.col("__size") <= F.col("target") * 2
    copies = F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(most) - 1).cast("long"))
    chosen = F.transform(F.filter(copies, lambda c: inside(c) & (F.col("source_size") > 0)), drawn)
    return placed.select(
        F.col("__id").alias(key), F.col("__source").alias(source), F.col("__size").alias(size), "source_size", "target", chosen.alias("draws")
    )


#: Equal rows that a task numbers at once.
STRIDE = 1 << 16


def mixed(df: DataFrame, key: str, source: str, text: str, **parameters) -> DataFrame:
    """The rows of ``df`` as often as they are drawn, sorted by shard and position within each partition.

    A row goes by its key. Rows that share a key or have none go by key and content; equal ones are numbered, and since it doesn't matter
    which is which, one of them is read for all. So draws depend on the rows alone, not on how they are stored, and a
    repeated row changes none but those of its source that come after it. Columns keep their names, whatever these are.
    """
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    narrow = lambda rows, *more: rows.select(*more, F.col("row")[source].alias("source"), n_words(F.col("row")[text]).alias("words"))
    name = F.col("row")[key].cast("string")
    keys = whole.groupBy(F.col("row")[key].alias("key")).agg(F.count("*").alias("n"))
    shared = stage(keys.filter((F.col("n") > 1) | F.col("key").isNull()).select("key"), "mix-shared-keys")
    alone, sized = whole.withColumn("id", name), None
    several = not shared.isEmpty()
    if several:
        same = F.col("row")[key].eqNullSafe(shared["key"])
        alone = whole.join(shared, same, "left_anti").withColumn("id", name)
        content = F.concat_ws("|", F.md5(F.to_json("row")), name)
        equal = whole.join(shared, same, "left_semi").groupBy(content.alias("of")).agg(F.min("row").alias("row"), F.count("*").alias("n"))
        equal = stage(equal, "mix-equal")
        starts = narrow(equal, "of", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRIDE).cast("long"))).alias("start")).repartition("of", "start")
        numbers = F.explode(F.sequence(F.col("start"), F.least(F.col("start") + STRIDE, F.col("n")) - 1))
        sized = starts.select("of", "source", "words", numbers.alias("number")).select(F.concat_ws("|", "number", "of").alias("id"), "of", "source", "words")
    ones = narrow(alone, "id", F.lit(None).cast("string").alias("of")).select("id", "of", "source", "words")
    sized = stage(ones if sized is None else ones.unionByName(sized), "mix-sizes", narrow=True)
    chosen = draws(sized, "id", "source", "words", **parameters).select("id", F.explode("draws").alias("draw"))
    joined = alone.join(chosen.withColumnRenamed("id", "drawn"), F.col("id") == F.col("drawn")).select("row", "draw")
    if several:
        of = sized.filter(F.col("of").isNotNull()).select("id", "of")
        joined = joined.unionByName(stage(chosen.join(of, "id").select("of", "draw"), "mix-draws").join(equal, "of").select("row", "draw"))
    shuffled = joined.repartition("draw.shard", "draw.block").sortWithinPartitions("draw.shard", "draw.position")
    return shuffled.select("row.*")
