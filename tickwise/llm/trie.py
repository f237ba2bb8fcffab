"""Conversation prefix trie from vertical bitmaps.

A node is a distinct sequence of first turns. Conversations are dealt to shards by ranges of their ids.
In a shard each (position, turn) has a bitset of the conversations that have that turn there; a node's children
come from intersecting its own bitset with postings of the next position, depth first. Their popcounts,
smallest members and end lists are partial results of the shard, so a first turn or a
whole conversation that a third of all rows share is one row a shard when shards are merged.

Nodes go by a hash of their path. Turns whose (position, turn) no other conversation has, and all turns
after them, are nodes of one conversation: they are written at once and never enter a bitset.

Sums over subtrees: each shard sums its own nodes. What shards share is counted in each of them, so the
excess is put on one of them, summed up its shard's tree, and added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.llm.common import stage, text_or_empty

#: Conversations and turns in a shard at most, about; ids in a piece of an end list.
SHARD_CONVERSATIONS, SHARD_TURNS, PIECE = 4096, 1 << 16, 512
ROOT = b"\x00" * 16
#: Turns of a conversation that are numbered together.
BLOCK = 256
NODES = "shard long, node binary, parent binary, depth long, n long, least long, parent_least long, bytes long, children long, leaves long, weighted long, own long, ends array<string>"


# --- conversations -----------------------------------------------------------


def numbered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, digest, bytes): each conversation's turns from 0 on, null turn first; null role or text is empty.

    Turns of equal number are ordered by content, so repeated rows and ties always come out alike. Rows
    without conversation are left out. Turns are numbered in blocks, so that one conversation may have any share of them.
    """
    said = F.concat(F.octet_length(text_or_empty(role)).cast("string"), F.lit(":"), text_or_empty(role), text_or_empty(text))
    rows = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(F.md5(said)).alias("digest"),
        F.octet_length(text_or_empty(text)).cast("long").alias("bytes"),
    )
    # turns without number are told apart by their content's first byte
    block = F.struct(F.floor(F.col("turn") / BLOCK).alias("turns"), F.when(F.col("turn").isNull(), F.substring("digest", 1, 1)).alias("first"))
    rows = rows.withColumn("block", block)
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("conv", "block").orderBy("turn", "digest", "bytes")
    counted = rows.withColumn("i", F.row_number().over(within) - 1)
    offset = blocks.select(F.col("conv").alias("of"), F.col("block").alias("block_of"), "before")
    joined = counted.join(offset, (F.col("conv") == F.col("of")) & F.col("block").eqNullSafe(F.col("block_of")))
    return joined.select("conv", (F.col("i") + F.col("before")).cast("long").alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame, group: int, most: int) -> DataFrame:
    """Conversations with the first h turns of the group's first one in place of their own first h.

    h is crc32 of the decimal id modulo ``most``; a conversation that had rows stays, also if none
    of its turns do. Gives (conv, pos, digest, bytes, len) with a row of pos -1 for each conversation.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    base = F.col("conv") - F.col("conv") % group
    plan = sizes.select("conv", "n", base.alias("base"), (F.crc32(F.col("conv").cast("string")) % most).cast("long").alias("h"))
    of_base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = plan.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = plan.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = stage(plan.select("conv", "base", "h", "taken", "len"), "conversations")
    heads = turns.filter((F.col("conv") % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "base")
    lent = heads.join(plan, "base").filter(F.col("pos") < F.col("taken")).select("conv", "pos", "digest", "bytes", "len")
    own = turns.join(plan, "conv").filter(F.col("pos") >= F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes", "len")
    tops = plan.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), "len")
    return lent.unionByName(own).unionByName(tops)


def whole(turns: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that ``nodes`` takes."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("len"))
    tops = sizes.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), "len")
    return turns.join(sizes, "conv").select("conv", "pos", "digest", "bytes", "len").unionByName(tops)


# --- a shard's bitmaps -------------------------------------------------------


class Shard:
    """Conversations of a shard in order of id; bit i of a bitset stands for the i-th."""

    def __init__(self, convs: list[int], lens: list[int], turns: list[list[tuple[bytes, int]]]):
        self.convs, self.turns = convs, turns
        self.postings: dict[tuple[int, bytes], int] = {}
        self.ending: dict[int, int] = {}
        for i, (n, held) in enumerate(zip(lens, turns)):
            bit = 1 << i
            for pos, (digest, _) in enumerate(held):
                self.postings[pos, digest] = self.postings.get((pos, digest), 0) | bit
            if len(held) == n:
                self.ending[n] = self.ending.get(n, 0) | bit

    def members(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield self.convs[low.bit_length() - 1]
            bits ^= low

    def nodes(self) -> list[list]:
        """Rows of ``NODES`` but the shard, parents before their children."""
        rows: list[list] = []
        stack = [(ROOT, None, -1, 0, (1 << len(self.convs)) - 1, 0)]
        while stack:
            node, parent, above, depth, members, size = stack.pop()
            ends = members & self.ending.get(depth, 0)
            at, least = len(rows), self.convs[(members & -members).bit_length() - 1]
            n = members.bit_count()
            listed = [str(x) for x in self.members(ends)]
            pieces = [",".join(listed[i : i + PIECE]) for i in range(0, len(listed), PIECE)]
            row = [node, parent, depth, n, least, rows[above][4] if above >= 0 else None, size, 0, 0, n * size, size, pieces, above]
            rows.append(row)
            left = members ^ ends
            while left:
                held = self.turns[(left & -left).bit_length() - 1]
                row[7] += 1
                if depth == len(held):  # goes on alone, outside the bitmaps
                    row[8] += 1
                    left &= left - 1
                    continue
                digest, more = held[depth]
                child = left & self.postings[depth, digest]
                left ^= child
                stack.append((hashlib.blake2b(node + digest, digest_size=16).digest(), node, at, depth + 1, child, more))
            row[8] += row[7] == 0
        for row in reversed(rows):  # children come after their parent
            if row[12] >= 0:
                up = rows[row[12]]
                up[8], up[9], up[10] = up[8] + row[8], up[9] + row[9], up[10] + row[10]
        return [row[:12] for row in rows]


def _shards(most_conversations: int, most_turns: int):
    """Turns sorted by conversation and position to nodes, a shard at a time."""
    columns = [c.split()[0] for c in NODES.split(", ")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        convs: list[int] = []
        lens: list[int] = []
        turns: list[list[tuple[bytes, int]]] = []
        size = 0

        def ended() -> pd.DataFrame:
            return pd.DataFrame([[convs[0], *row] for row in Shard(convs, lens, turns).nodes()], columns=columns)

        for batch in batches:
            for conv, pos, digest, more, n in batch.itertuples(index=False):
                if pos < 0:
                    if convs and (len(convs) >= most_conversations or size >= most_turns):
                        yield ended()
                        convs, lens, turns, size = [], [], [], 0
                    convs.append(conv)
                    lens.append(n)
                    turns.append([])
                else:
                    turns[-1].append((digest, more))
                    size += 1
        if convs:
            yield ended()

    return of


# --- the trie ----------------------------------------------------------------


def nodes(turns: DataFrame, most_conversations: int = SHARD_CONVERSATIONS, most_turns: int = SHARD_TURNS) -> DataFrame:
    """One row a node of the trie over conversations (conv, pos, digest, bytes, len) as ``rebuilt`` or ``whole`` gives them.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (over the subtree, members but one times the bytes of the last turn) and ends_sha256, the hash of the ids of members that
    end there. No conversations, no nodes. A conversation's turns up to the first that only it has
    are held by one task, as 30 bytes each.
    """
    turns = stage(turns, "trie-turns")
    rows = turns.filter(F.col("pos") >= 0)
    alone = rows.groupBy("pos", "digest").agg(F.count("*").alias("n"), F.min("conv").alias("conv")).filter(F.col("n") == 1)
    first = stage(alone.groupBy("conv").agg(F.min("pos").alias("alone")), "first-own-turns")
    marked = turns.join(first, "conv", "left")
    tail = F.col("pos") > F.col("alone")
    tails = marked.filter(tail).select(
        F.col("conv").alias("conv_id"),
        (F.col("pos") + 1).alias("depth"),
        F.col("conv").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("pos") + 1 < F.col("len"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(F.col("pos") + 1 < F.col("len"), "").otherwise(F.col("conv").cast("string")), 256).alias("ends_sha256"),
    )
    shared = marked.filter(F.col("alone").isNull() | ~tail).select("conv", "pos", "digest", "bytes", "len")
    parts = shared.repartitionByRange("conv").sortWithinPartitions("conv", "pos").mapInPandas(_shards(most_conversations, most_turns), NODES)
    return _merged(stage(parts, "trie-parts")).unionByName(tails)


def _merged(parts: DataFrame) -> DataFrame:
    """Nodes of all shards as one row each."""
    # a node with members in one shard has its final counts; so have all below it
    shards = parts.groupBy("node").agg(
        F.count("*").alias("k"), F.min("shard").alias("owner"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"),
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.first("depth").alias("depth"),
        (F.min("children") > 0).alias("inner"), (F.max("children") > 0).alias("any_inner"), F.sum(F.when(F.col("children") == 0, 1).otherwise(0)).alias("bare"),
    ).filter(F.col("k") > 1)
    shards = stage(shards, "trie-shared")
    # too much is counted for a shared node: its bytes in each shard but one, its leaf wherever it has no child there
    leaf = F.when(F.col("any_inner"), 0).otherwise(1)
    excess = shards.select("node", "owner", ((F.col("k") - 1) * F.col("bytes")).alias("more_own"), (F.col("bare") - leaf).alias("more_leaves"))
    held = parts.select("shard", "node", "parent", "depth").join(excess, "node")
    mine = F.col("shard") == F.col("owner")
    held = held.select("shard", "node", "parent", "depth", F.when(mine, F.col("more_own")).otherwise(0).alias("more_own"), F.when(mine, F.col("more_leaves")).otherwise(0).alias("more_leaves"))
    sums = held.groupBy("shard").applyInPandas(_summed_up, "node binary, more_own long, more_leaves long")
    sums = sums.groupBy("node").agg(F.sum("more_own").alias("more_own"), F.sum("more_leaves").alias("more_leaves"))
    again = shards.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("k") - 1).alias("more_children"))
    totals = parts.join(shards.select("node"), "node", "left_semi").groupBy("node").agg(
        F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("weighted").alias("weighted"), F.sum("own").alias("own")
    )
    facts = shards.select("node", "parent", "depth", "n_convs", "conv_id")
    merged = facts.join(totals, "node").join(sums, "node").join(again, "node", "left").join(_end_digests(parts.join(shards.select("node"), "node", "left_semi")), "node", "left")
    merged = merged.select(
        "node", "parent", "depth", "n_convs", "conv_id",
        (F.col("children") - F.coalesce("more_children", F.lit(0))).alias("n_children"),
        (F.col("leaves") - F.col("more_leaves")).alias("n_leaves"),
        (F.col("weighted") - F.col("own") + F.col("more_own")).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    merged = stage(merged, "trie-merged")
    single = parts.join(shards.select("node"), "node", "left_anti").select(
        "parent", "depth", F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("weighted") - F.col("own")).alias("saved_tokens"), F.sha2(F.array_join("ends", ","), 256).alias("ends_sha256"), "parent_least",
    )
    every = single.unionByName(merged.drop("node").withColumn("parent_least", F.lit(None).cast("long")))
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    return every.join(above, "parent", "left").select(
        "conv_id", "depth", F.coalesce("above", "parent_least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def _summed_up(part: pd.DataFrame) -> pd.DataFrame:
    """A shard's excess, summed over the subtree of each of its shared nodes."""
    part = part.sort_values("depth", ascending=False, kind="stable")
    own, leaves = dict(zip(part["node"], part["more_own"])), dict(zip(part["node"], part["more_leaves"]))
    for node, parent in zip(part["node"], part["parent"]):
        if parent is not None:
            own[parent] += own[node]
            leaves[parent] += leaves[node]
    return pd.DataFrame({"node": list(own), "more_own": np.fromiter(own.values(), np.int64, len(own)), "more_leaves": np.fromiter(leaves.values(), np.int64, len(leaves))})


def _end_digests(parts: DataFrame) -> DataFrame:
    """(node, ends): the hash of each node's end lists, shard after shard, read piece by piece."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            out = []
            for now, ids in zip(batch["node"], batch["ids"]):
                if now != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends"])
        if state is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends"])

    pieces = parts.select("node", "shard", F.posexplode("ends").alias("piece", "ids"))
    in_order = pieces.repartition("node").sortWithinPartitions("node", "shard", "piece").select("node", "ids")
    return in_order.mapInPandas(hashed, "node binary, ends string")


def trie(df: DataFrame, conv: str, turn: str, role: str, text: str, rebuild: tuple[int, int] | None = None) -> DataFrame:
    """``nodes`` of the conversations of a table of turns; ``rebuild`` is (group, most) of ``rebuilt``."""
    turns = stage(numbered(df, conv, turn, role, text), "numbered-turns")
    return nodes(rebuilt(turns, *rebuild) if rebuild else whole(turns))

