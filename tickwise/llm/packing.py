"""Variable-capacity best-fit packing of documents into sequences of a few permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import running, spread, stage

#: Per bin, a fixed part, one per token, and attention's share, which grows with the square of the length.
FIXED, PER_TOKEN, PER_SQUARE = 64.0, 1.0, 1.0 / 16384


def cost(capacity: int) -> float:
    return FIXED + PER_TOKEN * capacity + PER_SQUARE * capacity * capacity


class Bins:
    """Best-fit decreasing over a histogram of lengths.

    Bins with equal room form ranges of consecutive numbers, so the work depends on
    the number of different lengths (at most the largest capacity), not on the
    number of items.
    """

    def __init__(self, counts: dict[int, int], capacities: Sequence[int], cost_of: Callable[[int], float] = cost):
        self.capacities, self.cost_of = sorted(capacities), cost_of
        self.left = dict(counts)
        self.lengths = sorted(n for n, c in counts.items() if c and n > 0)
        self.rooms: list[tuple[int, int, int, int]] = []  # room, first bin, bins, capacity
        self.opened = 0
        #: (length, rank of the first item, bins' first number, items a bin, offset in the bin)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.filled: list[tuple[int, int, int]] = []  # first bin, bins, content

    def run(self) -> Bins:
        for length in reversed(self.lengths):
            items, rank = self.left.pop(length), 0
            while items:
                at = bisect_left(self.rooms, (length,))
                if at == len(self.rooms):
                    self._open(length, items)
                    continue
                room, first, bins, capacity = self.rooms.pop(at)
                each = min(room // length, items)
                used = min(bins, items // each)
                self.slots.append((length, rank, first, each, capacity - room))
                rank, items = rank + used * each, items - used * each
                if bins > used:
                    insort(self.rooms, (room, first + used, bins - used, capacity))
                insort(self.rooms, (room - each * length, first, used, capacity))
        self.filled = sorted((first, bins, capacity - room) for room, first, bins, capacity in self.rooms)
        return self

    def placed(self, counts: dict[int, int]) -> dict[int, list[tuple[int, int, int, int, int]]]:
        """Per length its slots: (rank of the first item, first bin, items a bin, offset, capacity), cut where bins end up in other sizes."""
        starts = [first for first, _, _ in self.filled]
        out: dict[int, list] = {}
        slots = sorted(self.slots)
        for (length, rank, first, each, offset), following in zip(slots, [*slots[1:], None]):
            until = following[1] if following and following[0] == length else counts[length]
            number, last = first, first + (until - rank) // each
            at = bisect_right(starts, first) - 1
            while number < last:
                start, bins, content = self.filled[at]
                out.setdefault(length, []).append((rank + (number - first) * each, number, each, offset, self.downsized(content)))
                number, at = min(last, start + bins), at + 1
        return out

    def _open(self, length: int, items: int) -> None:
        """Opens bins of the size whose filling costs least per token, as many as these items need at most."""
        size = min((c for c in self.capacities if c >= length), key=lambda c: (self._rate(c, length, items), c))
        each = size // length
        insort(self.rooms, (size, self.opened, -(-items // each), size))
        self.opened += -(-items // each)

    def _rate(self, capacity: int, length: int, items: int) -> float:
        """Cost per token of a bin that takes these items and then the longest that still fit."""
        room = capacity - min(capacity // length, items) * length
        at = bisect_left(self.lengths, length) - 1
        while room and at >= 0:
            at = min(at, bisect_left(self.lengths, room + 1) - 1)
            if at < 0:
                break
            fits = min(room // self.lengths[at], self.left.get(self.lengths[at], 0))
            room, at = room - fits * self.lengths[at], at - 1
        content = capacity - room
        return self.cost_of(self.downsized(content)) / content

    def downsized(self, content: int) -> int:
        return next(c for c in self.capacities if c >= content)


def pieces(df: DataFrame, key: str, length: str, largest: int) -> DataFrame:
    """(key, piece, start, length): a document longer than ``largest`` is cut into pieces of that length and a rest.

    Every token is in one piece; a document without tokens, or of null length, has none.
    """
    n = F.coalesce(F.col(length).cast("long"), F.lit(0))
    count = F.ceil(n / F.lit(largest)).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    cut = df.select(F.col(key).alias("key"), n.alias("__n"), F.explode(numbers).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return cut.select("key", "piece", start.alias("start"), F.least(F.lit(largest).cast("long"), F.col("__n") - start).alias("length"))


def pack(
    df: DataFrame, key: str, length: str, capacities: Sequence[int] = (512, 1024, 2048, 4096, 8192), cost_of: Callable[[int], float] = cost
) -> DataFrame:
    """(key, piece, start, length, bin, capacity, offset): where each piece of each document lies.

    The histogram of lengths, at most the largest capacity long, is packed best-fit
    decreasing: longest first, into the fullest bin with room; if none has room, bins of the size open
    that cost least per token given what is left to fill them; at last each bin shrinks to the
    least permitted size that holds its contents. Pieces take the slots of their
    length in the order of a hash of (key, piece), numbered without gathering any length. Rows with equal
    keys are documents of their own. An empty table gives no rows. ``cost_of`` gives the cost of a capacity.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    spark = df.sparkSession
    largest = max(capacities)
    cut = pieces(df, key, length, largest).withColumn("__spread", spread(F.col("key"), F.col("piece")))
    cut = stage(cut, "pieces", narrow=True)
    counts = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}
    bins = Bins(counts, capacities, cost_of).run()
    ranked = running(cut, "length", "__spread", ["key", "piece"], into="__rank")

    # a row a length; the number of slots depends on the largest capacity, not on the rows
    table = spark.createDataFrame(_slot_table(bins.placed(counts)))
    found = ranked.join(F.broadcast(table), F.col("length") == F.col("__length"))
    found = found.withColumn("__slot", F.array_max(F.filter("__slots", lambda x: x["rank"] <= F.col("__rank"))))
    order, each = F.col("__rank") - F.col("__slot.rank"), F.col("__slot.each")
    return found.select(
        F.col("key").alias(key), "piece", "start", "length",
        (F.col("__slot.bin") + ((order - order % each) / each).cast("long")).alias("bin"),
        F.col("__slot.capacity").alias("capacity"),
        (F.col("__slot.offset") + order % each * F.col("length")).alias("offset"),
    )


def _slot_table(slots: dict[int, list[tuple]]) -> pa.Table:
    slot = pa.struct([(x, pa.int64()) for x in ("rank", "bin", "each", "offset", "capacity")])
    rows = [[dict(zip(("rank", "bin", "each", "offset", "capacity"), x)) for x in found] for found in slots.values()]
    return pa.table({"__length": pa.array(list(slots), pa.int64()), "__slots": pa.array(rows, pa.list_(slot))})
