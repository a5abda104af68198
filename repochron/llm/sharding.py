"""Minimax contiguous partition of atomic groups into shards.

Rows of equal text form one group; a group is never split over shards.  Groups stand in one
order (larger size classes first, then by hash), and a shard is a stretch of that order.
The smallest capacity for which a greedy walk needs no more than the wanted number of shards
is found by binary search; the cuts are then laid under that capacity.

The walk never sees single groups of the whole corpus.  The driver holds the sums of
2**FIRST_BITS ranges of order keys, and looks into a range (2**LEVEL_BITS parts) only where
a cut may lie in it, until the cuts are exact.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron.llm.common import stage

ROW_BYTES = 16
KEY_BITS, FIRST_BITS, LEVEL_BITS = 60, 16, 11
#: rows that are numbered in one task
NUMBERED_ROWS = 50_000


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


class Order:
    """Prefix sums along the group order, refined where they are asked for."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.starts: list[int] = []  # first key of each known range
        self.sums: list[int] = []  # bytes before it
        self.bits: list[int] = []  # a range lies within 2**bits keys; 0: a single key
        self.total = self._put([], self._parts(F.lit(True), KEY_BITS - FIRST_BITS))

    def _parts(self, rows: Column, width: int) -> list[tuple[int, int, int]]:
        """(first key, bytes, bits) of the parts of 2**width keys that hold some of these rows."""
        parts = self.groups.filter(rows).groupBy(F.shiftright("key", width).alias("part")).agg(
            F.sum("bytes").alias("bytes"), F.min("key").alias("first"), F.count("*").alias("keys"))
        return sorted((row["first"] if row["keys"] == 1 else row["part"] << width, row["bytes"], 0 if row["keys"] == 1 else width) for row in parts.collect())

    def _put(self, kept: list[tuple[int, int, int]], parts: list[tuple[int, int, int]]) -> int:
        ranges = sorted(kept + parts)
        self.starts, self.bits, self.sums = [r[0] for r in ranges], [r[2] for r in ranges], []
        before = 0
        for _, size, _ in ranges:
            self.sums.append(before)
            before += size
        return before

    def split(self, at: set[int]) -> None:
        """Looks into the ranges with these numbers."""
        kept = [(self.starts[i], self.before(i + 1) - self.sums[i], self.bits[i]) for i in range(len(self.starts)) if i not in at]
        parts: list[tuple[int, int, int]] = []
        for bits in {self.bits[i] for i in at}:
            wanted = [self.starts[i] >> bits for i in at if self.bits[i] == bits]
            parts += self._parts(F.shiftright("key", bits).isin(wanted), max(0, bits - LEVEL_BITS))
        self._put(kept, parts)

    def cut(self, reach: int) -> tuple[int, int | None]:
        """Number of the last known border at or below ``reach`` bytes, and the range a finer border may lie in."""
        if reach >= self.total:
            return len(self.starts), None
        i = bisect_right(self.sums, reach) - 1
        return i, (i if self.bits[i] > 0 and self.sums[i] < reach else None)

    def before(self, i: int) -> int:
        return self.sums[i] if i < len(self.sums) else self.total


def _walk(order: Order, capacity: int, shards: int) -> tuple[list[int] | None, set[int]]:
    """Borders of a greedy walk (None: it needs more shards), and the coarse ranges it met."""
    at, borders, coarse = 0, [], set()
    for _ in range(shards):
        i, range_ = order.cut(order.before(at) + capacity)
        if range_ is not None:
            coarse.add(range_)
        if i <= at and i < len(order.starts):
            return None, coarse
        at = i
        if at >= len(order.starts):
            return borders, coarse
        borders.append(at)
    return None, coarse


def _even_cuts(order: Order, capacity: int, shards: int) -> tuple[list[int] | None, set[int]]:
    """Borders near the mean of what is left, none beyond the capacity; None if they do not fit."""
    at, borders, coarse = 0, [], set()
    for left in range(shards, 0, -1):
        if at >= len(order.starts):
            return borders, coarse
        base, rest = order.before(at), order.total - order.before(at)
        if left == 1:
            return (borders if rest <= capacity else None), coarse
        goal = base + -(-rest // left)
        low, range_ = order.cut(goal)
        if range_ is not None:
            coarse.add(range_)
        high = min(low + 1, len(order.starts)) if order.before(low) < goal else low
        near = high if order.before(high) <= base + capacity and (low <= at or order.before(high) - goal <= goal - order.before(low)) else low
        if near <= at:
            return None, coarse
        at = near
        if at < len(order.starts):
            borders.append(at)
    return (borders if at >= len(order.starts) else None), coarse


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, first order keys of the shards 1, 2, ...) for groups (key, bytes).

    An empty table has capacity 0 and no cuts.
    """
    order = Order(groups)
    largest = groups.agg(F.max("bytes")).first()[0] or 0
    if not order.total:
        return 0, []
    low = max(largest, -(-order.total // shards))
    high = min(order.total, -(-order.total // shards) + largest)
    while low < high:
        middle = (low + high) // 2
        borders, coarse = _walk(order, middle, shards)
        if borders is not None:
            high = middle
        elif coarse:
            order.split(coarse)
        else:
            low = middle + 1
    for cuts in (_even_cuts, _walk):
        while True:
            borders, coarse = cuts(order, low, shards)
            if not coarse:
                break
            order.split(coarse)
        if borders is not None:
            return low, [order.starts[i] for i in borders]
    raise AssertionError("a greedy walk fits the capacity it was found with")


def shard_documents(docs: DataFrame, shards: int, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with (size, shard, slot, capacity): sizes near equal, rows of equal text together.

    A null text counts as an empty one: size 16, one group with empty texts.  Repeated rows are
    rows of their own.  An empty table gives an empty result.  Columns of ``docs`` named like a
    result column are replaced.  Texts whose 60-bit order keys agree share a shard.  Slots count
    from 0 without gaps in each shard, by hash buckets of (id, text), so no task numbers a shard.
    """
    keyed = docs.drop("size", "shard", "slot", "capacity").withColumn("_hash", text_hash(F.col(text_column))).withColumn("size", row_size(F.col(text_column)))
    sizes = keyed.groupBy("_hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    level = F.lit(63) - F.floor(F.log2("bytes")).cast("int")
    key = F.shiftleft(level.cast("long"), KEY_BITS - 6).bitwiseOR(F.shiftrightunsigned("_hash", 64 - (KEY_BITS - 6)))
    groups = stage(sizes.withColumn("key", key))
    capacity, cuts = minimax_cuts(groups.groupBy("key").agg(F.sum("bytes").alias("bytes")), shards)
    total = groups.agg(F.sum("rows")).first()[0] or 0
    buckets = max(1, total // NUMBERED_ROWS + 1)
    limits = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    shard_of = groups.select("_hash", F.size(F.filter(limits, lambda c: c <= F.col("key"))).alias("shard"))
    placed = keyed.join(shard_of, "_hash").withColumn("_bucket", F.pmod(F.xxhash64(F.col(id_column), F.col("_hash")), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(id_column, "_hash")
    numbered = placed.withColumn("_row", F.row_number().over(inside)).join(offsets, ["shard", "_bucket"])
    return numbered.withColumn("slot", (F.col("_row") - 1 + F.col("_before")).cast("long")).withColumn("capacity", F.lit(capacity).cast("long")).drop("_hash", "_bucket", "_row", "_before")


def shard_of_greedy(sizes: list[int], capacity: int) -> list[int]:
    """Brute force for tests: shard numbers of a greedy walk."""
    out, shard, filled = [], 0, 0
    for size in sizes:
        if filled + size > capacity and filled:
            shard, filled = shard + 1, 0
        filled += size
        out.append(shard)
    return out
