"""Shards of nearly equal bytes: a minimax contiguous partition of groups of equal texts.

Groups are ordered by the 64-bit hash of the text, and each shard takes the next groups of
that order. The smallest capacity at which a greedy pass needs no more than the given number
of shards is found by binary search; the cuts of that pass are the shards.

The pass only asks one thing of the groups: where the running size passes a value. It is
answered from sums over ranges of the hash. The driver holds the sums of 4096 ranges, and a
range in which a search ends is split again into 4096, down to single hashes. So the driver
holds a few thousand numbers for each range that was opened, however many groups there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import stored

WIDTH = 12  # bits of the hash that one level tells apart
CELL_ROWS = 50_000  # rows of a shard that are numbered together


class RunningSizes:
    """Searches in the running sizes of the groups, opened level by level."""

    def __init__(self, groups: DataFrame):
        self.groups = groups  # (place: hash read as unsigned, size)
        self.open: dict[tuple[int, int], np.ndarray] = {}
        self.split({(0, 0)})
        self.total = int(self.open[0, 0][-1])

    def split(self, wanted: set[tuple[int, int]]) -> None:
        """Open ranges (level, prefix): the running sizes of their parts, one pass for each level."""
        for level in sorted({lv for lv, _ in wanted}):
            prefixes = sorted(p for lv, p in wanted if lv == level)
            bits = min(WIDTH, 64 - WIDTH * level)
            shift = 64 - WIDTH * level - bits
            rows = self.groups
            if level:
                rows = rows.where(F.shiftrightunsigned("place", 64 - WIDTH * level).isin(prefixes))
            sums = {p: np.zeros(1 << bits, np.int64) for p in prefixes}
            for r in rows.groupBy(F.shiftrightunsigned("place", shift).alias("part")).agg(F.sum("size").alias("size")).collect():
                number = r["part"] & ((1 << (64 - shift)) - 1)
                sums[number >> bits if level else 0][number & ((1 << bits) - 1)] = r["size"]
            self.open |= {(level, p): np.cumsum(v) for p, v in sums.items()}

    def cut(self, limit: int, most: bool, shut: set[tuple[int, int]]) -> tuple[int, int]:
        """(first hash that no longer fits, size of what fits) if groups are taken in order up to `limit`.

        If the search ends in a range that is not open, the range goes to `shut`, and all that could
        fit (`most`), or nothing of the range, is taken for what fits.
        """
        level, prefix, base = 0, 0, 0
        while (level, prefix) in self.open:
            ends = self.open[level, prefix]
            fits = int(np.searchsorted(ends, limit - base, "right"))
            if fits == len(ends):
                return (prefix + 1) << (64 - WIDTH * level), base + int(ends[-1])
            base += int(ends[fits - 1]) if fits else 0
            prefix = (prefix << min(WIDTH, 64 - WIDTH * level)) + fits
            level += 1
            if WIDTH * level >= 64:
                return prefix, base
        shut.add((level, prefix))
        return prefix << (64 - WIDTH * level), limit if most else base

    def greedy(self, capacity: int, shards: int, most: bool, shut: set[tuple[int, int]]) -> tuple[bool, list[int]]:
        cuts, done = [], 0
        for _ in range(shards):
            cut, done = self.cut(done + capacity, most, shut)
            cuts.append(cut)
        return done >= self.total, cuts[:-1]

    def least(self, low: int, high: int, shards: int, most: bool) -> int:
        while low < high:
            middle = (low + high) // 2
            if self.greedy(middle, shards, most, set())[0]:
                high = middle
            else:
                low = middle + 1
        return low


def capacity_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, first hash of shards 1, 2, ...) with the smallest capacity that is enough.

    Binary searches that take the most and the least of the ranges not yet open bound the
    capacity from both sides; the ranges in which the cuts of both bounds fall are opened, until
    the bounds meet and every cut is at a single hash.
    """
    search = RunningSizes(groups)
    largest = int(groups.agg(F.max("size")).first()[0] or 0)
    low, high = max(largest, -(-search.total // shards)), max(search.total, largest)
    while True:
        low, high = search.least(low, high, shards, True), search.least(low, high, shards, False)
        shut: set[tuple[int, int]] = set()
        for capacity in {low, (low + high) // 2, high}:
            for most in (True, False):
                _, cuts = search.greedy(capacity, shards, most, shut)
        if low == high and not shut:
            return low, cuts
        search.split(shut)


def byte_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): every row with its shard and slot.

    `size` is the UTF-8 length plus 1; null texts count as empty. Equal texts stay together (so do
    texts of an equal 64-bit hash), and the largest shard is as small as the order allows. Slots
    are numbered from 0 without gaps, by hash cells of the row, so that a shard is not one task.
    An empty table gives no rows; repeated rows have a slot each.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), body.alias("__t")).select(
        key, F.xxhash64("__t").alias("place"), (F.octet_length("__t") + 1).cast("bigint").alias("size"),
        F.crc32(F.encode("__t", "UTF-8")).cast("bigint").alias("text_crc32"))
    rows = stored(rows, "sizes")
    groups = stored(rows.groupBy("place").agg(F.sum("size").alias("size")), "groups")
    _, cuts = capacity_cuts(groups, shards)
    # hashes are unsigned in the order of the cuts: flipping the top bit keeps that order in longs
    order = F.col("place").bitwiseXOR(F.lit(-(1 << 63)))
    shard = sum((F.when(order >= F.lit(c - (1 << 63)), 1).otherwise(0) if c < 1 << 64 else F.lit(0) for c in cuts), F.lit(0))
    cells = max(1, rows.count() // (shards * CELL_ROWS))
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64(key, "place"), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy(key, "place")
    numbered = rows.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(firsts, ["shard", "cell"]).select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("inside")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
