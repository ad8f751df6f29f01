"""Minimax contiguous sharding of groups of equal texts, in the order of their hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Hash bits of the first histogram, and how many more each refinement of a range resolves.
FIRST_BITS, STEP_BITS = 16, 8
#: Ranges refined in one round at most; the rounds go on until the answer is exact.
ROUND = 4096
#: Ranks are taken in independent parts of a shard, of about so many rows.
PART_ROWS = 100_000


class Ranges:
    """Consecutive ranges of the ordered groups: first key, resolved bits, weight, groups, heaviest group.

    A range of one group is atomic. A wider one may hold a cut anywhere between its groups, which only its refinement tells.
    """

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        rows = sorted(rows)
        self.rows = rows
        self.atomic = np.array([r[3] == 1 for r in rows], bool)
        self.ends = np.concatenate(([0], np.cumsum([r[2] for r in rows], dtype=np.int64))).astype(np.int64)
        self.total, self.heaviest = int(self.ends[-1]), max((r[4] for r in rows), default=0)

    def greedy(self, capacity: int, shards: int, whole: bool) -> list[int] | None:
        """Ends of the shards in bytes, each as full as can be; None if they don't take all.

        whole: cut only between ranges, which is always possible; else also anywhere inside a range
        of several groups, which bounds every real cut from above.
        """
        at, out = 0, []
        for _ in range(shards):
            to = min(at + capacity, self.total)
            k = int(np.searchsorted(self.ends, to, "right")) - 1
            if k < len(self.rows) and (whole or self.atomic[k]):
                to = max(int(self.ends[k]), at)
            out.append(to)
            if to == self.total:
                return out + [to] * (shards - len(out))
            if to <= at:
                return None
            at = to
        return None

    def smallest(self, shards: int, whole: bool) -> int:
        """Binary search for the smallest capacity that the greedy check finds feasible."""
        low, high = max(self.heaviest, -(-self.total // shards)), self.total
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, whole) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def unsure(self, low: int, high: int, shards: int) -> list[int]:
        """Wide ranges in which a cut for a capacity from low to high may lie, the heaviest first."""
        early, late = self._reach(low, shards, True), self._reach(high, shards, False)
        found: set[int] = set()
        for a, b in zip(early, late, strict=True):
            first, last = int(np.searchsorted(self.ends, a, "right")) - 1, int(np.searchsorted(self.ends, b, "left"))
            found.update(k for k in range(max(first, 0), min(last + 1, len(self.rows))) if not self.atomic[k])
        return sorted(found, key=lambda k: (-self.rows[k][2], k))[:ROUND]

    def _reach(self, capacity: int, shards: int, whole: bool) -> list[int]:
        """As greedy, for any capacity: what doesn't fit ends the walk."""
        at, out = 0, []
        for _ in range(shards):
            to = min(at + capacity, self.total)
            k = int(np.searchsorted(self.ends, to, "right")) - 1
            if k < len(self.rows) and (whole or self.atomic[k]):
                to = max(int(self.ends[k]), at)
            out.append(to)
            at = to
        return out

    def cuts(self, capacity: int, shards: int) -> list[int | None]:
        """First keys of shards 1, 2, ...: of the cuts that keep to the capacity, those nearest to equal sizes."""
        n, ends = len(self.rows), self.ends
        least = [n]  # the earliest place from which the last k shards still suffice
        for _ in range(shards - 1):
            least.append(int(np.searchsorted(ends, ends[least[-1]] - capacity, "left")))
        at, out = 0, []
        for left in range(shards, 1, -1):
            aim = ends[at] + (self.total - ends[at]) / left
            k = int(np.searchsorted(ends, aim, "left"))
            if k > at and aim - ends[k - 1] <= ends[min(k, n)] - aim:
                k -= 1
            k = min(max(k, least[left - 1], at), int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1)
            out.append(self.rows[k][0] if k < n else None)
            at = k
        return out


def _histogram(groups: DataFrame, bits: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges of the keys that share their first bits; a row for each range that has groups."""
    cut = F.shiftright("key", 64 - bits) if bits < 64 else F.col("key")
    found = groups.groupBy(cut.alias("range")).agg(F.sum("bytes").alias("w"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("m")).collect()
    return [(r["range"] << (64 - bits), bits, r.w, r.n, r.m) for r in found]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int | None]]:
    """The smallest feasible capacity over groups (key long, bytes long) in order of key, and first keys of shards 1 onwards.

    The driver holds weights of hash ranges, never a list of all groups: a bounded histogram first, then only the
    ranges in which a cut may lie, finer and finer, until bounds from below and above meet.
    """
    spark = groups.sparkSession
    ranges = Ranges(_histogram(groups, FIRST_BITS))
    while ranges.rows:
        low, high = ranges.smallest(shards, False), ranges.smallest(shards, True)
        if low == high:
            return high, ranges.cuts(high, shards)
        chosen = ranges.unsure(low, high, shards)
        wide = set(chosen)
        rows = [r for k, r in enumerate(ranges.rows) if k not in wide]
        for bits in sorted({ranges.rows[k][1] for k in chosen}):
            wanted = spark.createDataFrame([(ranges.rows[k][0],) for k in chosen if ranges.rows[k][1] == bits], "first long")
            mask = F.shiftleft(F.shiftright("key", 64 - bits), 64 - bits)
            rows += _histogram(groups.join(wanted, mask == wanted["first"], "left_semi"), min(64, bits + STEP_BITS))
        ranges = Ranges(rows)
    return 0, [None] * (shards - 1)


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law `bytes`, shard, slot, grown_shard (null).

    Atomic groups are equal texts (null texts are one), so copies stay together and a group may make its shard larger than the rest.
    A shard is a range of text hashes: placing a row needs no join. Null text: size 1, checksum 0. Repeated rows get slots of their own.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(
        own.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64("text").alias("key"),
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, cuts = minimax_cuts(groups, shards)
    # A group of copies is one shard's, so a shard may have nearly all rows: its parts are as many as all rows need.
    parts = max(16, -(-rows.count() // PART_ROWS))
    placed = rows.withColumn("shard", shard_of(F.col("key"), cuts)).withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "key")
    ranked = placed.withColumn("k", F.row_number().over(inside) - 1).join(firsts, ["shard", "part"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("k") + F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_of(key: Column, cuts: list[int | None]) -> Column:
    """How many cuts are at or below the key."""
    known = [c for c in cuts if c is not None]
    if not known:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, known)), lambda c: c <= key)).cast("int")


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
