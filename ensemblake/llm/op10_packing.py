"""Best-fit packing by exact complements, planned on the histogram of piece lengths alone."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table, tokenizer_path, written
from .encoding import by_words, encoder, keyed

CAPACITY = 4096
#: Rows of one length are ranked in so many independent parts: copies may give a length a third of all rows.
SALTS = 256


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how often each is used; together they use up the counts, none is over capacity.

    From the longest length down: its gap is filled exactly by a single length, a pair or a triple, as often as the counts allow.
    What has no exact complement is filled best-fit: the longest length that still fits, until none does.
    The work and the plan depend on the number of distinct lengths, never on the number of pieces.
    """
    have = [0] * (capacity + 1)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} is outside 1..{capacity}")
        have[size] += n
    out: list[tuple[tuple[int, ...], int]] = []
    # The lengths that there are as bits of a number, and the same mirrored: shifted over each other, they show all pairs of one sum at once.
    there = sum(1 << x for x in range(capacity + 1) if have[x])
    mirror = sum(1 << (capacity - x) for x in range(capacity + 1) if have[x])

    def usable(lengths: tuple[int, ...]) -> int:
        return min(have[x] // lengths.count(x) for x in lengths)

    def gone(x: int) -> None:
        nonlocal there, mirror
        have[x] = 0
        there &= ~(1 << x)
        mirror &= ~(1 << (capacity - x))

    def use(lengths: tuple[int, ...]) -> None:
        n = usable(lengths)
        out.append((lengths, n))
        for x in lengths:
            have[x] -= n
            if not have[x]:
                gone(x)

    def pair(gap: int, first: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two available lengths that sum to the gap, the larger one as large as can be."""
        low = there & (mirror >> (capacity - gap)) & ((1 << (gap // 2 + 1)) - 1)
        while low:
            a = (low & -low).bit_length() - 1
            if usable((*first, gap - a, a)):
                return (*first, gap - a, a)
            low &= low - 1
        return None

    def complement(size: int) -> tuple[int, ...] | None:
        gap = capacity - size
        if not gap:
            return (size,)
        if usable((size, gap)):
            return (size, gap)
        if found := pair(gap, (size,)):
            return found
        some = there & ((1 << max(0, gap - 1)) - 1)
        while some:
            c = some.bit_length() - 1
            if usable((size, c)) and (found := pair(gap - c, (size, c))):
                return found
            some ^= 1 << c
        return None

    def fitting(gap: int, lengths: tuple[int, ...]) -> int:
        """The longest length that fits the gap, or 0."""
        some = there & ((1 << (gap + 1)) - 1)
        while some:
            x = some.bit_length() - 1
            if usable((*lengths, x)):
                return x
            some ^= 1 << x
        return 0

    left: dict[int, int] = {}
    for size in range(capacity, 0, -1):
        while have[size]:
            if (found := complement(size)) is None:
                left[size] = have[size]
                gone(size)
                break
            use(found)
    for size, n in left.items():
        have[size] = n
        there |= 1 << size
    for size in range(capacity, 0, -1):
        while have[size]:
            lengths, gap = (size,), capacity - size
            while gap and (x := fitting(gap, lengths)):
                lengths, gap = (*lengths, x), gap - x
            use(lengths)
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): pieces of a length, by rank, to sequences."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            at = used.get(x, 0)
            out.append((x, at, at + n, sequence, offset))
            used[x], offset = at + n, offset + x
        sequence += n
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of whole documents: only a document over the capacity has more than one. Null text: empty."""
    prepare(docs.sparkSession)
    words = by_words(path)

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        for key, ids in encoder(path, end_id, words).encode_keyed(keyed(batches)):
            for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[a : a + 4 * capacity]
                rows.append((key, k, a // 4, len(own) // 4, zlib.crc32(own)))
            if len(rows) >= 1000:
                yield made()
                rows.clear()
        if rows:
            yield made()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The driver sees only counts by length (at most `capacity` rows) and the places of the plan go out as one bounded table.
    Repeated rows are pieces of their own; an empty table has no sequences.
    """
    spark = docs.sparkSession
    pieces = written(cut(docs, path, end_id, capacity, id_col, text_col), "pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = written(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(own) - 1).join(firsts, ["length", "salt"]).withColumn("rank", F.col("k") + F.col("first"))
    spots = spark.createDataFrame(places(plan(by_length, capacity)), "length long, a long, z long, sequence long, offset long")
    # A row for each length, at most capacity, with its intervals: as the plan's size hangs on the capacity alone, they go out to the pieces, so the pieces of a common length aren't one task.
    spots = F.broadcast(spots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("a", "z", "sequence", "offset"))).alias("spots")))
    found = ranked.join(spots, "length").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank",
        F.expr("element_at(filter(spots, s -> s.a <= rank AND rank < s.z), 1)").alias("spot"),
    )
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("spot.sequence") + F.col("rank") - F.col("spot.a")).alias("sequence_id"), F.col("spot.offset").alias("offset"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
