"""Token files: a concatenated id array whose document boundaries and document ids are Elias-Fano encoded.

A segment (one row of the written table, one image) holds consecutive documents, those without an id first, then by ascending id:

    magic 8 bytes "ELFATOK3"
    header, little-endian 64-bit: documents, those without an id, the first id (signed), ids, bytes an id
    two sequences, first ids less the first one, then ends of documents in the id array; each:
        header, unsigned 64-bit: values, low bits, bytes of low array, bytes of high array, selects, bits a select
        low array      low bits of each value, packed, least significant bit first
        high array     unary gaps of the high parts: value k sets bit (value >> low) + k
        selects        every SELECT-th set bit's place, packed likewise in as many bits as the largest needs
    ids            ids x unsigned 16-bit, or 32-bit where one needs it

A sequence takes about 2 + log2(range / values) bits a value. A folder of token files has two tables: segments (part, seq, n_docs, n_ids, first_id, last_id, image)
and manifest, the same without images and with base, the ids of all segments before. It can be read by any later session.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table, tokenizer_path, written
from .encoding import by_words, encoder, keyed

MAGIC, SELECT = b"ELFATOK3", 64
#: A segment ends with the document that brings it to so many ids. Characters of a text that say where it stands among those of its id.
SEGMENT_IDS, START = 2_000_000, 32


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of unsigned numbers, one after the other."""
    each = (values.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1 if bits else np.zeros((len(values), 0), np.uint8)
    return np.packbits(each.ravel(), bitorder="little")


def unpacked(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    each = np.unpackbits(raw, bitorder="little")[: n * bits].reshape(n, bits).astype(np.uint64)
    return (each << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class EliasFano:
    """A non-decreasing sequence of unsigned numbers in near-minimal space, with constant-time select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, selects: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.selects = n, low_bits, low, high, selects

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, bits, packed(values, bits), np.packbits(unary, bitorder="little"), places[::SELECT].astype(np.uint64))

    def to_bytes(self) -> bytes:
        width = int(self.selects.max(initial=0)).bit_length()
        low, high, selects = self.low.tobytes(), self.high.tobytes(), packed(self.selects, width).tobytes()
        return struct.pack("<6Q", self.n, self.low_bits, len(low), len(high), len(self.selects), width) + low + high + selects

    @classmethod
    def from_bytes(cls, image: bytes, at: int) -> tuple[EliasFano, int]:
        """The sequence that starts at a byte, and where it ends."""
        n, bits, n_low, n_high, n_selects, width = struct.unpack_from("<6Q", image, at)
        raw, at = [], at + 48
        for size in (n_low, n_high, (n_selects * width + 7) // 8):
            raw.append(np.frombuffer(image, np.uint8, size, at))
            at += size
        return cls(n, bits, raw[0], raw[1], unpacked(raw[2], n_selects, width)), at

    def _low(self, k: int) -> int:
        at = k * self.low_bits
        raw = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little")
        return (raw >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, k: int) -> int:
        """The k-th value, from the nearest stored place and the bits after it."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        place = int(self.selects[k // SELECT])
        left = k % SELECT
        byte, word = place // 8, int(self.high[place // 8]) >> (place % 8) << (place % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - k) << self.low_bits | self._low(k)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        return high + unpacked(self.low, self.n, self.low_bits)

    def first_not_below(self, value: int) -> int:
        """How many values are smaller; a binary search by select."""
        a, z = 0, self.n
        while a < z:
            middle = (a + z) // 2
            a, z = (middle + 1, z) if self.select(middle) < value else (a, middle)
        return a


class Segment:
    """A segment's image: to_bytes() and from_bytes() are inverse; offsets(k) finds the k-th document, places(id) those of an id."""

    def __init__(self, without: int, first: int, keys: EliasFano, ends: EliasFano, ids: np.ndarray):
        self.without, self.first, self.keys, self.ends, self.ids = without, first, keys, ends, ids

    @classmethod
    def of(cls, doc_ids: list[int | None], encoded: list[bytes]) -> Segment:
        """doc_ids: None first, then ascending."""
        known = [x for x in doc_ids if x is not None]
        first = known[0] if known else 0
        ends = EliasFano.of(np.cumsum([len(x) // 4 for x in encoded], dtype=np.int64))
        return cls(len(doc_ids) - len(known), first, EliasFano.of(np.array([x - first for x in known], np.uint64)), ends, np.frombuffer(b"".join(encoded), "<u4"))

    @property
    def doc_ids(self) -> list[int | None]:
        return [None] * self.without + [self.first + x for x in self.keys.all().tolist()]

    def to_bytes(self) -> bytes:
        width = 2 if self.ids.max(initial=0) < 1 << 16 else 4
        return b"".join((MAGIC, struct.pack("<2Qq2Q", self.ends.n, self.without, self.first, len(self.ids), width), self.keys.to_bytes(), self.ends.to_bytes(), self.ids.astype(f"<u{width}").tobytes()))

    @classmethod
    def from_bytes(cls, image: bytes) -> Segment:
        if image[:8] != MAGIC:
            raise ValueError("not a token segment")
        _, without, first, size, width = struct.unpack_from("<2Qq2Q", image, 8)
        keys, at = EliasFano.from_bytes(image, 48)
        ends, at = EliasFano.from_bytes(image, at)
        return cls(without, first, keys, ends, np.frombuffer(image, f"<u{width}", size, at).astype("<u4"))

    def offsets(self, k: int) -> tuple[int, int]:
        return self.ends.select(k - 1) if k else 0, self.ends.select(k)

    def places(self, doc_id: int) -> range:
        """Which documents have an id: none, one, or several in a row."""
        a, z = (self.keys.first_not_below(x) for x in (doc_id - self.first, doc_id - self.first + 1))
        return range(self.without + a, self.without + z)


SEGMENTS = "part int, seq int, n_docs long, n_ids long, first_id long, last_id long, image binary"


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> DataFrame:
    """Encodes whole texts in ascending order of ids and writes segments; returns the written table.

    out: a new folder, which then has segments and manifest and stays; without one the segments are in the shared folder and go with the session.
    Null texts are empty ones. Null ids come first. Rows with one id are in order of the first START characters of their texts, then of a hash of them. Ids are long
    integers: others are an error. Rows are dealt out by id, text and place, so no id or text makes a task large.
    """
    spark, words = docs.sparkSession, by_words(path)
    prepare(spark)

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, keys, encoded, size, encode = TaskContext.get().partitionId(), 0, [], [], 0, encoder(path, end_id, words).encode_keyed

        def image() -> pa.RecordBatch:
            ends = [next((x for x in k if x is not None), None) for k in (keys, keys[::-1])]
            values = (part, seq, len(keys), size // 4, *ends, Segment.of(keys, encoded).to_bytes())
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["part", "seq", "n_docs", "n_ids", "first_id", "last_id", "image"])

        for key, ids in encode(keyed(batches)):
            keys.append(key)
            encoded.append(ids)
            size += len(ids)
            if size >= 4 * segment_ids:
                yield image()
                seq, keys, encoded, size = seq + 1, [], [], 0
        if keys:
            yield image()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, START), F.xxhash64("text")]
    ordered = own.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "__row").drop("__row").sortWithinPartitions(*order)
    made = ordered.mapInArrow(segments, SEGMENTS)
    if out is None:
        return written(made, "token-segments", "snappy")
    made.write.option("compression", "snappy").option("parquet.enable.dictionary", "false").parquet(f"{out}/segments")
    found = spark.read.schema(SEGMENTS).parquet(f"{out}/segments")
    found.drop("image").join(segment_starts(found), ["part", "seq"]).write.parquet(f"{out}/manifest")
    return found


def token_files(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(segments, manifest) of a folder that write_tokens made."""
    return spark.read.schema(SEGMENTS).parquet(f"{out}/segments"), spark.read.parquet(f"{out}/manifest")


def segment_starts(segments: DataFrame) -> DataFrame:
    """part, seq, base: ids of all segments before. Sums by part come first, so no window has more rows than there are parts, or segments in one."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before"))
    return written(own.join(parts, "part").select("part", "seq", (F.col("first") + F.col("before")).cast("long").alias("base")), "segment-starts")


def find_documents(segments: DataFrame, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, start, ids array<long>: the documents of the ids in wanted (doc_id), each by a search and selects within its segment; ids without one give no row.

    The manifest says which segments may have an id; a part's range goes out first, since there are few parts, and segments join by part.
    """
    prepare(segments.sparkSession)
    ranges = manifest.groupBy("part").agg(F.min("first_id").alias("a"), F.max("last_id").alias("z")).where("a is not null")
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    near = ids.join(F.broadcast(ranges), (F.col("doc_id") >= F.col("a")) & (F.col("doc_id") <= F.col("z"))).select("doc_id", "part")
    rows = near.join(manifest.select("part", "seq", "base", "first_id", "last_id"), "part").where("doc_id BETWEEN first_id AND last_id")
    asked = rows.groupBy("part", "seq", "base").agg(F.collect_list("doc_id").alias("asked"))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, keys, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = Segment.from_bytes(image.as_py())
                found = [(x, *own.offsets(k)) for x in keys for k in own.places(x)]
                ids = pa.array([own.ids[s:e].tolist() for _, s, e in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.int64()), pa.array([base + s for _, s, _ in found], pa.int64()), ids], names=["doc_id", "start", "ids"])

    return segments.select("part", "seq", "image").join(asked, ["part", "seq"]).select("base", "asked", "image").mapInArrow(look, "doc_id long, start long, ids array<long>")


def read_tokens(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. A document's end, and so the next one's start, is told by select."""
    prepare(segments.sparkSession)

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Segment.from_bytes(image.as_py())
                ends = np.fromiter(map(own.ends.select, range(own.ends.n)), np.int64, own.ends.n)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                raw = memoryview(own.ids.tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own.doc_ids, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # Spark broadcasts the few starts only where their file's size is under its threshold.
    return segments.select("part", "seq", "image").join(segment_starts(segments), ["part", "seq"]).select("base", "image").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
