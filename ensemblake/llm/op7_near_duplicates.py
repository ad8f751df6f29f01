"""Near-duplicate classes: DartMinHash signatures, banded joining, exact checks of the links that matter."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, sized, table, written
from .graph import connected_components

WORD = re.compile(r"\w+")
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of coordinates: two texts of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS, 0.99992 at 0.8.
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Documents whose darts are thrown together.
BATCH = 150


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


#: P(at most n darts in a region of unit area), for n = 0, 1, ...
DARTS = np.cumsum([1 / (np.e * np.prod(np.arange(1, n + 1))) for n in range(18)])
STEP = np.uint64(0x9E3779B97F4A7C15)


def throw(elements: np.ndarray, weights: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts that hit weighted elements below a rank limit of each: (index of the element, rank, 64-bit name).

    Every element has a plane of weight x rank with darts at unit density, the same wherever the element occurs. The plane is
    cut into regions of unit area: level v spans weights 2^v - 1 to 2^(v+1) - 1 and ranks in steps of 2^-v. A region's hash decides how many darts it
    has (Poisson), and each dart's place. A dart hits if its weight is at most the element's.
    """
    out = []
    for level in range(int(np.floor(np.log2(max(1.0, weights.max(initial=1.0))))) + 1):
        base, width = 2.0**level - 1, 2.0**level
        some = np.flatnonzero(weights > base)
        steps = np.ceil(limits[some] * width).astype(np.int64)
        index = np.repeat(some, steps)
        step = np.arange(len(index)) - np.repeat(np.cumsum(steps) - steps, steps)
        region = mix(elements[index] + STEP * (step.astype(np.uint64) * np.uint64(64) + np.uint64(level + 1)))
        n = np.searchsorted(DARTS, unit(region), "right")
        at = np.repeat(np.arange(len(index)), n)
        dart = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        name = mix(region[at] + STEP * (dart.astype(np.uint64) + np.uint64(1)))
        rank = (step[at] + unit(mix(name ^ np.uint64(0xD6E8FEB86659FD93)))) / width
        weight = base + width * unit(mix(name ^ np.uint64(0xA0761D6478BD642F)))
        index = index[at]
        hit = (weight <= weights[index]) & (rank < limits[index])
        out.append((index[hit], rank[hit], name[hit]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """DartMinHash of weighted sets (64-bit elements, weights > 0): for each of k coordinates the name of the dart of least rank.

    A limit of rank lets through k ln k + 3 k darts a set on average, whatever its size; a set with an empty coordinate is thrown again to twice
    the limit. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity. Sets must not be empty.
    """
    out = np.zeros((len(sets), k), np.uint64)
    todo, share = np.arange(len(sets)), k * np.log(k) + 3 * k
    while len(todo):
        sizes = np.array([len(sets[s][0]) for s in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        weights = np.concatenate([sets[s][1] for s in todo])
        total = np.bincount(owner, weights)
        index, rank, name = throw(np.concatenate([sets[s][0] for s in todo]), weights, (share / total)[owner])
        cell = owner[index] * k + (mix(name ^ np.uint64(0x589965CC75374CC3)) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        best, full = np.zeros(len(todo) * k, np.uint64), np.zeros(len(todo) * k, bool)
        best[cell[order]] = name[order]  # the last written is the earliest dart
        full[cell] = True
        done = full.reshape(-1, k).all(axis=1)
        out[todo[done]] = best.reshape(-1, k)[done]
        todo, share = todo[~done], 2 * share
    return out


PRIME = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((PRIME, INVERSE)):
            own = np.full(size, base)
            own[0] = 1
            _powers[k] = np.multiply.accumulate(own)
    return _powers[0][:n], _powers[1][:n]


def normal(text: str | None) -> bytes:
    """Lower-case words with single spaces between."""
    return " ".join(WORD.findall(text.lower())).encode("utf-8", "replace") if text else b""


def windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a polynomial hash of a range is a difference of prefix sums, shifted to the origin."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + STEP * (ends - starts).astype(np.uint64))


def shingles(own: bytes) -> np.ndarray:
    """64-bit hashes of all windows of SHINGLE words, repeats included; of all words where there are fewer."""
    if not own:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(own, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    n = max(1, len(starts) - SHINGLE + 1)
    return windows(raw, starts[:n], ends[-n:])


def weighted_set(own: bytes, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, and their weights: how often each occurs if counted, else 1 each."""
    found, n = np.unique(shingles(own), return_counts=True)
    return found, n.astype(float) if counted else np.ones(len(found))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / (a[1].sum() + b[1].sum() - both)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), text: what tells rows apart where one id has several texts."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def signed(docs: DataFrame, counted: bool = False) -> DataFrame:
    """A row for each of keyed(docs): doc_id, text_key, digest of the words, bands: a hash of each band of the signature.

    Rows without an id, and texts without words, have neither digest nor bands.
    """
    prepare(docs.sparkSession)
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * STEP)
    odd = mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                few = batch.slice(at, BATCH)
                own = [normal(x) if known else b"" for x, known in zip(few.column(2).to_pylist(), few.column(0).is_valid().to_pylist(), strict=True)]
                there = [k for k, x in enumerate(own) if x]
                bands: list = [None] * len(own)
                if there:
                    names = signatures([weighted_set(own[k], counted) for k in there]).reshape(len(there), BANDS, ROWS)
                    for k, x in zip(there, mix((names * odd).sum(axis=2, dtype=np.uint64) ^ salt).astype(np.int64), strict=True):
                        bands[k] = x
                digest = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in own]
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "digest", "bands"])

    return keyed(docs).mapInArrow(sign, f"doc_id {docs.select('doc_id').dtypes[0][1]}, text_key long, digest binary, bands array<long>")


class Texts:
    """Texts of nodes: a node stands for all copies of a text, and has the id and key of one of them."""

    def __init__(self, docs: DataFrame, reps: DataFrame):
        self.docs, self.reps = docs, reps.select("node", "doc_id", "text_key")

    def of(self, nodes: DataFrame) -> DataFrame:
        """node, text of the nodes given; only these texts are moved."""
        wanted = sized(written(nodes.distinct().join(self.reps, "node"), "wanted"))
        found = keyed(self.docs).join(wanted, ["doc_id", "text_key"])
        return written(found.groupBy("node").agg(F.first("text").alias("text")), "texts")


def checked(pairs: DataFrame, texts: Texts, counted: bool, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts have at least the threshold's exact similarity."""
    own = texts.of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    left, right = own.toDF("a", "left"), own.toDF("b", "right")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = x.as_py(), y.as_py()
                if y != last:
                    last, own = y, weighted_set(normal(y), counted)
                keep += [k] if similarity(weighted_set(normal(x), counted), own) >= threshold else []
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def classes(reps: DataFrame, docs: DataFrame, threshold: float = SIMILARITY, counted: bool = False) -> DataFrame:
    """node, component: connected nodes of different texts whose word shingles have a similarity of the threshold or more.

    In a band's bucket a member is first compared with a leader: the member that shares most buckets with others, as a text does that
    others are copies of. Of a text's leaders that of most company is tried first, then its other ones, then each bucket's next leader by those not yet in the
    first one's class, and so on for ROUNDS; then members of buckets that are still in different classes with each other: no pair that shares a
    band goes unlinked, but members already connected aren't compared, so a large group costs some checks a member.
    """
    texts = Texts(docs, reps)
    members = reps.select(F.explode("bands").alias("bucket"), "node").distinct()
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only buckets with company matter from here on.
    members = written(members.join(sizes, "bucket"), "company")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    members = written(members.select("bucket", "node").join(company, "node"), "members")
    tried = links = None
    placed = members.withColumn("class", F.col("node"))
    for k in range(ROUNDS):
        # In the first round a text's best leader only, which settles most; then all that are still in other classes.
        leaders = placed.groupBy("bucket").agg(F.max_by("node", "company").alias("leader"), F.max("company").alias("fame"), F.max_by("class", "company").alias("leader_class")) if k < 2 else _next_leaders(placed)
        asked = placed.join(leaders, "bucket").where("class <> leader_class")
        if k == 0:
            asked = asked.groupBy("node").agg(F.max_by("leader", "fame").alias("leader"))
        pairs = asked.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = checked(pairs, texts, counted, threshold)
        tried = pairs if tried is None else written(tried.unionByName(pairs), "tried")
        links = written(found if links is None else links.unionByName(found), "links")
        parts = connected_components(links, FEW_LINKS).withColumnRenamed("component", "class")
        placed = written(members.join(parts, "node", "left").withColumn("class", F.coalesce("class", "node")), "placed")
    rest = written(_apart(placed, texts, counted, threshold).join(tried, ["a", "b"], "left_anti"), "pairs")
    links = written(links.unionByName(checked(rest, texts, counted, threshold)), "links")
    return connected_components(links, FEW_LINKS)


#: Rounds in which members are compared with leaders of their buckets.
ROUNDS = 4
#: Links, two numbers each, that one task connects; more are shuffled.
FEW_LINKS = 100_000


def _next_leaders(placed: DataFrame) -> DataFrame:
    """bucket, leader, leader_class of buckets of several classes: the member of most company outside the class of the bucket's first."""
    first = placed.groupBy("bucket").agg(F.max_by("class", "company").alias("first"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
    others = placed.join(first.select("bucket", "first"), "bucket").where("class <> first")
    return others.groupBy("bucket").agg(F.max_by("node", "company").alias("leader"), F.max_by("class", "company").alias("leader_class"))


#: Nodes that one task joins to all others of a shingle.
SPLIT = 1000


def _apart(placed: DataFrame, texts: Texts, counted: bool, threshold: float) -> DataFrame:
    """Pairs of members of mixed buckets, in different classes, that may still be near.

    Texts are joined by their rarest shingles alone: with shingles in one order, rare ones first, two texts of similarity t share one among
    those that a text can lose and still keep t of its weight. So texts on one template, all of them in one bucket,
    aren't multiplied by each other for what they all share. A shingle of many texts is dealt to several tasks. Three exact bounds leave out more pairs:
    weights differ by a factor of t at most; what two share is at most what either shares with any other, and must be t / (1 + t) of both weights; where
    parities of two texts' shingles differ in a cell a shingle differs, and (1 - t) / (1 + t) of both weights may.
    """
    mixed = placed.groupBy("bucket").agg(F.max_by("class", "company").alias("first"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket", "first")
    # Of two members in different classes one at least isn't in that of the bucket's first: it looks for the other.
    inside = placed.join(sized(written(mixed, "mixed")), "bucket")
    inside = written(inside.groupBy("node").agg(F.min("class").alias("class"), F.max(F.col("class") != F.col("first")).alias("strange")), "mixed-members")
    sets = _sets(texts.of(inside.select("node")), counted)
    cells = sets.select("node", "weight", F.inline(F.arrays_zip("shingles", "weights")))
    # A shingle of one text alone joins nothing; it only counts as lost.
    common = cells.groupBy("shingles").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = cells.join(common, "shingles")
    shared = cells.groupBy("node").agg(F.sum("weights").alias("shared"))
    before = Window.partitionBy("node").orderBy("n", "shingles").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.coalesce(F.sum("weights").over(before), F.lit(0.0))
    first = cells.withColumn("lost", lost).join(shared, "node").where(F.col("weight") - F.col("shared") + F.col("lost") <= (1 - threshold) * F.col("weight") + 1e-6)
    first = first.select("node", "shared", "shingles", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")).join(inside, "node").join(sets.select("node", "weight", "bits"), "node")
    first = written(first, "rare-shingles")
    x, y = (first.select("shingles", "parts", *(F.col(c).alias(f"{p}_{c}") for c in ("node", "class", "strange", "weight", "shared", "bits"))) for p in "xy")
    x = x.where("x_strange").withColumn("part", F.pmod(F.xxhash64("x_node"), F.col("parts")).cast("int")).drop("parts")
    y = y.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    w, v = F.col("x_weight"), F.col("y_weight")
    near = (F.least(w, v) >= threshold * F.greatest(w, v) - 1e-6) & (F.least("x_shared", "y_shared") >= threshold / (1 + threshold) * (w + v) - 1e-6)
    differ = sum(F.bit_count(F.col("x_bits")[k].bitwiseXOR(F.col("y_bits")[k])) for k in range(PARITIES))
    near = near & (differ <= (1 - threshold) / (1 + threshold) * (w + v) + 1e-6)
    pairs = x.join(y, ["shingles", "part"]).where((F.col("x_class") != F.col("y_class")) & near)
    return pairs.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).distinct()


#: 64-bit words of a text's parities.
PARITIES = 32


def parities(found: np.ndarray) -> np.ndarray:
    """Whether each of 64 x PARITIES cells holds an odd number of the elements, as words."""
    odd = np.bincount((mix(found) % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sets(texts: DataFrame, counted: bool) -> DataFrame:
    """node, shingles, weights, weight (their sum), bits (parities) of texts (node, text)."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                few = batch.slice(at, BATCH)
                own = [weighted_set(normal(x), counted) for x in few.column(1).to_pylist()]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(s) for s, _ in own]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in own]).astype(t))) for k, t in ((0, np.int64), (1, np.float64))]
                bits = pa.array([parities(s) for s, _ in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([few.column(0), *lists, pa.array([w.sum() for _, w in own], pa.float64()), bits], names=["node", "shingles", "weights", "weight", "bits"])

    return written(texts.select("node", "text").mapInArrow(sets, "node long, shingles array<long>, weights array<double>, weight double, bits array<long>"), "shingle-sets")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, counted: bool = False) -> DataFrame:
    """A row for every row of docs (doc_id, text): doc_id, class_id, n_links, text_key, first.

    Texts with the same lower-case words are copies, and different texts are linked at a similarity of the threshold or more of their word
    shingles; classes are what copies and links connect. class_id: the smallest id of the class. n_links: other documents in the class, where a document is an id with a text.
    first: whether the row is the class's document of the smallest id (of several texts with that id, one). Rows that share an id but not a
    text are documents of their own, so class_id alone doesn't tell two classes apart that have a smallest id in common.
    Texts without words, null ones too, and rows without an id are each a class of their own. Repeated rows get the same answer each.
    """
    own = docs.select("doc_id", "text")
    sign = written(signed(own, counted), "signed")
    # A node's number stands for its text from here on; it is fixed by being written.
    reps = sign.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.first("bands").alias("bands"))
    reps = written(reps.select("digest", "r.doc_id", "r.text_key", "bands", F.monotonically_increasing_id().alias("node")), "representatives")
    parts = written(classes(reps, own, threshold, counted), "classes")
    rows = sign.where("digest is not null").select("digest", "doc_id", "text_key").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    # Every copied or linked text has a label; the others are classes of one.
    label = reps.select("digest", "doc_id", "text_key", "node").join(rows, "digest").join(parts, "node", "left")
    label = label.where("n > 1 OR component is not null").select("digest", "n", F.coalesce("component", "node").alias("class"), F.struct("doc_id", "text_key").alias("r"))
    label = written(label, "labels")
    top = label.groupBy("class").agg(F.min("r").alias("top"), (F.sum("n") - 1).alias("n_links"))
    label = label.select("digest", "class").join(top, "class").select("digest", "top", "n_links")
    found = sign.select("doc_id", "text_key", "digest").join(label, "digest", "left")
    return found.select(
        "doc_id", F.coalesce("top.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key",
        F.coalesce((F.col("doc_id") == F.col("top.doc_id")) & (F.col("text_key") == F.col("top.text_key")), F.lit(True)).alias("first"),
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
