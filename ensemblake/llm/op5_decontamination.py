"""Benchmark decontamination: rare n-gram seeds join texts to items, Smith-Waterman alignment scores what they find."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, sized, table, written
from .op7_near_duplicates import STEP, keyed, mix, normal, windows

WORD = re.compile(r"\w+")
#: Seeds: two words of an item, next to each other or with one between, that are so in a text. The distances in the item
#: and in the text may differ: each of the four ways is a step of an alignment with an error at most, and what it adds to the score.
STEPS = {(1, 1): 2, (1, 2): 1, (2, 1): 1, (2, 2): 1}
MATCH, MISMATCH, GAP = 2, -1, -1
#: A passage is a copy if its alignment has this share of the item's full score, or the score of so many equal words in a row.
#: Items of up to WHOLE words must be there whole, since ordinary prose has any few words of them; from there to RUN words the share falls evenly.
SHARE, RUN, WHOLE = 0.5, 13, 7
#: Rows of seeds that go out to the hits; of more, each goes to this many parts, since two common words are a seed that many hits share.
MOST_SENT, SALTS = 500_000, 16
#: Bits of the filter that texts are read through: so many a seed, and at most so many. What it lets through in error the join drops.
FILTER_BITS, MOST_BITS = 16, 1 << 28
#: Bytes of texts that are searched together.
TOGETHER = 1_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def spans_of(text: str) -> list[tuple[int, int]]:
    """Where the words are in the text itself: lower case has more characters than some letters."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    source = [k for k, c in enumerate(text) for _ in c.lower()]
    return [(source[m.start()], source[m.end() - 1] + 1) for m in WORD.finditer(low)]


def least(n: int) -> float:
    """Score from which a passage is a copy of an item of n words."""
    share = 1 - (1 - SHARE) * min(1, max(0, n - WHOLE) / (RUN - WHOLE))
    return min(share * MATCH * n, RUN * MATCH)


def reach(n: int) -> int:
    """Most words of a text that an alignment of at least least(n) spans: it has n matches at most, and no more errors than it can bear."""
    return int(3 * n - least(n))


def commonest(n: int) -> int:
    """Places of an item of n words whose seeds aren't looked for: half of those that a copy can do without."""
    return max(0, int(least(n) - MATCH - 1) // 2) // 2


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: best score, and the aligned part of the text as [start, end) words.

    A row at a time, of which one is kept; a row's own gaps are a running maximum. Where the best alignment starts is where one that goes
    back from its end has its score.
    """
    m = len(text)
    slope = np.arange(m + 1) * -GAP
    row, best, at, end = np.zeros(m + 1, np.int64), 0, 0, 0
    for i, w in enumerate(item.tolist()):
        new = np.zeros(m + 1, np.int64)
        np.maximum(row[:-1] + np.where(text == w, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope) - slope
        if (top := int(row.max())) > best:
            best, at, end = top, i + 1, int(row.argmax())
    if not best:
        return 0, 0, 0
    back = text[max(0, end - at * (MATCH - GAP)) : end][::-1]
    slope = np.arange(len(back) + 1) * -GAP
    row = -slope
    for i, w in enumerate(item[:at][::-1].tolist()):
        new = np.full(len(back) + 1, (i + 1) * GAP)
        np.maximum(row[:-1] + np.where(back == w, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        row = np.maximum.accumulate(new + slope) - slope
        if row.max() == best:
            return best, end - int(row.argmax()), end
    raise AssertionError("an alignment has a start")


def most_of(part: list[str], wanted: set[str]) -> int:
    """No alignment to an item of the words wanted has a higher score in part: each other word between is an error."""
    now = best = 0
    for w in part:
        now = now + MATCH if w in wanted else max(0, now - 1)
        best = max(best, now)
    return best


def pair_keys(a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
    """Seeds of words with these hashes at distance d in a text; d = 0: single words."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + b * np.uint64(0xD6E8FEB86659FD93) + np.uint64(int(STEP) * (d + 1) % 2**64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in order: hash, which text it is in, its place there."""
    raw = np.frombuffer(b"\n".join(map(normal, texts)), np.uint8)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    text = np.concatenate(([0], np.cumsum(raw[gaps] == 10)))
    there = ends > starts
    starts, ends, text = starts[there], ends[there], text[there]
    first = np.searchsorted(text, np.arange(len(texts)))
    return windows(raw, starts, ends), text, np.arange(len(text)) - first[text]


def seeds_of(text: str) -> list[tuple[int, int, int]]:
    """(place in the item, seed as a signed number, what it adds) of an item's text."""
    own, _, _ = word_hashes([text])
    if len(own) == 1:
        return [(0, int(pair_keys(own, own, 0).view(np.int64)[0]), 0)]
    out = []
    for (e, d), adds in STEPS.items():
        keys = pair_keys(own[:-e], own[e:], d).view(np.int64).tolist()
        out += [(k, key, adds) for k, key in enumerate(keys)]
    return out


class Filter:
    """A set of seeds as bits: what isn't in it is no seed, few others are let through."""

    def __init__(self, seeds: DataFrame):
        bits = min(MOST_BITS, max(1 << 12, 1 << (FILTER_BITS * seeds.count()).bit_length()))
        own = seeds.select(F.pmod(F.col("seed"), F.lit(bits)).alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, cast(at % 64 AS int)) AS bit")
        rows = own.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        self.mask, self.sent = np.uint64(bits - 1), seeds.sparkSession.sparkContext.broadcast(words)

    def hits(self, texts: list[str | None], distances: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place, seed) of what may be seeds at each distance."""
        bits = self.sent.value.view(np.uint64)
        own, text, place = word_hashes(texts)
        for d in distances:
            n = max(0, len(own) - d)
            key = pair_keys(own[:n], own[d:], d)
            at = key & self.mask
            good = np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
            good = good[text[good] == text[good + d]]
            yield text[good], place[good], key[good].view(np.int64)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with some TOGETHER bytes of text each; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield batch.slice(a, z - a)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score (0 to 1), start, end, text_key, item_key: the best copy of each benchmark item that a document holds.

    docs and benchmark (item_id, text) are compared in lower-case words; every row of docs is searched whole, for every text of benchmark. Null and empty texts and
    items have no copies; repeated rows of docs are reported each, repeated rows of benchmark once. Documents are told apart by id and text (text_key, see keyed()),
    items by id and text (item_key, a hash of the text): an id may have several texts, or be null, and keeps its type. Each text is looked for once, whatever its ids.

    An alignment's score is that of one match and what each step to the next match adds: MATCH less the step's errors. Steps of two errors or
    more add nothing, so a copy has seeds in reach whose sum is at least least(n) - MATCH. Of each item the seeds at the places whose seeds are commonest
    in docs are left out, and what they could add is taken off: what is left still must be there. Seeds of texts are joined to those of items;
    where enough of an item's lie in reach of each other a text is aligned, so none that may hold a copy is left out. docs is read once for seeds, whatever the size of the benchmark.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = benchmark.select("item_id", F.xxhash64("text").alias("item_key"), F.col("text").alias("item_text")).where("item_text is not null")
    items = _items(named.select("item_key", "item_text"))
    if items.isEmpty():
        return spark.createDataFrame([], f"doc_id {own.dtypes[0][1]}, item_id {named.dtypes[0][1]}, score double, start long, `end` long, text_key long, item_key long")
    seeds = written(items.select("item_key", "n", "spare", "needed", F.inline("seeds")), "seeds")
    distances = [d for d in (0, 1, 2) if d or not items.where("n = 1").isEmpty()]
    # One pass over the texts; how common a seed is, and which seeds matter, is then told from the hits alone.
    hits = written(_hits(own, Filter(seeds.select("seed").distinct()), distances), "hits")
    kept = written(_rare(seeds, hits.groupBy("seed").agg(F.count(F.lit(1)).alias("times"))), "rare-seeds")
    # A long text's hits of one place count once, by what they add at most.
    found = _met(hits, kept.select("seed", "item_key", "adds")).groupBy("doc_id", "text_key", "item_key").agg(F.collect_list(F.struct("place", "adds")).alias("hits"), F.sum("adds").alias("sum"))
    needed = kept.select("item_key", "n", "needed").distinct()
    spans = written(_spans(found.join(sized(needed), "item_key").where("sum >= needed"), own.dtypes[0][1]), "spans")
    wanted = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    texts = keyed(own).join(sized(written(wanted, "leaky")), same, "left_semi")
    cases = spans.join(items.select("item_key", "item_text"), "item_key").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_list(F.struct("item_key", "item_text", "spans")).alias("cases"))
    aligned = _aligned(texts.join(cases, same).select("doc_id", "text_key", "text", "cases"))
    return aligned.join(sized(written(named.select("item_id", "item_key").distinct(), "item-ids")), "item_key").select("doc_id", "item_id", "score", "start", "end", "text_key", "item_key")


def _met(hits: DataFrame, kept: DataFrame) -> DataFrame:
    """hits with each item that has their seed."""
    if kept.count() <= MOST_SENT:
        return hits.join(F.broadcast(kept), "seed")
    dealt = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "place"), F.lit(SALTS)).cast("int"))
    return dealt.join(kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["seed", "salt"])


def _items(named: DataFrame) -> DataFrame:
    """item_key, item_text, n words, spare (places left out), needed (sum of the rest's seeds in a copy), seeds: texts with words, each once."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int64()), ("seed", pa.int64()), ("adds", pa.int64())]))
        for batch in batches:
            rows = [(k, t, n, commonest(n), least(n) - MATCH - MATCH * commonest(n), [dict(zip(("at", "seed", "adds"), x, strict=True)) for x in seeds_of(t)]) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (n := len(words(t)))]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["item_key", "item_text", "n", "spare", "needed", "seeds"])

    return written(named.distinct().mapInArrow(make, "item_key long, item_text string, n long, spare long, needed double, seeds array<struct<at:long,seed:long,adds:long>>"), "items")


def _rare(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """seed, item_key, adds, n, needed: an item's seeds without those at its commonest places, and the sum that a copy has of the rest."""
    times = F.coalesce("times", F.lit(0))
    places = seeds.join(counts, "seed", "left").groupBy("item_key", "spare", "at").agg(F.sum(times).alias("times"))
    rank = F.row_number().over(Window.partitionBy("item_key").orderBy(F.col("times").desc(), "at"))
    rare = places.withColumn("rank", rank).where("rank > spare").select("item_key", "at")
    kept = seeds.join(rare, ["item_key", "at"])
    return kept.groupBy("seed", "item_key").agg(F.max("adds").alias("adds"), F.first("n").alias("n"), F.first("needed").alias("needed"))


def _hits(own: DataFrame, known: Filter, distances: list[int]) -> DataFrame:
    """doc_id, text_key, place, seed."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2)):
            text, place, seed = (np.concatenate(x) for x in zip(*known.hits(batch.column(2).to_pylist(), distances), strict=True))
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(place, pa.int64()), pa.array(seed)], names=["doc_id", "text_key", "place", "seed"])

    return keyed(own).mapInArrow(find, f"doc_id {own.dtypes[0][1]}, text_key long, place long, seed long")


def within(places: np.ndarray, adds: np.ndarray, needed: float, far: int) -> list[tuple[int, int]]:
    """Spans of words that hold every copy, joined where they overlap: around places where what hits in reach add is enough."""
    order = np.lexsort((adds, places))
    places, adds = places[order], adds[order]
    last = np.append(places[1:] != places[:-1], True)[: len(places)]
    places, adds = places[last], adds[last]
    total = np.append(0, np.cumsum(adds))
    inside = total[1:] - total[np.searchsorted(places, places - far, "right")]
    out: list[tuple[int, int]] = []
    for p in places[inside >= needed].tolist():
        a, z = max(0, p - far), p + far + 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def _spans(found: DataFrame, kind: str) -> DataFrame:
    """doc_id, text_key, item_key, spans of words."""

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for hits, n, needed in zip(batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                own = hits.values
                near.append(within(own.field("place").to_numpy(), own.field("adds").to_numpy(), needed, reach(n)))
            keep = pa.array([k for k, x in enumerate(near) if x], pa.int64())
            spans = pa.array([[{"a": a, "z": z} for a, z in x] for x in near if x], pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(keep) for k in range(3)), spans], names=["doc_id", "text_key", "item_key", "spans"])

    return found.select("doc_id", "text_key", "item_key", "hits", "n", "needed").mapInArrow(look, f"doc_id {kind}, text_key long, item_key long, spans array<struct<a:long,z:long>>")


def copies(text: str, cases: list[dict]) -> Iterator[tuple[int, float, int, int]]:
    """(item, share of its full score, start, end in code points): the best passage for each item."""
    own, places = words(text), None
    for case in sorted(cases, key=lambda x: x["item_key"]):
        item, best = words(case["item_text"]), (0, 0, 0)
        codes = {w: k for k, w in enumerate(dict.fromkeys(item))}
        coded, enough = np.array([codes[w] for w in item]), least(len(item))
        for span in case["spans"]:
            part = own[span["a"] : span["z"]]
            if most_of(part, codes.keys()) < max(best[0], enough):
                continue  # not even all its words in order would do
            score, s, e = align(coded, np.array([codes.get(w, -1) for w in part]))
            best = max(best, (score, span["a"] + s, span["a"] + e), key=lambda x: (x[0], -x[1]))
        if best[0] >= enough:
            places = places or spans_of(text)
            yield case["item_key"], best[0] / (MATCH * len(item)), places[best[1]][0], places[best[2] - 1][1]


def _aligned(cases: DataFrame) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *x) for k, (text, own) in enumerate(zip(batch.column(2), batch.column(3), strict=True)) for x in copies(text.as_py(), own.as_py())]
            at, *cols = list(zip(*rows, strict=True)) or [()] * 5
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)), batch.column(1).take(at)], names=["doc_id", "item_key", "score", "start", "end", "text_key"])

    return cases.mapInArrow(find, f"doc_id {cases.dtypes[0][1]}, item_key long, score double, start long, `end` long, text_key long")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key", "item_key")
