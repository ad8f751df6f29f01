"""Spelling variants by anagram hashing: words whose letter sums differ by one letter's value, or by one exchanged for another's, verified in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, written
from .op7_near_duplicates import mix

#: What a letter adds to a word's key: its code point to this power. Anagrams have equal keys, other words hardly ever do.
POWER = 5
#: Words: code points and occurrences at least. A form is so many times as frequent as its variant.
LEAST_CHARS, LEAST_TIMES, TIMES = 7, 2, 10
#: Of the occurrences of runs one in so many loses a code point, by a hash of the document's id and the run.
LOSES = 31
RUN = "[A-Za-zÀ-ÿ]"
#: Rows of keys that a worker hands on at once.
TOGETHER = 500_000

BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 2**64)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """run: every occurrence of a maximal run of letters in the texts that may count as a word, A-Z in lower case, after the losses of LOSES."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"{RUN}{{{LEAST_CHARS},}}"), F.lit(0))).alias("run"))
    own = own.select("id", F.translate("run", upper, lower).alias("run"))
    own = own.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.col("h") % F.length("run")
    cut = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    return own.select(F.when(F.col("h") % LOSES == 0, cut).otherwise(F.col("run")).alias("run"))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: distinct words of whole texts that are long and frequent enough; occurrences are added up where texts are before they are moved."""
    own = runs(docs, id_col, text_col).where(F.length("run") >= LEAST_CHARS)
    return own.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TIMES)


def rows_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of words: (which, at, bucket, order, first) of the word whole (at -1, twice) and without each of its letters.

    bucket stands for the letters' sum, how many they are, and one half in order: two words that differ in one place agree in what lies before the middle or
    after it. order is a hash of all letters that are left, in order. first: the letter isn't one more of those before it, so words less one letter
    are named once. All sums are modulo 2^64, of the words one after the other.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = len(codes)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    with np.errstate(over="ignore"):
        up, down = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(total, x, np.uint64)))) for x in (BASE, BACK))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * up[:-1])))
        value = codes**POWER
        keys = np.add.reduceat(value, starts) if total else np.zeros(0, np.uint64)

        def part(a: np.ndarray, z: np.ndarray) -> np.ndarray:
            return (sums[z] - sums[a]) * down[a]

        def bucket(letters: np.ndarray, size: np.ndarray, after: np.ndarray, half: np.ndarray) -> np.ndarray:
            return mix(letters * np.uint64(0xD6E8FEB86659FD93) + half) + mix(size.astype(np.uint64) * np.uint64(2) + after.astype(np.uint64))

        which = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(total) - starts[which]
        s, e, here = starts[which], ends[which], np.arange(total)
        middle = (lengths[which] - 1) // 2
        after = at < middle
        half = np.where(after, part(s + middle + 1, e), part(s, s + middle))
        less = bucket(keys[which] - value, lengths[which] - 1, after, half)
        order = part(s, here) + part(here + 1, e) * up[at]
        first = (at == 0) | (codes != np.roll(codes, 1))
        cut = starts + lengths // 2
        whole = [bucket(keys, lengths, np.full(len(texts), k), part(*x)) for k, x in enumerate(((starts, cut), (cut, ends)))]
        own = part(starts, ends)
    every = np.arange(len(texts))
    none = np.full(len(texts), -1)
    no = np.zeros(len(texts), bool)
    return tuple(np.concatenate(x) for x in ((which, every, every), (at, none, none), (less, *whole), (order, own, own), (first, no, no)))


def keyed_words(found: DataFrame) -> DataFrame:
    """bucket, order, id, at, first: the rows of rows_of for words (id, word); none of them carries the word, so long words have many rows but short ones."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            which, at, bucket, order, first = rows_of(batch.column(1).to_pylist())
            ids = batch.column(0).to_numpy()
            for k in range(0, len(which), TOGETHER):
                z = slice(k, k + TOGETHER)
                cols = (pa.array(bucket[z].view(np.int64)), pa.array(order[z].view(np.int64)), pa.array(ids[which[z]]), pa.array(at[z], pa.int32()), pa.array(first[z]))
                yield pa.RecordBatch.from_arrays(list(cols), names=["bucket", "order", "id", "at", "first"])

    return found.select("id", "word").mapInArrow(make, "bucket long, order long, id long, at int, first boolean")


def near_words(found: DataFrame) -> DataFrame:
    """id, word, n, near, near_n: every word and each of its near words, both ways; words (id, word, n) with id a hash of the word.

    Two words less one letter each have equal keys where an exchange makes one of the other, and a word less one letter has the key of the word that lacks it:
    so values of one addition, removal or exchange are joined without going through an alphabet. Letter order is checked by its hash within the join and exactly
    after it.
    """
    rows = keyed_words(found)
    a, b = (rows.select("bucket", *(F.col(c).alias(f"{c}_{k}") for c in ("order", "id", "at", "first"))) for k in ("a", "b"))
    # Not an equality of two columns, which would make order a key of the join: buckets are the anagrams' own.
    same = (F.col("order_a").bitwiseXOR(F.col("order_b")) == 0) & (F.col("at_a") >= 0) & (F.col("id_a") != F.col("id_b"))
    kind = (F.col("at_a") == F.col("at_b")) | (F.col("first_a") & (F.col("at_b") < 0))
    pairs = a.join(b, "bucket").where(same & kind)
    both = F.when(F.col("at_b") < 0, F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("other")), F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("other")))).otherwise(
        F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("other")))
    )
    pairs = pairs.select("at_a", F.inline(both)).withColumnRenamed("at_a", "at")
    others = found.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    cases = pairs.join(others, "other").join(found, "id")
    less = {c: F.concat(F.substring(c, F.lit(1), F.col("at")), F.substring(c, F.col("at") + 2, F.length(c))) for c in ("word", "near")}
    size, near_size = F.length("word"), F.length("near")
    exact = (
        ((size == near_size) & (F.col("word") != F.col("near")) & (less["word"] == less["near"]))
        | ((size == near_size + 1) & (less["word"] == F.col("near")))
        | ((near_size == size + 1) & (less["near"] == F.col("word")))
    )
    return cases.where(exact).select("id", "word", "n", "near", "near_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form (word, form): forms are followed to the last by doubling steps. Frequencies grow tenfold a step, so a chain is short."""
    now = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root string; n, n_near, form_n long: a row per distinct word of the whole texts.

    Words: see words(). Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. form: the near word of
    largest n (ties: the smallest in code-point order) if that is at least TIMES the word's n, else null; form_n its n. root: forms followed to the last; a word
    without a form is its own. Null and empty texts have no words. Repeated rows count each; a null id reads as an empty one. Other columns of docs are not
    read. Without words the result is empty.
    """
    prepare(docs.sparkSession)
    found = written(words(docs, id_col, text_col).select(F.xxhash64("word").alias("id"), "word", "n"), "words")
    # Of a word's near words the most frequent, then the smallest: two aggregates over rows that are together already.
    best = F.max_by(F.struct(F.col("near").alias("form"), F.col("near_n").alias("form_n")), "near_n")
    tops = near_words(found).groupBy("id", "word", "n", "near_n").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("times"))
    judged = tops.groupBy("id", "word", "n").agg(F.sum("times").alias("n_near"), best.alias("best"))
    form = F.col("best.form_n") >= F.lit(TIMES) * F.col("n")
    judged = written(judged.select("id", "word", "n_near", F.when(form, F.col("best.form")).alias("form"), F.when(form, F.col("best.form_n")).alias("form_n")), "judged")
    ends = roots(judged.where("form is not null"))
    out = found.join(judged, ["id", "word"], "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
