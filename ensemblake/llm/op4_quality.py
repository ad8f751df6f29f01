"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sized, table, written

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Relative error of a sketch's quantiles.
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Fences: the tail quantiles of a group's rows that the base rule passes, and as far beyond them as they lie from the median.
LOW, MIDDLE, HIGH = 0.05, 0.5, 0.95
#: A group's quantiles weigh by its documents, those of the group around it (its language, then all rows) as so many.
PRIOR = 100
#: A row is outside a fence if its count is so by so many deviations (roots of the count): few symbols, lines or words prove nothing.
SURE = 5.0
#: Signals: a count, what it is divided by, whether low values are rejected too.
SIGNALS = {
    "mean_word_chars": ("word_chars", "n_words", True),
    "symbols_per_word": ("n_symbols", "n_words", False),
    "dup_lines_per_line": ("n_dup_lines", "n_lines", False),
    "repeated_words": ("n_repeat_words", "n_words", False),
}


def barrier(df: DataFrame, *made: Column) -> DataFrame:
    """df with columns that later expressions read instead of computing them again for each use."""
    return df.select("*", F.inline(F.array(F.struct(*made))))


def measures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) without text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs of other than space and \\t..\\r. All of it is per row, without a shuffle: repeated windows are
    neighbours once a row's own windows are sorted. Null text: zeros.
    """
    own = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    own = barrier(
        own,
        F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, BLANK, "")) > 0).alias("lines"),
        F.length(F.translate("text", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).drop("text")
    n = F.size("words")
    pairs = F.zip_with("words", F.slice("words", 2, n), lambda a, b: F.xxhash64(a, b))
    windows = F.slice(F.zip_with(pairs, F.slice("words", 3, n), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(n - 2, F.lit(0)))
    own = barrier(
        own,
        windows.alias("hashes"),
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ).drop("words", "lines")
    # Most texts have no window twice, which a set of hashes tells without sorting them; for those all that follows is null.
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    own = barrier(own, F.when(some, F.sort_array(F.transform("hashes", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).alias("windows")).drop("hashes")
    own = barrier(own, F.zip_with("windows", F.slice("windows", 2, F.size("windows") + 1), lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))).alias("same"))
    twice = F.zip_with("same", F.concat(F.array(F.lit(False)), F.col("same")), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    starts = F.zip_with("windows", twice, lambda w, t: F.when(t, w["i"]))
    own = barrier(own, F.sort_array(F.filter(starts, lambda x: x.isNotNull())).alias("starts")).drop("windows", "same")
    covered = F.zip_with("starts", F.slice("starts", 2, F.size("starts") + 1), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return own.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long")).alias("n_repeat_words"))


def signals(deviations: float = 0.0) -> dict[str, Column]:
    """Each signal of a row; what is left of it, or it may be, so many deviations of its count below or above."""
    moved = lambda n: F.col(n) + deviations * F.sqrt(F.col(n)) if deviations else F.col(n).cast("double")
    return {k: moved(n) / F.col(over) for k, (n, over, _) in SIGNALS.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, signal, bucket, n: counts by logarithmic bucket, which merge by addition.

    Any quantile is known to ACCURACY of its value; a sketch has some thousand buckets at most, however many documents. Documents that the base rule fails aren't
    counted: what is rejected anyway says nothing about the rest.
    """
    long = measured.where(~base_failed()).select("lang", "source", F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), v.alias("v")) for k, v in signals().items()))).alias("s"))
    bucket = F.when(F.col("s.v") > 0, F.ceil(F.ln("s.v") / F.lit(math.log(GAMMA)))).otherwise(F.lit(-(10**6))).cast("int")
    return long.groupBy("lang", "source", F.col("s.signal").alias("signal"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """low, middle, high: quantiles of each signal in merged sketches, and docs: the documents behind them."""
    merged = sketch.groupBy(*by, "signal", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*by, "signal")
    up = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(own))
    value = F.when(F.col("bucket") == -(10**6), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    return merged.groupBy(*by, "signal").agg(at(LOW).alias("low"), at(MIDDLE).alias("middle"), at(HIGH).alias("high"), F.max("total").alias("docs"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and the fences of every signal: one row for each language and source.

    A source's quantiles give way to those of its language, and a language's to those of all rows, by the weight of PRIOR documents, so
    the fences change smoothly with a group's size and a source of a few documents is judged by its language. Nulls are a language and a source like others.
    """
    key = {c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("lang", "source")}
    sketch = sketch.withColumns(key)
    put = lambda by, p: quantiles(sketch, by).withColumnsRenamed({c: f"{p}_{c}" for c in ("low", "middle", "high", "docs")})
    all_ = put(["lang", "source"], "own").join(put(["lang"], "lang"), ["lang", "signal"]).join(put([], "every"), "signal")

    def blended(q: str) -> Column:
        lang = (F.col("lang_docs") * F.col(f"lang_{q}") + PRIOR * F.col(f"every_{q}")) / (F.col("lang_docs") + PRIOR)
        return (F.col("own_docs") * F.col(f"own_{q}") + PRIOR * lang) / (F.col("own_docs") + PRIOR)

    all_ = all_.select("lang", "source", "signal", *(blended(q).alias(q) for q in ("low", "middle", "high")))
    low, high = F.col("low") - (F.col("middle") - F.col("low")), F.col("high") + (F.col("high") - F.col("middle"))
    of = lambda k, fence: F.max(F.when(F.col("signal") == k, fence))
    return all_.groupBy("lang", "source").agg(*(of(k, low).alias(f"low_{k}") for k, v in SIGNALS.items() if v[2]), *(of(k, high).alias(f"high_{k}") for k in SIGNALS))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept for every row of docs (doc_id, text, lang, source).

    kept: not base_failed, and every signal within the fences of the row's language and source. A row
    whose text has no words is base_failed. Repeated rows are judged each; an empty table gives none.
    """
    measured = written(measures(docs), "quality")
    fences = thresholds(sketches(measured)).withColumnsRenamed({"lang": "fence_lang", "source": "fence_source"})
    # A few numbers a source: they go out to the rows while they are few, so a source with a third of all rows isn't one task.
    fences = sized(written(fences, "fences"), 200_000)
    key = {c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("lang", "source")}
    failed = base_failed()
    within, least, most = F.lit(True), signals(-SURE), signals(SURE)
    for k, (_, _, both) in SIGNALS.items():
        within = within & F.coalesce(F.when(F.col("n_words") > 0, least[k]) <= F.col(f"high_{k}"), F.lit(True))
        if both:
            within = within & F.coalesce(F.when(F.col("n_words") > 0, most[k]) >= F.col(f"low_{k}"), F.lit(True))
    found = measured.join(fences, (key["lang"] == F.col("fence_lang")) & (key["source"] == F.col("fence_source")), "left")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & within).alias("kept"))


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


ORACLE = rf"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
lines AS (
  SELECT doc_id, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words)),
m AS (
  SELECT words.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         n_lines, n_dup_lines::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
v AS (
  SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, signal, value, least, most FROM (
    SELECT *, unnest(['mean_word_chars', 'symbols_per_word', 'dup_lines_per_line', 'repeated_words']) AS signal,
           unnest([word_chars / n_words, n_symbols / n_words, n_dup_lines / n_lines, n_repeat_words / n_words]) AS value,
           unnest([(word_chars - {SURE} * sqrt(word_chars)) / n_words, (n_symbols - {SURE} * sqrt(n_symbols)) / n_words, (n_dup_lines - {SURE} * sqrt(n_dup_lines)) / n_lines, (n_repeat_words - {SURE} * sqrt(n_repeat_words)) / n_words]) AS least,
           unnest([(word_chars + {SURE} * sqrt(word_chars)) / n_words, (n_symbols + {SURE} * sqrt(n_symbols)) / n_words, (n_dup_lines + {SURE} * sqrt(n_dup_lines)) / n_lines, (n_repeat_words + {SURE} * sqrt(n_repeat_words)) / n_words]) AS most
    FROM m WHERE n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words)),
s AS (
  SELECT lang, source, signal, CASE WHEN value > 0 THEN ceil(ln(value) / {math.log(GAMMA)!r})::INT ELSE -1000000 END AS bucket, count(*) AS n FROM v GROUP BY ALL),
c AS (
  SELECT 'own' AS kind, lang, source, signal, bucket, n FROM s UNION ALL
  SELECT 'lang', lang, NULL, signal, bucket, sum(n) FROM s GROUP BY lang, signal, bucket UNION ALL
  SELECT 'every', NULL, NULL, signal, bucket, sum(n) FROM s GROUP BY signal, bucket),
r AS (
  SELECT *, sum(n) OVER (PARTITION BY kind, lang, source, signal ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY kind, lang, source, signal) AS total,
         CASE WHEN bucket = -1000000 THEN 0.0 ELSE 2 * pow({GAMMA!r}, bucket) / ({GAMMA!r} + 1) END AS value FROM c),
q AS (
  SELECT kind, lang, source, signal, max(total) AS docs, min(value) FILTER (upto >= {LOW}::DOUBLE * total) AS low,
         min(value) FILTER (upto >= {MIDDLE}::DOUBLE * total) AS middle, min(value) FILTER (upto >= {HIGH}::DOUBLE * total) AS high
  FROM r GROUP BY kind, lang, source, signal),
blended AS (
  SELECT o.lang, o.source, o.signal,
         (o.docs * o.low + {PRIOR} * ((l.docs * l.low + {PRIOR} * e.low) / (l.docs + {PRIOR}))) / (o.docs + {PRIOR}) AS low,
         (o.docs * o.middle + {PRIOR} * ((l.docs * l.middle + {PRIOR} * e.middle) / (l.docs + {PRIOR}))) / (o.docs + {PRIOR}) AS middle,
         (o.docs * o.high + {PRIOR} * ((l.docs * l.high + {PRIOR} * e.high) / (l.docs + {PRIOR}))) / (o.docs + {PRIOR}) AS high
  FROM q o JOIN q l ON l.kind = 'lang' AND l.lang = o.lang AND l.signal = o.signal JOIN q e ON e.kind = 'every' AND e.signal = o.signal WHERE o.kind = 'own'),
picked AS (SELECT lang, source, signal, low - (middle - low) AS low, high + (high - middle) AS high FROM blended),
outside AS (
  SELECT DISTINCT doc_id FROM v JOIN picked USING (lang, source, signal) WHERE least > high OR signal = 'mean_word_chars' AND most < low),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
FROM judged
"""
