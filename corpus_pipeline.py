"""From raw documents to packed sequences: language ID, near-dedup, decontamination, secret scan, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
docs, extra ones included. Stages keep rows whose decision is undefined (a null text has no copies, leaks or secrets),
except where noted. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensemblake.llm.common import sized, table, tokenizer_path, written
from ensemblake.llm.op3_language import labelled_samples, predict_language
from ensemblake.llm.op5_decontamination import contaminated
from ensemblake.llm.op6_secrets import redact_secrets
from ensemblake.llm.op7_near_duplicates import near_duplicates
from ensemblake.llm.op10_packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, those without a letter and those in no learned language; nothing where no language is learned.

    Of a text in no learned language, another script say, even the best language's automaton has but phrases of a symbol or so (see op3's LEAST_PHRASE).
    """
    if not (samples := labelled_samples(docs.select("doc_id", "text", "lang"))):
        return docs
    columns, own = docs.columns, ("lang_pred", "score", "lang_known")
    renamed = docs.withColumnsRenamed({c: f"{c}__own" for c in own if c in columns})
    return predict_language(renamed, samples).where("lang_known").drop(*own).toDF(*columns)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of an id and text key (see keyed()) in gone; a null id is equal to itself."""
    keys = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(sized(keys), match, "left_anti").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each class of near duplicates; rows without words or without an id stay.

    Rows that share an id but not a text are documents of their own. Rows that repeat both are one document, of which one row stays.
    """
    found = written(near_duplicates(docs.select("doc_id", "text")), "near-duplicates")
    kept = without(docs, written(found.where("NOT first").select("doc_id", "text_key").distinct(), "duplicates"))
    twice = found.where("first AND doc_id IS NOT NULL").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_key")
    twice = written(twice, "repeated-rows")
    if twice.isEmpty():
        return kept
    again = kept.join(sized(twice.toDF("__id", "__key")), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__key")))
    return without(kept, twice).unionByName(again.select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item, edited or not, with or without an id."""
    leaks = written(contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct(), "leaks")
    return without(docs, leaks)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark and counts their characters anew; every document stays."""
    out = redact_secrets(docs, tokenizer_path("byte_bpe_50k.tiktoken"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return pack(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("near-dedup", dedup), ("decontamination", decontaminate), ("secrets", secrets), ("packing", packing)]

#: Suffix automata, signatures and alignments aren't expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
