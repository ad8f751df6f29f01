"""Language ID by cross-parsing entropy: suffix automata of labelled text parse every whole text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, prepare, table

#: The bounded labelled sample: documents a language, characters taken from each, bytes a language in all.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_BYTES = 64, 512, 16_384
#: Texts parsed at once, a symbol of each at a time; where fewer than FEW go on, they are parsed one by one.
LANES, FEW = 4096, 128
#: A text none of whose languages has phrases of so many symbols on average is in no learned language.
LEAST_PHRASE = 1.5
#: Symbols that a score counts as independent evidence at most.
EVIDENCE = 50
LETTER = re.compile(r"[^\W\d_]")
#: Everything in ASCII but letters separates words.
SEPARATORS = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def symbols(text: str) -> bytes:
    """Lower-case words with one space around each, as UTF-8."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(SEPARATORS).split()) + b" "


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, state 0 first: every path from it spells a substring."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class CrossParser:
    """Counts of longest-match phrases of whole texts against each language's automaton.

    The automata are dense tables over the bytes of the samples, walked for many texts at once.
    """

    def __init__(self, samples: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in samples]
        self.bits = np.array([math.log2(max(2, len(sample))) for _, sample in samples])
        seen = sorted(set().union(*(sample for _, sample in samples)))
        self.code = np.zeros(256, np.uint8 if len(seen) < 255 else np.uint16)
        self.code[seen] = np.arange(1, len(seen) + 1)  # 0: in no sample, matches nothing
        width = len(seen) + 1
        self.tables = []
        for _, sample in samples:
            moves = suffix_automaton(sample)
            flat = np.zeros(len(moves) * width, np.int32)
            for state, own in enumerate(moves):
                for c, to in own.items():
                    flat[state * width + int(self.code[c])] = to * width
            self.tables.append((flat, flat[:width].copy()))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """texts x languages."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        for at in range(0, len(order), LANES):
            some = order[at : at + LANES]
            sizes = np.array([len(texts[k]) for k in some])
            #: Up to here enough texts go on to be walked together.
            wide = int(sizes[FEW - 1]) if len(some) >= FEW else 0
            grid = np.zeros((len(some), wide), self.code.dtype)
            for row, k in zip(grid, some, strict=True):
                part = texts[k][:wide]
                row[: len(part)] = self.code[np.frombuffer(part, np.uint8)]
            grid = np.ascontiguousarray(grid.T)
            active = np.searchsorted(-sizes, -np.arange(wide), "left")  # texts longer than t
            rest = [(n, self.code[np.frombuffer(texts[k], np.uint8, offset=wide)].tolist()) for n, k in enumerate(some) if len(texts[k]) > wide]
            for j, (moves, first) in enumerate(self.tables):
                state, count = np.zeros(len(some), np.int32), np.zeros(len(some), np.int64)
                for t, n in enumerate(active.tolist()):
                    now, c = state[:n], grid[t, :n]
                    to = moves[now + c]
                    stuck = np.flatnonzero(to == 0)
                    again = first[c[stuck]]
                    count[stuck] += (now[stuck] != 0).astype(np.int64) + (again == 0)
                    to[stuck] = again
                    state[:n] = to
                look, begin = memoryview(moves), first.tolist()
                for n, tail in rest:
                    now, more = int(state[n]), 0
                    for c in tail:
                        to = look[now + c]
                        if not to:
                            to = begin[c]
                            more += (now != 0) + (to == 0)
                        now = to
                    state[n], count[n] = now, count[n] + more
                out[some, j] = count + (state != 0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score, whether the text is in a learned language at all.

        `und`, 0 and False for null texts and those without a letter, and where no language was learned.
        """
        own = [symbols(t) if t and LETTER.search(t) else b"" for t in texts]
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        size = np.array([max(1, len(t)) for t in own])
        phrases = self.phrases(own)
        bits = phrases * self.bits / size[:, None]  # cross-parsing entropy a symbol
        best = bits.argmin(axis=1)  # ties: the first in order of names
        gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(size, EVIDENCE)[:, None]
        score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
        known = size >= LEAST_PHRASE * phrases.min(axis=1)
        langs = [self.langs[k] if t else "und" for k, t in zip(best.tolist(), own, strict=True)]
        return langs, [s if t else 0.0 for s, t in zip(score.tolist(), own, strict=True)], [bool(k and t) for k, t in zip(known.tolist(), own, strict=True)]


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def labelled_samples(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, text) by lang: a fixed draw of at most SAMPLE_DOCS labelled rows a language that aren't held out.

    docs: doc_id, text, lang. Rows are drawn by hashes of ids, one for each of SAMPLE_DOCS classes of ids, so no group of rows is ever gathered.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    drawn = own.groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("class")).agg(F.min("h").alias("h"))
    keys = sorted({r.h for r in drawn.select("h").collect()})
    if not keys:
        return []
    # A window at a hashed place of each: how documents begin says little of the rest.
    at = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    taken = own.where(F.col("h").isin(keys)).groupBy("lang", "h").agg(F.min(F.substring("text", at, F.lit(SAMPLE_CHARS))).alias("text"))
    by: dict[str, list[bytes]] = {}
    for r in taken.orderBy("lang", "h").collect():
        if LETTER.search(r.text):
            by.setdefault(r.lang, []).append(symbols(r.text))
    return [(lang, b"\n".join(dict.fromkeys(by[lang]))[:SAMPLE_BYTES]) for lang in sorted(by)]


def parser(samples: list[tuple[str, bytes]]) -> CrossParser:
    """One for each worker process and model."""
    return only(("parser", *samples), lambda: CrossParser(samples))


def predict_language(docs: DataFrame, samples: list[tuple[str, bytes]], text_col: str = "text") -> DataFrame:
    """docs with lang_pred string, score double and lang_known boolean, from the text alone; columns of these names are replaced.

    lang_known is false where the text's phrases are as short as those of no language at all (see LEAST_PHRASE): another script, say.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "lang_known")
    at = docs.columns.index(text_col)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(samples)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                few = batch.slice(a, 2000)
                lang, score, known = own.predict(few.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*few.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.bool_())], names=[*few.schema.names, "lang_pred", "score", "lang_known"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_known", T.BooleanType())]
    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, *more]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang)."""
    own = docs.select("doc_id", "text", "lang")
    found = predict_language(own.select("doc_id", "text", held_out("doc_id").alias("held_out")), labelled_samples(own))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
