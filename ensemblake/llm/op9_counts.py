"""Count-only Viterbi: how many pieces a unigram tokenizer makes of a text, without making them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, prepare, table, tokenizer_path

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


class PieceCounter:
    """Piece counts under a unigram vocabulary {piece: score}.

    An Aho-Corasick automaton enumerates every vocabulary match by its end; the best path to each end carries
    its score and its count. Ties go to the match that starts first, as a lattice filled from
    left to right with strict comparisons decides. A character that is no piece costs the lowest score less 10; it counts as
    its UTF-8 bytes with byte fallback, and a run of such characters as one without.
    Scores are summed in double precision.
    """

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True, limit: int = 400_000):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown, self.bytes, self.limit = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY, byte_fallback, limit
        self.known: dict[str, int] = {}
        #: Where no piece goes on over a word's start, texts fall apart there and repeated words are counted once.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in pieces) and SPACE in pieces

    def count(self, text: str) -> int:
        """Viterbi over one text, as it stands."""
        n = len(text)
        score, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.find.iter(text)
        end, found = next(matches, (n, None))
        for e in range(n):
            best = None
            single = False
            while end == e:
                size, worth = found
                single = single or size == 1
                start = e + 1 - size
                total = score[start] + worth
                if best is None or total > best[0] or (total == best[0] and start < best[1]):
                    best = (total, start)
                end, found = next(matches, (n, None))
            if not single and (best is None or score[e] + self.unknown > best[0]):
                score[e + 1], unknown[e + 1] = score[e] + self.unknown, True
                pieces[e + 1] = pieces[e] + (len(text[e].encode("utf-8", "surrogatepass")) if self.bytes else not unknown[e])
            else:
                score[e + 1], pieces[e + 1] = best[0], pieces[best[1]] + 1
        return pieces[n]

    WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def count_text(self, text: str | None) -> int:
        """Null and empty texts have no pieces; others get a leading space, and spaces are escaped."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.apart:
            return self.count(text)
        total, known = 0, self.known
        for word in self.WORD.findall(text):
            n = known.get(word)
            if n is None:
                n = self.count(word)
                if len(known) >= self.limit:
                    known.clear()
                if len(word) <= 64:
                    known[word] = n
            total += n
        return total


def pieces_of(model_path: str) -> dict[str, float]:
    """Ordinary pieces and scores of a sentencepiece file; control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id and n_tokens long, over the whole text. Null and empty texts: 0."""
    prepare(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = only(("pieces", model_path), lambda: PieceCounter(pieces_of(model_path)))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.count_text(x.as_py()) for x in batch.column(1)], pa.int64())], names=[id_col, "n_tokens"])

    own = docs.select(id_col, text_col)
    return own.mapInArrow(count, f"`{id_col}` {own.dtypes[0][1]}, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
