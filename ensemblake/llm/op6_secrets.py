"""Secret scan: key patterns, and random strings found by their low characters-per-token ratio."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, prepare, table, tokenizer_path

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: What the token-efficiency test looks at: unbroken runs of the characters keys are written in.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Known digests (MD5, SHA-1, SHA-2 lengths) and identifiers (UUIDs, numbers, dates) aren't secrets.
KNOWN = re.compile(r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})|[0-9_+/=-]+")
DIGIT, LETTER, FLIP = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[a-z][A-Z]")
#: Share of the ratio for runs of unmixed letters: random ones of 16 are mostly at 1.78 characters a token, long words above 2.
UNMIXED = 0.925
#: The pattern that splits text before the merges of a rank file (a fixed value of that vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three pattern kinds, in code points, by start and kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class TokenEfficiency:
    """Random strings: runs that a vocabulary needs many tokens for.

    A run counts when it isn't a known digest or identifier and has fewer than `ratio` characters a token. Runs without
    digits whose case doesn't change back and forth may be words, and count below UNMIXED of that ratio.
    """

    def __init__(self, ranks_path: str, ratio: float = 2.0):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("secrets", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ratio = ratio

    def is_random(self, run: str) -> bool:
        if KNOWN.fullmatch(run):
            return False
        mixed = LETTER.search(run) and DIGIT.search(run) or len(FLIP.findall(run)) >= 2
        return len(run) < self.ratio * (1 if mixed else UNMIXED) * len(self.encode(run))

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Runs that don't overlap a span already taken; `taken` is in order of starts."""
        starts, reach = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
        free = lambda s, e: not (k := bisect_left(starts, e)) or reach[k - 1] <= s
        return [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if free(*m.span()) and self.is_random(m[0])]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def all_spans(text: str | None, ranks_path: str, ratio: float) -> tuple[list, list]:
    """Base spans, and base with added ones; null is an empty text."""
    test = only(("secrets", ranks_path, ratio), lambda: TokenEfficiency(ranks_path, ratio))
    base = base_spans(text or "")
    return base, sorted(base + test.spans(text or "", base))


def scan_secrets(docs: DataFrame, ranks_path: str, ratio: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, counts by kind, digest of the base spans, all spans.

    Null text is an empty one; other columns of docs are ignored; repeated rows are judged each.
    """
    prepare(docs.sparkSession)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, spans = ([], [], []), [], []
            for text in batch.column(1):
                base, both = all_spans(text.as_py(), ranks_path, ratio)
                for k in range(3):
                    n[k].append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(both))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    own = docs.select(id_col, text_col)
    return own.mapInArrow(scan, f"`{id_col}` {own.dtypes[0][1]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, ranks_path: str, ratio: float = 2.0, mark: str = "<secret>", text_col: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by a mark; all columns and rows stay, null texts too."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def redact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            out = []
            for cell in batch.column(at):
                text, done, parts = cell.as_py(), 0, []
                if text:
                    for s, _, e in all_spans(text, ranks_path, ratio)[1]:
                        if e > done:
                            parts += [text[done:max(s, done)], mark] if s >= done else []
                            done = e
                    text = "".join(parts) + text[done:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, c.type) if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(redact, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
