"""Fill-in-middle: texts are ropes; two cuts by unit rank, subtrees put in another order between sentinels, undone by cuts at the sentinels."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 documents so many stay as they are; of 100 others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Code points of a leaf, about: a leaf ends where a unit does.
LEAF = 2048


@dataclass(frozen=True)
class Leaf:
    """A run of whole units."""

    text: str
    units: int

    @cached_property
    def chars(self) -> int:
        return len(self.text)

    depth = 0


class Node:
    """Two subtrees in order; what they hold in units and code points is kept, so a rank is found from the root down."""

    __slots__ = ("chars", "depth", "left", "right", "units")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.units, self.chars, self.depth = left.units + right.units, left.chars + right.chars, 1 + max(left.depth, right.depth)


Rope = Leaf | Node
EMPTY = Leaf("", 0)


class Units:
    """What counts as one: a code point, or with a pattern what lies from the start of a match to that of the next (what precedes the first belongs to it). A pattern can't look behind."""

    def __init__(self, pattern: str | None = None):
        self.find = re.compile(pattern, re.DOTALL).finditer if pattern else None

    def starts(self, text: str) -> range | list[int]:
        if self.find is None:
            return range(len(text))
        return [0, *[m.start() for m in self.find(text)][1:]] if text else []

    def rope(self, text: str, leaf: int = LEAF) -> Rope:
        """A balanced tree over leaves of some leaf code points."""
        if self.find is None:
            return balanced([Leaf(text[a : a + leaf], min(leaf, len(text) - a)) for a in range(0, len(text), leaf)])
        starts, leaves, first = [*self.starts(text), len(text)], [], 0
        for k in range(1, len(starts)):
            if k == len(starts) - 1 or starts[k] - starts[first] >= leaf:
                leaves.append(Leaf(text[starts[first] : starts[k]], k - first))
                first = k
        return balanced(leaves)

    def place(self, leaf: Leaf, rank: int) -> int:
        """Code points of a leaf's first rank units; a leaf starts with a unit, so its own text says where they end."""
        return rank if self.find is None else [*self.starts(leaf.text), leaf.chars][rank]


def balanced(leaves: list[Rope]) -> Rope:
    """A tree over leaves in order: neighbours are paired until one is left."""
    while len(leaves) > 1:
        leaves = [Node(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def concat(*parts: Rope) -> Rope:
    """Parts in order; none is copied."""
    return balanced([p for p in parts if p.chars] or [EMPTY])


def split(rope: Rope, rank: int, units: Units | None) -> tuple[Rope, Rope]:
    """The first rank units (code points where units is None) and the rest: one path of the tree is made anew, all else is shared."""
    size = rope.chars if units is None else rope.units
    if rank <= 0:
        return EMPTY, rope
    if rank >= size:
        return rope, EMPTY
    if isinstance(rope, Leaf):
        at = rank if units is None else units.place(rope, rank)
        first = rank if units is not None else 0
        return Leaf(rope.text[:at], first), Leaf(rope.text[at:], rope.units - first)
    here = rope.left.chars if units is None else rope.left.units
    if rank < here:
        a, b = split(rope.left, rank, units)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - here, units)
    return concat(rope.left, a), b


def leaves(rope: Rope) -> Iterator[str]:
    """Texts of the leaves in order, without recursion."""
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, Leaf):
            yield top.text
        else:
            stack += (top.right, top.left)


def text_of(rope: Rope) -> str:
    return "".join(leaves(rope))


def find(rope: Rope, mark: str, start: int = 0) -> int:
    """Code points before the first mark from start on, -1 if there is none; a mark may lie over the border of leaves."""
    seen, tail = 0, ""
    for piece in leaves(rope):
        own = tail + piece
        at = own.find(mark, max(0, start - (seen - len(tail))))
        if at >= 0:
            return seen - len(tail) + at
        seen += len(piece)
        tail = own[max(0, len(own) - len(mark) + 1) :]
    return -1


def draws(seed: str, doc_id: object) -> list[int]:
    """Four numbers of 32 bits from a document's id: where both cuts are, and which form it takes."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearrange(text: str, drawn: list[int], units: Units) -> tuple[int, str, Rope, int | None, int | None]:
    """Units of a text, form, the rearranged rope, and the code points of prefix and middle (None where it stays plain)."""
    rope = units.rope(text)
    h1, h2, h3, h4 = drawn
    n = rope.units
    if not text or h3 % 100 >= 100 - PLAIN or any(s in text for s in SENTINELS):
        return n, "plain", rope, None, None
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = split(rope, first, units)
    middle, suffix = split(rest, last - first, units)
    mark = {s: Leaf(s, 0) for s in SENTINELS}
    if h4 % 100 < SUFFIX_FIRST:
        form, out = "spm", concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    else:
        form, out = "psm", concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    return n, form, out, prefix.chars, middle.chars


def invert(output: str, form: str) -> str:
    """The text again, from the output and its form alone: the tree is cut at its sentinels.

    No text with a sentinel is rearranged, and no sentinel's end is another's start, so the first of each kind is the one that was put in.
    """
    if form == "plain":
        return output
    rope = Units().rope(output)
    second = SUFFIX if form == "psm" else PREFIX
    at = find(rope, second, 3)
    last = find(rope, MIDDLE, at + 3)
    if at < 0 or last < 0:
        raise ValueError(f"an output of form {form} without its sentinels")
    rest, middle = split(rope, last, None)
    one, two = split(rest, at, None)
    one, two, middle = (split(x, 3, None)[1] for x in (one, two, middle))
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return text_of(concat(prefix, middle, suffix))


def fill_in_middle(docs: DataFrame, unit: str | None = None, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n units, form, prefix_chars, middle_chars, output (the rearranged text).

    unit: a pattern of which each match starts a unit; none: code points. Cuts and form follow from seed and id alone, so rows that share an id are cut
    at equal draws, and rows without one as if theirs were empty. Null texts count as empty; empty texts and texts that hold a sentinel stay plain, with null
    prefix_chars and middle_chars. Other columns of docs are left out, whatever their names. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, form, rope, prefix, middle = rearrange(text.as_py() or "", draws(seed, doc_id), units)
                rows.append((n, form, prefix, middle, text_of(rope)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select(id_col, text_col)
    return own.mapInArrow(work, f"`{id_col}` {own.dtypes[0][1]}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """rows and a column restored: the text of each output, from the output and its form. A null output or form gives null."""
    prepare(rows.sparkSession)
    if "restored" in rows.columns:
        raise ValueError("rows have a column restored already")
    output, form = rows.columns.index(output_col), rows.columns.index(form_col)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if f is None or not t.is_valid else invert(t.as_py(), f) for t, f in zip(batch.column(output), batch.column(form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "restored"])

    return rows.mapInArrow(work, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", restored string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), h AS (
    SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
    SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
    SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n - b) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
