"""Fill-in-middle: literal slicing gives the same outputs, and texts come back from outputs and forms alone."""

import hashlib
import random
import re

from ensemblake.llm import op13_fill_in_middle as fim

SCHEMA = "doc_id long, text string, form string, output int"


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_outputs_equal_slices_and_texts_come_back(spark):
    rng = random.Random(3)
    pieces = ["a", "é", "漢", "😀", "<", ">", "S", "<S", "P>", "\n", " ", "́", "\x00"]
    rows = [(None, None, "x", 1), (None, "no id", None, 1), (1, None, None, 1), (2, "", None, 1), (3, "has <M> in it", None, 1), (4, "<P>", None, 1), (5, "a", None, 1), (5, "another text", None, 1), (6, "twice", None, 1), (6, "twice", None, 1)]
    rows += [(k, "".join(rng.choices(pieces, k=rng.choice((1, 2, 3, 40, 5000, 70_000)))), None, 1) for k in range(10, 130)]
    got = fim.restored(fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    assert len(got) == len(rows)
    want = sorted([(repr(i), *map(repr, plain_version(i, t)), repr(t or "")) for i, t, _, _ in rows])
    assert sorted((repr(r.doc_id), *map(repr, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), repr(r.restored)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_an_empty_table_and_names_of_ones_own(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fim.restored(fim.fill_in_middle(empty)).collect() == []
    named = spark.createDataFrame([("x-1", "some text", 3)], "key string, body string, n int")
    row = fim.restored(fim.fill_in_middle(named, id_col="key", text_col="body")).first()
    assert row.key == "x-1" and row.restored == "some text" and row.n == 9


def test_units_by_pattern():
    """Words as units: cuts fall on starts of words, whatever the leaves are."""
    rng = random.Random(5)
    units = fim.Units(r"\w+")
    for size in (0, 1, 7, 400, 3000):
        text = " ".join("".join(rng.choices("abçd", k=rng.randint(1, 9))) for _ in range(size))
        text = f"  {text}." if size else text
        starts = [0, *[m.start() for m in re.finditer(r"\w+", text)][1:]] if text else []
        rope = units.rope(text, leaf=64)
        assert rope.units == len(starts) and fim.text_of(rope) == text
        for rank in {0, 1, size // 3, size // 2, size - 1, size}:
            if not 0 <= rank <= len(starts):
                continue
            a, b = fim.split(rope, rank, units)
            cut = [*starts, len(text)][rank]
            assert (fim.text_of(a), fim.text_of(b)) == (text[:cut], text[cut:])
            assert (a.units, b.units, a.chars, b.chars) == (rank, len(starts) - rank, cut, len(text) - cut)
        n, form, out, prefix, middle = fim.rearrange(text, [17, 5, 0, 50], units)
        assert n == len(starts) and fim.invert(fim.text_of(out), form) == text
        assert form == "plain" or {prefix, prefix + middle} <= {*starts, len(text)}


def test_trees_stay_low_and_share_leaves():
    text = "".join(chr(97 + k % 26) for k in range(1_000_000))
    rope = fim.Units().rope(text)
    assert rope.depth <= 10
    a, b = fim.split(rope, 654_321, fim.Units())
    assert max(a.depth, b.depth) <= 2 * rope.depth
    old = {id(x) for x in nodes(rope)}
    assert sum(id(x) not in old for x in [*nodes(a), *nodes(b)]) <= 4 * rope.depth
    assert fim.find(fim.concat(fim.Leaf("ab<", 3), fim.Leaf("S", 1), fim.Leaf("><M>", 4)), "<S>") == 2
    assert fim.find(fim.concat(fim.Leaf("<S>a<", 5), fim.Leaf("S>", 2)), "<S>", 1) == 4


def nodes(rope):
    return [rope] if isinstance(rope, fim.Leaf) else [rope, *nodes(rope.left), *nodes(rope.right)]
