"""Spelling variants equal a comparison of all words with all."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from ensemblake.llm import op11_spelling_variants as spelling

SCHEMA = "doc_id long, text string, word string, n int"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def all_against_all(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in known.items():
        own = [v for v in known if near(w, v)]
        best = min(own, key=lambda v: (-known[v], v), default=None)
        form = best if best is not None and known[best] >= 10 * n else None
        out[w] = [form, None, n, len(own), known[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def edits(rng, word):
    k = rng.randrange(len(word) + 1)
    letter = rng.choice("aábßz×")
    return rng.choice([word[:k] + letter + word[k:], word[:k] + word[k + 1 :], word[:k] + letter + word[k + 1 :], word[:k][::-1] + word[k:]])


def test_equal_to_all_pairs(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choices("abc", k=rng.randint(7, 11))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "Überraschung", "ÜBERraschung", "a" * 900]
    pool = []
    for s in stems:
        one = edits(rng, s)
        two = edits(rng, one)
        pool += [s] * 300 + [one] * 25 + [two] * 2 + [edits(rng, s) for _ in range(8) for _ in range(2)]
    rng.shuffle(pool)
    rows = [(None, "nothing without an id nothing", "x", 1), (None, None, None, 1), (1, None, None, 1), (2, "", None, 1), (3, "short one", None, 1)]
    rows += [(rng.choice((10, 11, 12, 13, k)), rng.choice((" ", "-", "1", "\n")).join(pool[k : k + 30]), None, 1) for k in range(0, len(pool), 30)]
    rows += rows[-3:]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = all_against_all(rows)
    assert got == want
    assert sum(x[0] is not None for x in want.values()) > 40 and any(x[0] and x[1] != x[0] for x in want.values())


def test_columns_and_empty_tables(spark):
    empty = spelling.spelling_variants(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    assert dict(empty.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


def test_ties_go_to_the_smallest_word(spark):
    rows = [(k, t, None, 1) for k, t in enumerate(["testinga"] * 2 + ["testingz"] * 40 + ["testingb"] * 40)]
    got = {r.word: r.form for r in spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["testinga"] == all_against_all(rows)["testinga"][0] == "testingb"


def test_rows_of_long_words_are_linear():
    texts = ["a" * 200_000, "abcdefgh", "abcdefg"]
    which, at, bucket, order, first = spelling.rows_of(texts)
    assert len(which) == sum(len(t) + 2 for t in texts)
    assert len(set(order[(which == 0) & (at >= 0)].tolist())) == 1 and first[which == 0].sum() == 1
    less = (which == 1) & (at == 7)
    assert order[less] == order[(which == 2) & (at == -1)][0] and np.isin(bucket[less], bucket[(which == 2) & (at == -1)]).all()
