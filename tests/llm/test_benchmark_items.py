"""Decontamination: every item is searched, whatever its id, and a few of its words in ordinary prose are no copy of a short one."""

import random

import pytest

from ensemblake.llm import op5_decontamination as leaks
from tests.llm.test_duplicates import score

COMMON = "the of and to a in is that it was for on are as with his they at be this from have or by one had not but what all".split()


def test_items_of_one_id_and_without_an_id(spark):
    rng = random.Random(3)
    text = {k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for k in range(5)}
    items = [("mmlu-1", text[0]), ("mmlu-1", text[1]), ("mmlu-1", text[1]), (None, text[2]), (None, text[3]), ("mmlu-2", text[3]), ("mmlu-3", None), (None, None), ("mmlu-4", "")]
    rows = [(k, f"some words before {t} and after") for k, t in text.items()]
    found = leaks.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    got = sorted((r.doc_id, r.item_id or "-", r.score) for r in found.collect())
    assert got == [(0, "mmlu-1", 1.0), (1, "mmlu-1", 1.0), (2, "-", 1.0), (3, "-", 1.0), (3, "mmlu-2", 1.0)]


def test_short_items_in_ordinary_prose(spark):
    """Items of 3 to 12 of the commonest words, in prose of nothing else: found where an alignment says so, and hardly ever where they weren't put."""
    rng = random.Random(5)
    items = {n * 10 + k: rng.choices(COMMON, k=n) for n in range(3, 13) for k in range(3)}
    texts = [rng.choices(COMMON, k=rng.randint(1, 200)) for _ in range(150)]
    put = set()
    for t, (k, own) in zip(range(0, 150, 2), list(items.items()) * 3, strict=False):
        texts[t][5:5] = own
        put.add((t, k))
    want = {}
    for t, words in enumerate(texts):
        for k, own in items.items():
            n, best = len(own), score(own, words)
            if best >= (2 * n if n < 8 else 2 * n - n * (n - 7) / 6):
                want[t, k] = best / (2 * n)
    docs = spark.createDataFrame([(t, " ".join(x)) for t, x in enumerate(texts)], "doc_id long, text string")
    found = leaks.contaminated(docs, spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.score for r in found.collect()}
    assert got == want and put <= got.keys()
    assert not [x for x in got.keys() - put if x[1] >= 50]


@pytest.mark.parametrize("salts", [1, 5])
def test_more_seeds_than_are_sent_out(spark, monkeypatch, salts):
    monkeypatch.setattr(leaks, "MOST_SENT", 0)
    monkeypatch.setattr(leaks, "SALTS", salts)
    rng = random.Random(7)
    items = [(k, " ".join(rng.choices(COMMON, k=14))) for k in range(20)]
    rows = [(k, " ".join([*rng.choices(COMMON, k=60), t, *rng.choices(COMMON, k=9)])) for k, t in items]
    found = leaks.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(k, k, 1.0) for k, _ in items} <= {(r.doc_id, r.item_id, r.score) for r in found.collect()}


def test_what_was_taken_for_a_copy(spark):
    items = [(1, "the capital of france"), (2, "what is the"), (3, "one two three four five six seven eight")]
    rows = [(1, "we saw the capital city there"), (2, "it is the best of all"), (3, "The capital of France, in spring"), (4, "one two three four and five"), (5, "so what is the matter")]
    found = leaks.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(3, 1), (5, 2)]
