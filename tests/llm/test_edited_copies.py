"""Decontamination finds all that alignment of whole texts would: evenly edited copies, small vocabularies, gaps."""

import random
import tracemalloc

import numpy as np

from ensemblake.llm import op5_decontamination as leaks
from tests.llm.test_duplicates import score, words


def test_evenly_edited_copies(spark):
    rng = random.Random(11)
    items = [(k, " ".join(words(rng, 40))) for k in range(12)]
    rows, want = [], set()
    for k, text in items:
        for step in (3, 4, 5):
            copy = [f"e{rng.randrange(10**6)}" if j % step == step - 1 else w for j, w in enumerate(text.split())]
            spread = [x for j, w in enumerate(text.split()) for x in ([w, "so"] if j % step else [w])]
            for own in (copy, spread):
                rows.append((len(rows), " ".join([*words(rng, 60), *own, *words(rng, 60)])))
                if score(text.split(), own) >= min(len(text.split()), 26):
                    want.add((len(rows) - 1, k))
    found = leaks.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 36 and {(r.doc_id, r.item_id) for r in found.collect()} >= want


def test_found_copies_equal_alignment_of_whole_texts(spark):
    rng = random.Random(4)
    items = {k: words(rng, n, 40) for k, n in enumerate((1, 2, 3, 3, 5, 7, 8, 9, 11, 12, 14, 20, 27, 40))}
    texts = [None, "", *(" ".join(words(rng, rng.randint(1, 150), 60)) for _ in range(40))]
    for own in items.values():
        for _ in range(6):
            part = [x for w in own for x in rng.choice([[w], [w], [w], ["e"], [w, "e"], []])]
            texts.append(" ".join([*words(rng, 20, 400), *part, *words(rng, rng.randrange(2), 400)]))
    want = {}
    for t, text in enumerate(texts):
        for k, own in items.items():
            n, best = len(own), score(own, leaks.words(text))
            if best >= (2 * n if n < 8 else min(n, 26) if n >= 13 else 2 * n - n * (n - 7) / 6):
                want[t, k] = best / (2 * n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = leaks.contaminated(docs, spark.createDataFrame([(k, " ".join(own)) for k, own in items.items()], "item_id long, text string"))
    got = [tuple(r) for r in found.select("doc_id", "item_id", "score", "start", "end").collect()]
    assert {(t, k): s for t, k, s, _, _ in got} == want
    for t, k, s, a, z in got:
        assert score(items[k], leaks.words(texts[t][a:z])) == s * 2 * len(items[k])
    assert 60 < len(want) < len(texts) * len(items) // 2


def test_an_edited_copy_alone_is_found(spark):
    """However rare its seeds are elsewhere: the item is nowhere intact, every 4th to 8th word is changed, one copy a run."""
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, 60))) for k in range(5)]
    rows = []
    for (k, text), step in zip(items, range(4, 9), strict=True):
        rows.append((k, " ".join([*words(rng, 50), *(f"e{rng.randrange(10**6)}" if j % step == step - 1 else w for j, w in enumerate(text.split())), *words(rng, 50)])))
    found = leaks.contaminated(spark.createDataFrame(rows + [(9, " ".join(words(rng, 300)))], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k) for k in range(5)}


def test_alignment_in_long_texts_takes_little_memory():
    rng = random.Random(12)
    item = [rng.randrange(10**6) for _ in range(2000)]
    text = [rng.randrange(10**6) for _ in range(500)] + item * 15 + [rng.randrange(10**6) for _ in range(500)]
    tracemalloc.start()
    assert leaks.align(np.array(item), np.array(text)) == (4000, 500, 2500)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
