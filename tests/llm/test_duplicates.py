"""Near duplicates and decontamination against brute force."""

import itertools
import random

import numpy as np
import pytest

from ensemblake.llm import op5_decontamination as leaks
from ensemblake.llm import op7_near_duplicates as near
from tests.llm.test_filters import components


def words(rng, n, pool=4000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def edited(rng, own, n):
    own = list(own)
    for _ in range(n):
        own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
    return own


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(5)
    for counted in (False, True):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        weight = rng.integers(1, 9, 400).astype(float) if counted else np.ones(400)
        a, b = (pool[:300], weight[:300]), (pool[80:], np.maximum(1, weight[80:] - 1) if counted else weight[80:])
        a, b = ((np.sort(x[0]), x[1][np.argsort(x[0])]) for x in (a, b))
        k = 3000
        got = near.signatures([a, b], k)
        assert abs((got[0] == got[1]).mean() - near.similarity(a, b)) < 4 * np.sqrt(0.25 / k)


def test_signatures_of_small_and_large_sets():
    sets = [(np.arange(n, dtype=np.uint64), np.ones(n)) for n in (1, 2, 7, 20_000)]
    got = near.signatures(sets)
    assert got.shape == (4, near.COORDINATES) and got.all() and np.array_equal(got, near.signatures(sets[::-1])[::-1])


def test_shingles_are_exact():
    rng = random.Random(1)
    texts = [" ".join(words(rng, n, 6)) for n in (1, 2, 4, 5, 6, 50, 400)]
    seen = {}
    for t in texts:
        w = t.split()
        want = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))]
        got = near.shingles(near.normal(t)).tolist()
        assert len(got) == len(want)
        for g, x in zip(got, want, strict=True):
            assert seen.setdefault(g, x) == x
    assert len(set(seen.values())) == len(seen) and not near.shingles(b"").size


def brute(rows, threshold=0.8):
    own = {}
    for k, t in rows:
        w = near.WORD.findall((t or "").lower())
        if w and k is not None:
            own[k] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))}
    return components([(a, b) for a, b in itertools.combinations(own, 2) if len(own[a] & own[b]) >= threshold * len(own[a] | own[b])] + [(a, a) for a in own]), own


def test_classes_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "ONE!"), (6, "one two"), (7, None)]
    for k in range(12):
        base = words(rng, rng.randint(30, 300))
        for j in range(rng.choice([1, 2, 3, 25])):
            rows.append((100 * k + j + 10, " ".join(edited(rng, base, rng.randint(0, len(base) // 25)))))
    chain = words(rng, 200)
    for j in range(12):  # neighbours are near, ends aren't
        rows.append((5000 + j, " ".join(chain)))
        chain = chain[3:] + words(rng, 3)
    rows += [(6000 + j, " ".join(words(rng, 60))) for j in range(60)] + [(7000, "big " * 40_000), (7001, "BIG, " * 40_000)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, digest string, rep int")
    want, _ = brute(rows)
    got = {r.doc_id: r for r in near.near_duplicates(df).collect()}
    assert {k: got[k].class_id for k in got} == {k: want.get(k, k) for k, _ in rows}
    sizes = {}
    for k in got:
        sizes[got[k].class_id] = sizes.get(got[k].class_id, 0) + 1
    assert all(got[k].n_links == sizes[got[k].class_id] - 1 for k in got)


def test_no_duplicates_no_rows_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in near.near_duplicates(df).collect()) == [("1", "1", 0), ("1", "1", 0), ("2", "2", 0), ("None", "None", 0)]
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_one_id_on_several_texts(spark):
    a, b = "one two three four five six seven", "a text that no other row has at all"
    rows = [(1, a), (0, a), (1, b), (None, b), (1, None), (2, a.upper()), (1, a)]
    got = sorted((str(r.doc_id), r.class_id, r.n_links, r.first) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, 0, 2, False), (0, 0, 2, True), (1, 1, 0, True), (None, None, 0, True), (1, 1, 0, True), (2, 0, 2, False), (1, 0, 2, False)]
    assert got == sorted((str(k), *x) for k, *x in want)


@pytest.mark.parametrize("split", [3, 1000])
def test_texts_on_a_template(spark, monkeypatch, split):
    """Many texts that share bands but aren't near, a few near pairs among them."""
    monkeypatch.setattr(near, "SPLIT", split)
    rng = random.Random(21)
    frame, rows = words(rng, 160), []
    for k in range(60):
        own = frame + words(rng, 30)
        rows.append((2 * k, " ".join(own)))
        if k % 6 == 0:
            rows.append((2 * k + 1, " ".join(edited(rng, own, 1))))
    want, _ = brute(rows)
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: want[k] for k, _ in rows} and len(set(want.values())) < len(rows)


def score(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        row[i][j] = max(0, row[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), row[i - 1][j] - 1, row[i][j - 1] - 1)
        best = max(best, row[i][j])
    return best


def test_alignment_equals_the_textbook_recurrence():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 15))] for _ in range(2))
        best, s, e = leaks.align(np.array(a), np.array(b))
        assert best == score(a, b)
        assert best == 0 or score(a, b[s:e]) == best


def test_leaks(spark):
    rng = random.Random(3)
    items = [(k, " ".join(words(rng, rng.randint(15, 55), 900))) for k in range(40)] + [(90, None), (91, ""), (92, "lone"), (93, "two words"), (3, "same id again")]
    rows, want = [(0, None), (1, ""), (2, "lone"), (3, "so LONE, it is"), (4, "two, words")], {(2, 92), (3, 92), (4, 93)}
    for d in range(200):
        own, kind = words(rng, rng.randint(60, 400), 900), d % 5
        k, text = items[rng.randrange(4, 40)]
        part = text.split()
        if kind == 1:
            own[30:30] = part
        elif kind == 2:
            own[10:10] = edited(rng, part, len(part) // 6)
        elif kind == 3:
            del part[len(part) // 2]
            own += [w.upper() + "," for w in part]
        if kind in (1, 2, 3):
            want.add((100 + d, k))
        rows.append((100 + d, " ".join(own)))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int").repartition(3)
    found = leaks.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    text = dict(rows)
    for r in found.collect():
        assert 0.5 <= r.score <= 1 and 0 <= r.start < r.end <= len(text[r.doc_id])
        if r.score == 1:
            assert leaks.words(text[r.doc_id][r.start : r.end]) == leaks.words(dict(items)[r.item_id])
    assert leaks.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leaks.contaminated(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_rows_of_one_id_and_without_an_id(spark):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, 20))) for k in range(10)]
    rows = [(k % 4 if k else None, f"x y {t} z") for k, t in items] + [(1, "clean"), (1, f"x y {items[1][1]} z"), (None, "clean too")]
    found = leaks.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((str(r.doc_id), r.item_id) for r in found.collect()) == sorted([(str(k % 4 if k else None), k) for k, _ in items] + [("1", 1)])


def test_filter_and_words(spark):
    hashes, text, place = leaks.word_hashes(["One two", None, "", "  ", "two, ONE two", "é"])
    assert text.tolist() == [0, 0, 4, 4, 4, 5] and place.tolist() == [0, 1, 0, 1, 2, 0] and hashes[0] == hashes[3] and hashes[1] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3
    assert [len(x) for x in leaks.word_hashes([None])] == [0, 0, 0]
    seeds = [k for _, k, _ in leaks.seeds_of("a b c d")]
    own = leaks.Filter(spark.createDataFrame([(k,) for k in seeds], "seed long"))
    found = {(int(t), int(p), d) for d in (1, 2) for t, p, _ in [own.hits(["a b", "a x b c", "c a"], [d]).__next__()] for t, p in zip(t, p)}
    assert found == {(0, 0, 1), (1, 2, 1), (1, 0, 2)}


@pytest.mark.parametrize("text", ["İstanbul aranan metin", "ß İİ x"])
def test_spans_of_letters_that_grow(text):
    assert [text[a:z].lower() for a, z in leaks.spans_of(text)][-1] == leaks.words(text)[-1]
