"""Encoding, token files, packing and piece counts against the libraries and brute force."""

import functools
import itertools
import os
import random
import subprocess
import sys
import time
import zlib
from array import array
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from ensemblake.llm.encoding import WordEncoder, by_words
from ensemblake.llm.op8_token_files import EliasFano, Segment, read_tokens, write_tokens
from ensemblake.llm.op9_counts import SPACE, PieceCounter, count_tokens, pieces_of
from ensemblake.llm.op10_packing import pack, places, plan

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, "It's we'll THE end", "a\x1cb \x0b c\x85d e f", "é ́x  y", "<|endoftext|> x<|startoftext|>y", "日本語 テスト ΑΣ Σ", "\n\n\t ", "x" * 3000, "12 3456 !!?? 'S", "É" * 50 + " ß", "İ. x̌, ñ. क़. a<|Endoftext|>. It's, A., .. , ,a ﬁ. ǅ, K."]


def rows(spark, texts, extra=False):
    own = [(i * 3, t, i, "p") for i, t in enumerate(texts)]
    df = spark.createDataFrame(own, "doc_id long, text string, start long, image string")
    return df if extra else df.select("doc_id", "text")


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_matches_library_on_whole_texts():
    rng = random.Random(3)
    noise = ["".join(rng.choice("ab'sTé́ \n\t \x1c　ſK!?12Σ") for _ in range(rng.randrange(80))) for _ in range(300)]
    encoder = WordEncoder(WORDS, limit_bytes=2000)
    for _ in range(2):
        assert [array("I", x).tolist() for x in encoder.encode(TEXTS + noise)] == [ids(t) for t in TEXTS + noise]


def test_encoder_matches_library_at_stops_between_slices_and_after_forgetting(monkeypatch):
    monkeypatch.setattr("ensemblake.llm.encoding.SLICE_CHARS", 500)
    rng = random.Random(4)
    signs = [*"abTéÉßÿ÷×ÀÞµªº.,.,  '\n\t\r\x0b\x85\xa0\x1c!?1<|Σσſİ“’й", "<|endoftext|>", "'s", "the ", "é.", "H̱. ", "x.\n"]
    for limit in (500, 20_000, 16_000_000):
        encoder = WordEncoder(WORDS, limit_bytes=limit)
        for few in (len(signs), 20, len(signs)):
            texts = [None, "", *("".join(rng.choice(signs[:few]) for _ in range(rng.randrange(90))) for _ in range(300))]
            assert [array("I", x).tolist() for x in encoder.encode(texts)] == [ids(t) for t in texts]
            assert limit > 500 or len(encoder.words) < 500


def invented(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(("an", "er", "ti", "on", "sh", "é", "ou", "ble")) for _ in range(9)) for _ in range(n)]


def test_words_that_are_known_take_less_than_a_step_of_python_each():
    words = invented(60_000, 1)
    text = " ".join(words * 10)
    encoder = WordEncoder(WORDS)
    known = dict(zip(words, encoder.encode(words), strict=True))
    assert len(list(encoder.encode([text]))[0]) == 10 * sum(len(known[w]) - 4 for w in words) + 4

    def seconds(work):
        took = []
        for _ in range(4):
            at = time.process_time()
            work()
            took.append(time.process_time() - at)
        return min(took)

    assert seconds(lambda: list(encoder.encode([text]))) < seconds(lambda: b"".join(map(known.__getitem__, text.lower().split(" "))))


def test_memory_of_many_distinct_words():
    code = f"""
import re
from ensemblake.llm.encoding import WordEncoder
from tests.llm.test_tokens import invented
anon = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
encoder = WordEncoder({WORDS!r})
list(encoder.encode(["one"]))
had = anon()
for seed in range(20):
    for _ in encoder.encode([" ".join(invented(30_000, seed))]):
        pass
print(anon() - had)
"""
    env = os.environ | {"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1000000", "ARROW_DEFAULT_MEMORY_POOL": "system"}
    got = subprocess.run([sys.executable, "-c", code], env=env, cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=300)
    assert float(got.stdout) < 45, got.stdout


def test_encoder_matches_a_library_of_another_kind():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert by_words(WORDS) and not by_words(path)
    own = Tokenizer.from_file(path)
    assert [array("I", x).tolist() for x in WordEncoder(path).encode(TEXTS)] == [[*own.encode(t or "", add_special_tokens=False).ids, 1] for t in TEXTS]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 900, 900, 10**9], list(range(0, 5000, 7)), [3] * 200 + [10**7]])
def test_elias_fano_round_trip_and_select(values):
    own = EliasFano.of(np.array(values, np.int64))
    assert own.all().tolist() == values
    assert [own.select(k) for k in range(len(values))] == values
    with pytest.raises(IndexError):
        own.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1500, 20_000))
    own = EliasFano.of(ends)
    assert (own.low.nbytes + own.high.nbytes + own.selects.nbytes) * 8 < len(ends) * (3.5 + np.log2(ends[-1] / len(ends)))


def test_segment_round_trip():
    own = Segment.of([None, 4, 9], [array("I", x).tobytes() for x in ([1], [7, 8, 1], [65535 * 3, 1])])
    back = Segment.from_bytes(own.to_bytes())
    assert back.doc_ids == [None, 4, 9] and back.ids.tolist() == [1, 7, 8, 1, 65535 * 3, 1]
    assert [back.offsets(k) for k in range(3)] == [(0, 1), (1, 4), (4, 6)]


@pytest.mark.parametrize("segment_ids", [1, 40, 10**6])
def test_token_files(spark, segment_ids):
    texts = TEXTS * 3
    docs = rows(spark, texts, extra=True).repartition(5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(write_tokens(docs, WORDS, segment_ids=segment_ids)).collect()}
    at = 0
    for i, t in enumerate(texts):
        own = ids(t)
        assert got[3 * i] == (at, len(own), zlib.crc32(array("I", own).tobytes()))
        at += len(own)


def test_token_files_of_nothing(spark):
    assert read_tokens(write_tokens(rows(spark, []), WORDS)).collect() == []


def test_token_files_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "b"), (2, "a"), (2, "a"), (2, "c d"), (-5, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in read_tokens(write_tokens(docs, WORDS)).collect())
    assert [(d, n) for _, d, n in got] == [(None, 2), (-5, 1), (2, 2), (2, 2), (2, 3)]
    assert [s for s, _, _ in got] == [0, 2, 3, 5, 7]


def check_packing(got, texts, capacity):
    want = Counter()
    for i, t in enumerate(texts):
        own = ids(t)
        for k, a in enumerate(range(0, len(own), capacity)):
            part = own[a : a + capacity]
            want[3 * i, k, a, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *itertools.accumulate(n for _, n in spans[:-1])] and sum(n for _, n in spans) <= capacity
    return len(by)


def test_packing(spark):
    texts = TEXTS * 4 + ["one two three"] * 40
    total = sum(len(ids(t)) for t in texts)
    n = check_packing(pack(rows(spark, texts, extra=True).drop("start").repartition(3), WORDS, capacity=64).collect(), texts, 64)
    assert n <= -(-total // 64) + 1
    assert pack(rows(spark, []), WORDS).collect() == []


def test_packing_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b")] * 9, "doc_id long, text string")
    got = pack(docs, WORDS, capacity=6).collect()
    assert sorted((r.sequence_id, r.offset) for r in got) == [(s, o) for s in range(5) for o in (0, 3)][:9]


def test_plan_is_optimal_on_small_cases():
    def fewest(sizes, capacity):
        best = len(sizes)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best and k < len(sizes):
                return
            if k == len(sizes):
                best = min(best, len(bins))
                return
            for j in {b: j for j, b in enumerate(bins)}.values():
                if bins[j] + sizes[k] <= capacity:
                    go(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]])
            go(k + 1, [*bins, sizes[k]])

        go(0, [])
        return best

    rng, over = random.Random(5), 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(0, 9))), reverse=True)
        made = plan(Counter(sizes), 20)
        assert Counter(x for lengths, n in made for x in lengths * n) == Counter(sizes) and all(sum(x) <= 20 for x, _ in made)
        over += sum(n for _, n in made) - fewest(sizes, 20)
        assert sum(n for _, n in made) <= fewest(sizes, 20) + 1
    assert over <= 3


def test_plan_of_many_lengths_is_quick():
    rng = random.Random(9)
    counts = Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(10_000))
    at = time.process_time()
    made = plan(counts)
    took = time.process_time() - at
    assert sum((Counter({x: n * lengths.count(x) for x in lengths}) for lengths, n in made), Counter()) == counts
    assert sum(n for _, n in made) <= -(-sum(k * n for k, n in counts.items()) // 4096) + 2 and took < 10


def test_plan_exact_complements_and_places():
    assert sum(n for _, n in plan({4000: 10**6, 96: 10**6, 2000: 500, 1000: 500, 1096: 500, 4096: 7})) == 10**6 + 500 + 7
    spots = places([((5, 3), 4), ((3, 3), 2)])
    assert spots == [(5, 0, 4, 0, 0), (3, 0, 4, 0, 5), (3, 4, 6, 4, 0), (3, 6, 8, 4, 3)]


def unigram(pieces, byte_fallback):
    from tokenizers import Tokenizer, models

    extra = [(f"<0x{b:02X}>", 0.0) for b in range(256)] if byte_fallback else []
    return Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items(), *extra], unk_id=0, byte_fallback=byte_fallback))


def test_counts_match_unigram_model_with_ties():
    rng = random.Random(11)
    for byte_fallback in (True, False):
        for trial in range(60):
            names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)} | ({SPACE} if trial % 2 else set())
            names |= {SPACE + n for n in list(names)[:4]}
            pieces = {n: float(-rng.randint(0, 4)) for n in sorted(names)}
            own, library = PieceCounter(pieces, byte_fallback), unigram(pieces, byte_fallback)
            for _ in range(30):
                text = "".join(rng.choice("abcd é") for _ in range(rng.randint(1, 14)))
                assert own.count_text(text) == len(library.encode(SPACE + text.replace(" ", SPACE)).ids), (pieces, text, byte_fallback)


def test_counts_match_on_the_public_vocabulary(spark):
    pieces = pieces_of(PIECES)
    library = unigram(pieces, True)
    rng = random.Random(2)
    texts = [t for t in TEXTS if t and "<" not in t] + [" ".join("".join(rng.choice("etaoinshrdlué日") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(20)] + ["  two   spaces "]
    want = [len(library.encode(SPACE + t.replace(" ", SPACE)).ids) for t in texts]
    got = {r.doc_id: r.n_tokens for r in count_tokens(rows(spark, [*texts, "", None], extra=True).drop("start"), PIECES).collect()}
    assert [got[3 * i] for i in range(len(texts) + 2)] == [*want, 0, 0]
