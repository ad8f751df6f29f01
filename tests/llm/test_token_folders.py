"""Token files in a folder of their own: read and searched by another session; ids take few bits, and no id is one task."""

import random

import numpy as np

from ensemblake.llm import op8_token_files as files
from ensemblake.llm.common import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")


def test_written_here_and_read_in_another_session(spark, tmp_path):
    rng = random.Random(1)
    rows = [(None, "no id"), (None, None), (-(2**63), "least"), (2**63 - 1, "most"), (7, "twice"), (7, "twice"), (7, "and other")]
    rows += [(k * 3, " ".join(rng.choices("one two three four".split(), k=rng.randint(0, 9)))) for k in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = str(tmp_path / "tokens")
    here = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in files.read_tokens(files.write_tokens(docs, WORDS, segment_ids=40, out=out)).collect()}
    other = spark.newSession()
    segments, manifest = files.token_files(other, out)
    assert {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in files.read_tokens(segments).collect()} == here and len(here) == len(rows)
    assert manifest.count() == segments.count() > 5 and manifest.agg({"n_docs": "sum"}).first()[0] == len(rows)
    asked = [-(2**63), 2**63 - 1, 7, 30, 597, 31, -5]
    found = files.find_documents(segments, manifest, other.createDataFrame([(x,) for x in asked] * 2, "doc_id long")).collect()
    assert sorted((r.doc_id, r.start, len(r.ids)) for r in found) == sorted((d, s, n) for (d, s), (n, _) in here.items() if d in asked)
    assert {r.doc_id for r in found} == {-(2**63), 2**63 - 1, 7, 30, 597} and all(r.ids[-1] == 1 for r in found)


def test_bits_of_a_document():
    rng = np.random.default_rng(2)
    doc_ids = np.cumsum(rng.integers(1, 5, 20_000)).tolist()
    encoded = [np.full(n, 5, "<u4").tobytes() for n in rng.integers(1, 900, 20_000)]
    own = files.Segment.of(doc_ids, encoded)
    bits = 8 * (len(own.to_bytes()) - 2 * len(own.ids)) / len(doc_ids)
    assert bits < 20
    back = files.Segment.from_bytes(own.to_bytes())
    assert back.doc_ids == doc_ids and [back.places(doc_ids[k]) for k in (0, 77, 19_999)] == [range(k, k + 1) for k in (0, 77, 19_999)]
    assert back.places(doc_ids[-1] + 1) == range(20_000, 20_000)


def test_sequences_of_any_numbers():
    for values in ([], [0], [2**64 - 1], [0, 2**64 - 1], [5, 5, 5, 2**63], list(range(0, 10**6, 37))):
        own, end = files.EliasFano.from_bytes(b"xx" + files.EliasFano.of(np.array(values, np.uint64)).to_bytes() + b"y", 2)
        assert own.all().tolist() == values == [own.select(k) for k in range(len(values))]
        for v in values[:3]:
            assert own.first_not_below(v) == values.index(v)


def test_one_id_is_dealt_over_tasks(spark):
    docs = spark.createDataFrame([(None, f"text {k % 3}") for k in range(4000)], "doc_id long, text string").repartition(4)
    got = files.write_tokens(docs, WORDS)
    sizes = [r.n_docs for r in got.collect()]
    assert len(sizes) == 4 and max(sizes) < 2000 and sum(sizes) == 4000
