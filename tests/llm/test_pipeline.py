"""The pipeline against a plain version, and what __spark_entry__ registers."""

import random
import zlib

import corpus_pipeline
from ensemblake.llm import op3_language, op6_secrets
from ensemblake.llm.common import tokenizer_path
from tests.llm.test_duplicates import brute, edited, words
from tests.llm.test_filters import parse
from tests.llm.test_tokens import check_packing


def documents(rng):
    rows = [(None, "a row without an id " * 3), (1, None), (2, ""), (3, "123 !!"), (6, "plain short"), (6, "plain short")]
    for k in range(40):
        base = words(rng, rng.randint(20, 90))
        rows += [(9 * k + 12 + 3 * j, " ".join(edited(rng, base, j))) for j in range(3)]
    rows += [(30_000 + 3 * k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(80))) for k in range(40)]
    held_out = next(k for k in range(31_000, 32_000) if zlib.crc32(str(k).encode()) % 3 == 1)
    rows += [(held_out, "Это совсем другой язык " * 3), (6, "another text with that id"), (None, "another row without an id")]
    item = " ".join(words(rng, 30))
    rows += [(None, f"no id but {item} in it"), (12, f"a leak with an id that a clean text has {item}")]
    rows += [(1002, f"some start {item} some end"), (1005, "keep password=abcdefgh12 there " + " ".join(words(rng, 30)))]
    return rows, item


def test_pipeline_equals_plain_version(spark, tmp_path):
    rng = random.Random(12)
    rows, item = documents(rng)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x", 1.0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near-dedup", "decontamination", "secrets", "packing"]
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), list(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == docs.columns
        if name == "language":
            samples = op3_language.labelled_samples(docs.select("doc_id", "text", "lang"))
            known = lambda own: any(len(own) >= op3_language.LEAST_PHRASE * parse(own, x) for _, x in samples)  # noqa: B023, E731
            kept = [(d, t) for d, t in kept if op3_language.LETTER.search(t or "") and known(op3_language.symbols(t))]
            assert len(kept) == len(rows) - 4
        elif name == "near-dedup":
            own = list(dict.fromkeys(kept))
            part, _ = brute([(k if d is not None else None, t) for k, (d, t) in enumerate(own)])
            best = {}
            for k, (d, _) in enumerate(own):
                if d is not None and d < own[best.setdefault(part[k], k)][0]:
                    best[part[k]] = k
            kept = [x for k, x in enumerate(own) if x[0] is None or best[part[k]] == k]
        elif name == "decontamination":
            kept = [(d, t) for d, t in kept if item not in t]
        else:
            kept = [(d, t.replace("password=abcdefgh12", "<secret>")) for d, t in kept]
            assert op6_secrets.base_spans(" ".join(t for _, t in kept)) == []
        got = now.collect()
        assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((d or -1, t) for d, t in kept), name
        assert all(r.n_chars == len(r.text) and r.lang_pred == "x" and r.score == 1.0 for r in got)
    last = corpus_pipeline.STAGES[4][1](spark, now, str(tmp_path)).where("doc_id is not null").collect()
    assert sum(r.piece == 0 for r in last) == len([d for d, _ in kept if d is not None])
    whole = corpus_pipeline.run(spark, str(tmp_path)).where("doc_id is not null").collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in last)
    texts = [None] * (max(d // 3 for d, _ in kept if d) + 1)
    for d, t in kept:
        if d is not None and d % 3 == 0:
            texts[d // 3] = t
    own = [r for r in whole if r.doc_id % 3 == 0]
    assert {r.doc_id for r in own} == {3 * k for k, t in enumerate(texts) if t is not None} and check_packing is not None


def test_nothing_in_nothing_out(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert tokenizer_path("word_bpe_49k.json")
