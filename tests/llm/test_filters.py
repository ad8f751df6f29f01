"""URL filter, quality rules, sharding and language ID against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ensemblake.llm import op1_sharding, op2_urls, op3_language, op4_quality, op7_near_duplicates
from ensemblake.llm.graph import connected_components


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, edges[0]], "a long, b long")).collect()}
    assert got == {k: v for k, v in components([e for e in edges if e[0] != e[1]]).items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_few_tasks(spark):
    """The driver keeps a record of each task, so rounds over a few links must not cost one a partition of every shuffle."""
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(k, 1000 - k) for k in range(200, 260)]
    links, want = spark.createDataFrame(edges, "a long, b long"), components(edges)
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, tracker = {k: spark.conf.get(k) for k in held}, spark.sparkContext.statusTracker()

    def tasks(group, few):
        spark.sparkContext.setJobGroup(group, group)
        got = {r.node: r.component for r in connected_components(links, few).collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == want
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s)))

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert 0 < tasks("few-links", op7_near_duplicates.FEW_LINKS) < tasks("many-links", len(edges) - 1) / 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def url_brute(pages, rules):
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]

    def rule(url):
        host, path = parts(url)
        found = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(found, key=lambda r: len(r[1] + r[2]), default=None)

    def key(url):
        if url is None or "://" not in url:
            return None
        host, path = parts(url)
        query = (re.match(r"[^?#]*\?([^#]*)", url) or [0, ""])[1].split("&")
        query = "&".join(x for x in query if x and not re.match(r"(?i)(utm_[a-z]+|ref|fbclid|gclid)=", x))
        return re.sub(r":(80|443)$", "", re.sub(r"^(www|m)\.", "", host)), path.rstrip("/"), query

    edges = []
    said = defaultdict(set)
    for _, url, html in pages:
        if key(url) and rule(url):
            said[key(url)].add(rule(url)[0])
        for target in re.findall(r'(?:canonical" href|url)="?([^"]+)"', html or ""):
            if key(url):
                edges.append((key(url), key(target)))
                said[key(target)] |= {rule(target)[0]} if rule(target) else set()
    part = components(edges)
    by = defaultdict(set)
    for k, v in said.items():
        by[part.get(k, k)] |= v
    out = []
    for page, url, _ in pages:
        own = rule(url)
        shared = by.get(part.get(key(url), key(url)), set()) if key(url) else set()
        out.append((page, *parts(url), own and own[1] + own[2], own[0] if own else "allow" if "allow" in shared or "block" not in shared else "block"))
    return out


def test_urls(spark):
    rng = random.Random(9)
    pool = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in ("a.example.net", "WWW.b.org", "b.org", "m.shop.io", "shop.io", "x.example.com", "c.dev", "net") for p in ("", "/", "/en/1", "/de/1?utm_source=f", "/fr/2#top", "/q?page=2&ref=x", "/z/")]
    pages = [(None, None, None), (1, "no scheme", "x"), (2, "://", ""), (3, "http://EXAMPLE.NET/en/?a://b/#", None)]
    for k in range(300):
        html = "<html>"
        if rng.random() < 0.03:
            html += f'<LINK rel="canonical" href="{rng.choice(pool)}">'
        if rng.random() < 0.02:
            html += f'<meta http-equiv="refresh" content="0; url={rng.choice(pool)}">'
        pages.append((10 + k // 2, rng.choice(pool), html))
    df = spark.createDataFrame([(*p, "c", "v") for p in pages], "page_id long, url string, html string, node string, verdict string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in op2_urls.judge(df).collect()]
    assert Counter(got) == Counter(url_brute(pages, op2_urls.RULES))
    assert {"block", "allow"} <= {g[4] for g in got if g[3] is None}
    assert op2_urls.judge(df.limit(0)).count() == 0


def test_names_that_end_like_a_tracking_parameter_count(spark):
    urls = [f"http://x.dev/?{q}" for q in ("pageref=1", "pageref=2", "xref=1", "href=1", "ref=1", "ref=2&", "a=1&ref=5&b=2", "b=2", "a=1&b=2", "a=1&&b=2&UTM_Source=q")]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(op2_urls.alias_key(F.col("u")).alias("k")).collect()]
    assert len(set(got[:5])) == 5 and got[4] == got[5] and got[6] == got[8] == got[9] != got[7]


def test_links_are_resolved(spark):
    base = "https://h.io/a/b?q#f"
    cases = {"http://x.y/": "http://x.y/", "//x.y/z": "https://x.y/z", "/r": "https://h.io/r", "c": "https://h.io/a/c", "?n=1": "https://h.io/a/b?n=1", "#t": base}
    rows = spark.createDataFrame([(t, base) for t in cases], "t string, b string")
    assert {r.t: r.x for r in rows.withColumn("x", op2_urls.resolved(F.col("t"), F.col("b"))).collect()} == cases
    assert spark.createDataFrame([("c", "https://h.io")], "t string, b string").select(op2_urls.resolved(F.col("t"), F.col("b"))).first()[0] == "https://h.io/c"


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def test_quality_measures(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a b c a b c", "é\x1cé\u2003é 日本", "x\n\nx\nx \r\nx", "one\x0btwo\x0cthree\rfour"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "#d ", "\t", "a b c "]) for _ in range(rng.randrange(90))) for _ in range(200)] + ["w " * 30_000, " ".join(f"w{k % 9000}" for k in range(20_000))]
    df = spark.createDataFrame([(k, t, None if k % 3 else "en", f"s{k % 2}", 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, words int, bucket int")
    got = {r.doc_id: r for r in op4_quality.judge(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert tuple(got[k])[1:7] == measured(t), t
        assert not (got[k].base_failed and got[k].kept)
    assert op4_quality.judge(df.limit(0)).count() == 0


def test_quality_thresholds_follow_their_source(spark):
    rng = random.Random(6)

    def text(mark, n=80):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) + mark for _ in range(n))

    rows = [(k, text("") if k % 2 else text("#"), "en", "plain" if k % 2 else "marked") for k in range(400)]
    rows += [(1000, text("#"), "en", "plain"), (1001, text("#"), "en", "marked"), (1002, text("###"), "en", "tiny"), (1003, text(""), None, None)]
    got = {r.doc_id: r.kept for r in op4_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(400)) and not got[1000] and got[1001] and got[1003]


def test_sketch_quantiles_are_accurate_and_merge(spark):
    rng = random.Random(7)
    rows = [(rng.randint(50, 900), rng.randint(200, 9000), rng.randrange(9), 10, 0, 0, "en", f"s{k % 3}") for k in range(3000)]
    df = spark.createDataFrame(rows, "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, lang string, source string")
    for by, keep in (([], lambda r: True), (["source"], lambda r: r[7] == "s1")):
        found = op4_quality.quantiles(op4_quality.sketches(df), by).where("signal = 'mean_word_chars'")
        found = (found.where("source = 's1'") if by else found).first()
        values = sorted(r[1] / r[0] for r in rows if keep(r))
        assert found.docs == len(values)
        for q, got in ((0.05, found.low), (0.5, found.middle), (0.95, found.high)):
            assert got == pytest.approx(values[math.ceil(q * len(values)) - 1], rel=0.011)


def test_quality_fences_move_with_their_group(spark):
    """No fixed cut-off gives these verdicts: what is odd in one source is usual in another, and when a source changes so do they."""
    rng = random.Random(16)

    def text(symbols, n=200):
        own = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(n)]
        for k in rng.sample(range(n), symbols):
            own[k] += "#"
        return " ".join(own)

    probes = [(9000, text(70), "en", "prose"), (9001, text(80), "en", "code"), (9002, text(3), "en", "prose"), (9003, text(199), "en", "prose")]
    for usual, want in ((0, {9000: False, 9001: True, 9002: True, 9003: False}), (80, {9000: True, 9001: True, 9002: True, 9003: False})):
        rows = [(k, text(usual if k % 2 else rng.randint(60, 100)), "en", "prose" if k % 2 else "code") for k in range(1600)]
        got = {r.doc_id: r.kept for r in op4_quality.judge(spark.createDataFrame(rows + probes, "doc_id long, text string, lang string, source string")).collect()}
        assert {k: got[k] for k in want} == want and sum(got.values()) >= 1600 - 8


def test_quality_fences_change_smoothly_with_a_group(spark):
    cells = [("en", "big", 5, 4000), ("en", "big", 60, 4000), ("xx", "s", 5, 500)]
    found = []
    for n in (99, 100, 101):
        rows = [(lang, source, "symbols_per_word", b, k) for lang, source, b, k in [*cells, ("en", "small", 90, n)]]
        fence = op4_quality.thresholds(spark.createDataFrame(rows, "lang string, source string, signal string, bucket int, n long")).where("source = '=small'").first()
        found.append(fence.high_symbols_per_word)
    assert max(found) / min(found) < 1.01


def fewest(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid, need, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                need, load = need + 1, 0
            load += s
        low, high = (low, mid) if need <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_minimax_capacity_is_exact(spark, monkeypatch, bits):
    monkeypatch.setattr(op1_sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(op1_sharding, "STEP_BITS", 5)
    monkeypatch.setattr(op1_sharding, "ROUND", 7)
    rng = random.Random(bits)
    for shards, n in ((3, 40), (16, 150), (5, 3)):
        keys = [rng.getrandbits(64) - 2**63 for _ in range(n)]
        sizes = {k: rng.choice([1, 5, rng.randint(1, 60), 900]) for k in keys}
        capacity, cuts = op1_sharding.minimax_cuts(spark.createDataFrame(list(sizes.items()), "key long, bytes long"), shards)
        assert capacity == fewest([sizes[k] for k in sorted(sizes)], shards)
        loads = Counter()
        for k, s in sizes.items():
            loads[sum(c is not None and c <= k for c in cuts)] += s
        assert max(loads.values()) <= capacity and len(cuts) == shards - 1


def test_shards(spark):
    texts = [None, None, "", "é", *(f"text {k}" * (k % 7) for k in range(200)), *["copy"] * 50]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in enumerate(texts)], "doc_id long, text string, size int, shard string")
    rows = op1_sharding.shard(df, 4).collect()
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for k, t in enumerate(texts)}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(4))
    assert len({r.shard for r in rows if r.doc_id >= 204}) == 1
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) < 300
    assert op1_sharding.shard(df.limit(0)).count() == 0
    again = {(r.doc_id, r.shard) for r in op1_sharding.shard(df.unionByName(df), 4).collect()}
    assert len(again) == len(texts)


def parse(text, sample):
    n, k = 0, 0
    while k < len(text):
        z = k + 1
        while z <= len(text) and text[k:z] in sample:
            z += 1
        k = max(z - 1, k + 1)
        n += 1
    return n


def test_cross_parsing_counts_equal_brute_force(monkeypatch):
    rng = random.Random(3)
    samples = [("a", bytes(rng.choice(b"abc ") for _ in range(300))), ("b", bytes(rng.choice(b"cde ") for _ in range(500)))]
    texts = [bytes(rng.choice(b"abcdexyz ") for _ in range(rng.randrange(200))) for _ in range(60)] + [b""]
    texts += [bytes(rng.choice(b"abcdexyz ") for _ in range(n)) for n in (2047, 2048, 2049, 9000, 20_000)] + [samples[1][1] * 20]
    want = [[parse(t, s) for _, s in samples] for t in texts]
    for lanes, few in ((4096, 64), (7, 3), (5000, 1), (4, 100)):
        monkeypatch.setattr(op3_language, "LANES", lanes)
        monkeypatch.setattr(op3_language, "FEW", few)
        assert op3_language.CrossParser(samples).phrases(texts).tolist() == want


def test_texts_in_no_learned_language():
    rng = random.Random(13)
    own = lambda vowels: " ".join("".join(rng.choice("bcdfgst") + rng.choice(vowels) for _ in range(rng.randint(1, 4))) for _ in range(3000))
    parser = op3_language.CrossParser([("a", op3_language.symbols(own("aei"))[:16_000]), ("b", op3_language.symbols(own("ou"))[:16_000])])
    texts = [own("aei"), own("ou")[:40], "Это не тот язык " * 5, "日本語の文章です", "qxzjk vwqzx " * 9, None, "12", "da ge"]
    lang, _, known = parser.predict(texts)
    assert known == [True, True, False, False, False, False, False, True] and lang[:2] == ["a", "b"] and lang[5:7] == ["und", "und"]


def test_language(spark):
    rng = random.Random(4)
    vocabulary = {"aa": ["the", "of", "and", "thing", "with"], "bb": ["der", "und", "nicht", "schön", "ein"], "cc": ["これ", "は", "です", "本"]}
    rows = []
    for k in range(300):
        lang = rng.choice(list(vocabulary))
        rows.append((k, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(5, 60))), lang if k % 10 else None, lang))
    rows += [(1000, None, "aa", "und"), (1001, "", "bb", "und"), (1002, "12 !? 3", "aa", "und"), (1003, "the and of " * 9000, None, "aa")]
    df = spark.createDataFrame([(a, b, c, "s", 5) for a, b, c, _ in rows], "doc_id long, text string, lang string, lang_pred string, score int")
    got = {r.doc_id: r for r in op3_language.identify(df).collect()}
    assert len(got) == len(rows)
    for k, _, _, want in rows:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and got[k].lang_pred == want and 0 <= got[k].score <= 1
    assert {r.lang_pred for r in op3_language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert op3_language.identify(df.limit(0)).count() == 0


def test_language_ignores_held_out_labels(spark):
    rows = [(k, "abc def " * 5, "held" if zlib.crc32(str(k).encode()) % 3 == 1 else "seen") for k in range(50)]
    assert {r.lang_pred for r in op3_language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"seen"}


def test_sample_is_bounded(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('word', translate(id, '0123456789', 'abcdefghij'), ' x'), 500) AS text", "'l' AS lang")
    own = op3_language.labelled_samples(df)
    assert [lang for lang, _ in own] == ["l"] and op3_language.SAMPLE_BYTES // 2 < len(own[0][1]) <= op3_language.SAMPLE_BYTES
