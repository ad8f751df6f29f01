"""Exact top-k equals scores of all pairs, with copies, ties, repeated ids, odd vectors and large numbers."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from ensemblake.llm import op12_top_k as search

SCHEMA = "vec_id long, embedding array<double>, score int, rank string"


def all_pairs(rows, k=5, every=50):
    known = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            known.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for a, (i, v) in enumerate(known):
        if i % every == 0:
            scored = sorted((-min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(v, w, strict=True)))), j) for b, (j, w) in enumerate(known) if b != a and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def answers(df, **how):
    return sorted(tuple(r) for r in search.top_k(df, F.col("vec_id") % 50 == 0, **how).select("query_id", "rank", "vec_id", "score").collect())


def test_equal_to_all_pairs(spark):
    rng = random.Random(2)
    hot = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(None, hot, 1, "x"), (50, None, 1, None), (100, [None] + hot[1:], 1, None), (150, [math.nan] * 8, 1, None), (200, [math.inf] * 8, 1, None), (250, [1e306] * 8, 1, None)]
    rows += [(300, [], 1, None), (301, [], 1, None), (350, [1.0, 2.0], 1, None), (351, [0.5, -1.0], 1, None), (400, [3.0], 1, None)]
    rows += [(k, hot if k % 3 == 0 else [rng.gauss(0, 1) for _ in range(8)], 1, None) for k in range(1000, 1600)]
    rows += [(-50, [-x for x in hot], 1, None)] + [(1050, hot, 1, None)] * 3 + [(1050, [0.1] * 8, 1, None), (1100, [0.0] * 8, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = all_pairs(rows)
    assert answers(df) == want
    assert answers(df, cells=700) == want
    assert answers(df, cells=8 * 9) == want


def test_scores_beyond_exact_arithmetic(spark):
    rng = random.Random(9)
    rows = [(k, [float(2 ** rng.randint(20, 40) + rng.randrange(9)) * rng.choice((1, -1)) for _ in range(3)], 1, None) for k in range(120)]
    assert answers(spark.createDataFrame(rows, SCHEMA), cells=60) == all_pairs(rows)


def test_none_asked_and_empty_tables(spark):
    assert answers(spark.createDataFrame([], SCHEMA)) == []
    assert answers(spark.createDataFrame([(1, [1.0], 1, None), (2, [1.0], 1, None)], SCHEMA)) == []
    assert answers(spark.createDataFrame([(50, [1.0], 1, None)], SCHEMA)) == []


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16)) * 400
    rows = np.floor(centres[rng.integers(30, size=6000)] + rng.normal(size=(6000, 16)) * 20)
    tree = search.BallTree(np.arange(6000), rows, leaf=64)
    queries = rows[:200]
    bounds = tree.bounds(queries)
    for node, (a, z) in enumerate(tree.spans):
        assert (bounds[:, node] >= (queries @ tree.rows[a:z].T).max(axis=1)).all()
    tree.looked = 0
    hits = [tree.search(q, b, 5) for q, b in zip(queries, bounds, strict=True)]
    scores = queries @ rows.T
    assert all([s for s, _ in h] == sorted(x.tolist(), reverse=True)[:5] for h, x in zip(hits, scores, strict=True))
    assert tree.looked < 0.25 * scores.size
    seen = tree.looked
    for q, b, h in zip(queries, bounds, hits, strict=True):
        assert tree.search(q, b, 5, h[-1]) == h[:4]
    assert tree.looked - seen <= seen
