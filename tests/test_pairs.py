"""Pairs of features are counted in matrices that don't grow with the frames."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ensemblake.functions import pairs
from ensemblake.operators import info

SCHEMA = "traj_id long, frame long, feature string, state int, w double"


def plain(x, y=None, weighted=False):
    out, frames = defaultdict(float), defaultdict(list)
    for t, f, feature, state, w in y or x:
        frames[t, f].append((feature, state))
    for t, f, feature, state, w in x:
        for other, v in frames.get((t, f), []):
            if y or feature <= other:
                out[feature, other, state, v] += w if weighted else 1
                if not y and feature < other:
                    out[other, feature, v, state] += w if weighted else 1
    return {k: round(v, 9) for k, v in out.items()}


def table(rng, frames, features, states):
    rows = []
    for k in range(frames):
        for f in range(features):
            if rng.random() < 0.9:
                rows.append((k % 3, k, f"f{f}", None if rng.random() < 0.05 else int(rng.integers(states)), float(rng.random())))
    return rows + rows[:5]


@pytest.mark.parametrize(("kept", "block", "wide"), [(1 << 25, 2048, 64), (30, 4, 64), (30, 4, 0), (1 << 25, 2048, 0)])
def test_equal_to_pairs_one_by_one(kept, block, wide, monkeypatch):
    monkeypatch.setattr(pairs, "KEPT", kept)
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "WIDE", wide)
    monkeypatch.setattr(pairs, "TOGETHER", 40)
    rng = np.random.default_rng(4)
    x, y = table(rng, 25, 6, 4), table(rng, 20, 3, 5)
    cell = pa.list_(pa.struct([("feature", pa.string()), ("state", pa.int32()), ("w", pa.float64())]))

    def lists(rows, frames):
        own = defaultdict(list)
        for t, f, feature, state, w in rows:
            own[t, f].append({"feature": feature, "state": state, "w": w})
        return [own[k] for k in frames]

    every = sorted({r[:2] for r in x})
    both = sorted({r[:2] for r in x} & {r[:2] for r in y})
    for weighted in (False, True):
        for other in (None, y):
            cols = [pa.array(lists(x, both if other else every), cell)] + ([pa.array(lists(y, both), cell)] if other else [])
            batch = pa.RecordBatch.from_arrays(cols, names=["a", "b"][: len(cols)])
            got = defaultdict(float)
            for b in pairs.pair_counts(weighted)([batch.slice(0, 9), batch.slice(9)]):
                for r in b.to_pylist():
                    if other or r["fa"] <= r["fb"]:
                        got[r["fa"], r["fb"], r["u"], r["v"]] += r["n"]
            want = {k: v for k, v in plain(x, other, weighted).items() if other or k[0] <= k[1]}
            assert {k: round(v, 9) for k, v in got.items()} == want


def test_joint_counts_in_spark(spark):
    rng = np.random.default_rng(5)
    x, y = table(rng, 60, 5, 3), table(rng, 50, 2, 4)
    a, b = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (x, y))
    for weighted in (False, True):
        for df, other, want in ((a, None, plain(x, None, weighted)), (a, b, plain(x, y, weighted))):
            got = {(r.fa, r.fb, r.u, r.v): round(r.n, 9) for r in info.joint_counts(df, other, weight="w" if weighted else None).collect()}
            assert got == want
    assert info.joint_counts(a.limit(0)).collect() == []


def test_sums_do_not_grow_with_frames():
    rng = np.random.default_rng(6)
    cell = pa.list_(pa.struct([("feature", pa.int32()), ("state", pa.int32())]))
    sizes = []
    for frames in (2000, 8000):
        states = rng.integers(0, 3, (frames, 100))
        flat = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(100), frames), pa.int32()), pa.array(states.ravel(), pa.int32())], names=["feature", "state"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(frames + 1) * 100, pa.int32()), flat)
        out = list(pairs.pair_counts(False)(pa.RecordBatch.from_arrays([lists.slice(k, 1000)], names=["a"]) for k in range(0, frames, 1000)))
        sizes.append(sum(b.num_rows for b in out))
        assert sum(b.column("n").to_numpy().sum() for b in out) == frames * 100 * 100
    assert sizes[0] == sizes[1] <= 300 * 300
