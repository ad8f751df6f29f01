"""Operators on edge tables: equal to brute force on small graphs whichever way they take, and done with graphs that no dense array holds."""

import time
import warnings

import numpy as np
import pyarrow as pa
import pytest

from ensemblake.exceptions import ConvergenceWarning
from ensemblake.functions import linalg
from ensemblake.operators import msm, sparse, tpt


def table(spark, rows):
    i, j, v = (np.asarray(x) for x in zip(*rows)) if not isinstance(rows, tuple) else rows
    return spark.createDataFrame(pa.table({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": v.astype(float)}))


def parts_of(n, edges):
    reach = np.eye(n, dtype=bool)
    for a, b in edges:
        reach[a, b] = True
    for k in range(n):
        reach |= reach[:, k : k + 1] & reach[k]
    return {k: int(np.flatnonzero(reach[k] & reach[:, k])[0]) for k in range(n)}


@pytest.mark.parametrize("few", [0, 6, 10**6])
def test_strong_components_of_random_graphs(spark, few):
    rng = np.random.default_rng(1)
    graphs = [[(int(a), int(b)) for a, b in rng.integers(0, 14, (m, 2))] for m in (10, 18, 26)] if few else [[(int(a), int(b)) for a, b in rng.integers(0, 14, (18, 2))]]
    graphs.append([*((k, k + 1) for k in range(9)), (4, 0), (9, 6), (7, 7), (2, 2), *((k, k - 1) for k in range(12, 14))])
    for edges in graphs:
        got = {r.state: r.component for r in sparse.strong_components(table(spark, [(a, b, 1) for a, b in edges]), few).collect()}
        want = parts_of(14, edges)
        assert {k: got.get(k, k) for k in range(14)} == want
        assert all(sum(c == x for x in want.values()) > 1 for c in got.values())


def test_colours_alone(spark):
    """What is left where nothing else helps: every state has several edges in and out, none both ways."""
    edges = [(a, (a + d) % 9, 1) for a in range(9) for d in (1, 2)] + [(a + 20, (a + d) % 7 + 20, 1) for a in range(7) for d in (1, 3)] + [(0, 20, 1), (3, 25, 1)]
    got = {r.state: r.component for r in sparse.strong_components(table(spark, edges), 0).collect()}
    assert got == {k: 0 for k in range(9)} | {k + 20: 20 for k in range(7)}


def test_a_long_chain_with_cycles(spark):
    """200,000 states in a line, of which stretches of 10 lead back; a random walk along it would take as many rounds as it is long."""
    n = 200_000
    at = np.arange(n)
    back = at[9::10][at[9::10] % 1000 < 500]
    df = table(spark, (np.concatenate((at[:-1], back)), np.concatenate((at[1:], back - 9)), np.ones(n - 1 + len(back))))
    start = time.time()
    got = sparse.strong_components(df, 20_000).toPandas()
    assert len(got) == 10 * len(back) and (got.component == got.state // 10 * 10).all()
    assert time.time() - start < 240


def walk(n, rng, width=3):
    """Counts of a walk on a ring with shortcuts: strongly connected, sparse."""
    i = np.repeat(np.arange(n), width)
    j = np.concatenate([(np.arange(n)[:, None] + 1), rng.integers(0, n, (n, width - 1))], axis=1).ravel() % n
    return i, j, rng.integers(1, 20, len(i)).astype(float)


def dense_of(rows, n):
    c = np.zeros((n, n))
    np.add.at(c, rows[:2], rows[2])
    return c


@pytest.mark.parametrize(("n", "few"), [(3, 0), (3, sparse.FEW), (40, sparse.FEW), (2000, sparse.FEW)])
def test_leading_spectrum_is_that_of_the_dense_matrix(spark, n, few):
    rng = np.random.default_rng(n)
    c = dense_of(walk(n, rng), n)
    c = c + c.T
    t = c / c.sum(axis=1, keepdims=True)
    i, j = np.nonzero(t)
    df = table(spark, (i, j, t[i, j]))
    k = min(n, 4)
    want = np.sort(np.linalg.eigvals(t).real)[::-1][:k]
    for left in (True, False):
        values, vectors = sparse.leading_spectrum(df, k, left, n, few=few)
        assert np.allclose(values, want, atol=1e-8)
        v = np.zeros((n, k))
        for r in vectors.collect():
            v[r.i, r.k] = r.v
        a = t.T if left else t
        assert np.abs(a @ v - v * values).max() < 1e-7 and np.isclose(v[:, 0].sum(), 1)
    pi = c.sum(axis=1) / c.sum()
    assert np.allclose(sparse.leading_spectrum(df, 1, True, n, few=few)[1].toPandas().sort_values("i").v, pi, atol=1e-8)


def test_spectrum_with_restarts_in_rows(spark):
    """Five basins of 12 states that hardly mix: restarts over rows give what the dense matrix gives."""
    rng = np.random.default_rng(3)
    c = np.kron(np.eye(5), np.ones((12, 12))) * rng.random((60, 60)) + 0.002 * rng.random((60, 60)) * (rng.random((60, 60)) < 0.2)
    t = (c + c.T) / (c + c.T).sum(axis=1, keepdims=True)
    i, j = np.nonzero(t)
    want = np.sort(np.linalg.eigvals(t).real)[::-1]
    values, _ = sparse.leading_spectrum(table(spark, (i, j, t[i, j])), 5, n_states=60, few=0)
    assert np.allclose(values, want[:5], atol=1e-8)
    with pytest.warns(ConvergenceWarning):
        sparse.leading_spectrum(table(spark, (i, j, t[i, j])), 3, n_states=60, tol=1e-15, most=1, few=0)


def test_complex_pairs_and_a_large_model(spark):
    rng = np.random.default_rng(4)
    c = rng.random((30, 30)) * (rng.random((30, 30)) < 0.4) + np.roll(np.eye(30), 1, axis=1)
    t = c / c.sum(axis=1, keepdims=True)
    i, j = np.nonzero(t)
    values, _ = sparse.leading_spectrum(table(spark, (i, j, t[i, j])), 6, n_states=30)
    assert np.allclose(values, np.sort(np.linalg.eigvals(t).real)[::-1][:6], atol=1e-7)
    n = 100_000
    i, j, v = walk(n, rng)
    i, j, v = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((v, v))
    row = np.bincount(i, v, n)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", ConvergenceWarning)
        values, vectors = sparse.leading_spectrum(table(spark, (i, j, v / row[i])), 1, n_states=n, tol=1e-3, most=2)
    own = vectors.toPandas().sort_values("i").v.to_numpy()
    assert np.isclose(values[0], 1, atol=1e-4) and np.abs(own - row / row.sum()).sum() < 1e-2


def test_reversible_model_of_edges(spark):
    rng = np.random.default_rng(5)
    c = np.where(rng.random((8, 8)) < 0.5, rng.integers(1, 30, (8, 8)), 0).astype(float) + np.roll(np.eye(8), 1, axis=1)
    c[6], c[:, 6] = 0, 0
    t, pi = linalg.reversible_mle(c)
    i, j = np.nonzero(c)
    for few, tol, close in ((10**6, 1e-13, 1e-8), (0, 1e-4, 1e-3)):
        got, p = sparse.reversible_mle(table(spark, (i, j, c[i, j])), 8, tol, few=few)
        assert np.allclose(linalg.gather(got, 8), t, atol=close) and np.allclose(linalg.gather_vector(p, 8), pi, atol=close)
    for few in (10**6, 0):
        with pytest.warns(ConvergenceWarning):
            sparse.reversible_mle(table(spark, (i, j, c[i, j])), 8, most=2, few=few)


def test_reversible_model_of_100000_states(spark):
    n = 100_000
    i, j, v = walk(n, np.random.default_rng(6), 2)
    with pytest.warns(ConvergenceWarning):  # eight rounds won't do, but detailed balance holds after each
        t, pi = sparse.reversible_mle(table(spark, (i, j, v)), n, most=8, few=10_000)
    t, p = t.toPandas(), pi.toPandas().sort_values("i").v.to_numpy()
    assert np.isclose(p.sum(), 1) and (p > 0).all()
    flow = {(a, b): x for a, b, x in zip(t.i, t.j, p[t.i] * t.v)}
    assert max(abs(x - flow[b, a]) / x for (a, b), x in list(flow.items())[::50]) < 1e-9


def test_widest_paths_either_way(spark):
    rng = np.random.default_rng(7)
    for k in range(3):
        flux = np.triu(np.where(rng.random((8, 8)) < 0.6, rng.integers(1, 5, (8, 8)), 0), 1).astype(float)
        i, j = np.nonzero(flux)
        df = table(spark, (i, j, flux[i, j]))
        want = sparse.top_paths(df, [0, 1], [6, 7], num_paths=3)
        assert sparse.top_paths(df, [0, 1], [6, 7], num_paths=3, few=0) == want and want
    assert sparse.widest_path(df, [7], [0], 0) == sparse.widest_path(df, [7], [0]) == ([], 0.0)


def test_widest_path_among_100000_states(spark):
    n, rng = 100_000, np.random.default_rng(8)
    i, j, v = walk(n, rng, 4)
    v = rng.integers(1, 7, len(v)).astype(float)
    path, width = sparse.widest_path(table(spark, (i, j, v)), [0, 1], [n - 1], few=10_000)
    assert (path, width) == sparse._widest(i, j, v, [0, 1], [n - 1]) and width > 1 and len(path) > 5
    edge = {}
    for a, b, w in zip(i.tolist(), j.tolist(), v.tolist()):
        edge[a, b] = max(w, edge.get((a, b), 0))
    assert min(edge[e] for e in zip(path, path[1:])) == width


def test_models_go_through_edges(spark, monkeypatch):
    """Trimming, maximum likelihood, timescales and paths never gather a matrix."""

    def no(*a, **k):
        raise AssertionError("gathered")

    monkeypatch.setattr(linalg, "gather", no)
    rng = np.random.default_rng(9)
    states = spark.createDataFrame([(t, f, int(s)) for t in range(20) for f, s in enumerate(rng.integers(0, 6, 60))], "traj_id long, frame long, state int")
    for method in ("normalize", "transpose", "mle"):
        out = msm.implied_timescales(states, [1, 2], method, 2, trim=True).collect()
        assert len(out) == 4
    flux = table(spark, [(0, 1, 2.0), (1, 2, 1.0), (0, 2, 0.5)])
    assert tpt.top_path([0], [2], flux) == ([0, 1, 2], 1.0)
    assert [r.state for r in tpt.paths([0], [2], flux).orderBy("path_rank", "step").collect()] == [0, 1, 2, 0, 2]
