"""Merging states with kept pair losses: the mergers of a search through all pairs each time, and a thousand states in seconds."""

import time

import numpy as np

from ensemblake.operators import msm


def searched(counts, n_macrostates):
    """Every pair's loss anew at each merger."""
    c, label, kept = msm.bayesian_prune(counts)
    alive, n, factors, labels = kept.tolist(), len(c), {}, {}
    c[np.ix_(alive, alive)] += 1.0 / n

    def loss(x, y):
        a, b = c[x, alive], c[y, alive]
        shared = (a + b) / (a.sum() + b.sum())
        return float((a * np.log(a / a.sum() / shared)).sum() + (b * np.log(b / b.sum() / shared)).sum())

    while len(alive) > n_macrostates:
        pairs = [(loss(x, y), x, y) for k, x in enumerate(alive) for y in alive[k + 1 :] if max(c[x, y], c[y, x]) > 1]
        if not pairs:
            break
        factors[len(alive) - 1], x, y = min(pairs)
        c[x] += c[y]
        c[:, x] += c[:, y]
        c[y], c[:, y] = 0, 0
        gone, to = label[y], label[x]
        label = np.where(label == gone, to, label)
        label = np.where(label > gone, label - 1, label)
        alive.remove(y)
        labels[len(alive)] = label.copy()
    return factors, labels


def basins(n, rng, per=10):
    c = rng.integers(0, 2, (n, n)) * (rng.random((n, n)) < 5 / n)
    for a in range(0, n, per):
        z = min(n, a + per)
        c[a:z, a:z] += rng.integers(0, 60, (z - a, z - a))
    return (c + np.diag(rng.integers(50, 500, n))).astype(float)


def test_equal_to_a_search_through_all_pairs():
    rng = np.random.default_rng(1)
    cases = [basins(n, rng) for n in (15, 30, 45)]
    cases.append(np.kron(np.eye(3), np.full((3, 3), 40.0)) + 2 + 200 * np.eye(9))  # ties everywhere
    for c in cases:
        factors, labels = msm.bace(c, 2)
        want, levels = searched(c, 2)
        assert factors.keys() == want.keys() and all(abs(factors[k] - want[k]) < 1e-8 for k in want)
        assert all((labels[k] == levels[k]).all() for k in levels) and len(levels) > 2


def test_a_thousand_states():
    start = time.time()
    factors, labels = msm.bace(basins(1000, np.random.default_rng(2)), 100)
    assert time.time() - start < 60 and len(factors) > 500
    level = labels[min(labels)]
    assert len(level) == 1000 and level.max() + 1 == min(labels)
