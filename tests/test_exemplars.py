"""Exemplars on pair tables, against the dense kernel and by brute force."""

import itertools

import numpy as np
import pytest

from ensemblake.exceptions import ConvergenceWarning
from ensemblake.functions import linalg
from ensemblake.operators import exemplars, info


def table(spark, s, ids=None, absent=()):
    n = len(s)
    ids = ids or list(range(n))
    rows = [(ids[a], ids[b], float(s[a][b])) for a in range(n) for b in range(n) if (a, b) not in absent]
    return spark.createDataFrame(rows, "i long, k long, s double")


def groups(rng, sizes=(6, 5, 7)):
    at = np.concatenate([rng.normal(size=(n, 2)) * 0.3 + c for n, c in zip(sizes, ([0, 0], [4, 1], [1, 5]))])
    return -((at[:, None] - at[None]) ** 2).sum(axis=2)


@pytest.mark.parametrize("damping", [0.5, 0.9])
def test_equal_to_the_dense_kernel(spark, damping):
    s = groups(np.random.default_rng(1))
    labels = linalg.affinity_propagation(s, damping, -4.0)
    got = dict(exemplars.affinity_propagation(table(spark, s), damping, -4.0).collect())
    leaders = sorted(set(got.values()))
    assert len(leaders) == 3 and [leaders.index(got[k]) for k in range(len(s))] == labels.tolist()
    assert all(got[k] == k for k in leaders)


def test_best_set_by_brute_force(spark):
    s = groups(np.random.default_rng(2), (3, 4, 3))
    off = s[~np.eye(10, dtype=bool)]
    own = np.where(np.eye(10, dtype=bool), np.median(off), s)

    def total(leaders):
        return sum(own[i, i] if i in leaders else max(own[i, k] for k in leaders) for i in range(10))

    best = max((c for n in range(1, 11) for c in itertools.combinations(range(10), n)), key=total)
    got = dict(exemplars.affinity_propagation(table(spark, s), 0.8).collect())
    assert sorted(set(got.values())) == list(best)


def test_rounds_as_jobs_agree(spark):
    s = groups(np.random.default_rng(3), (4, 3, 4))
    far = {(a, b) for a in range(11) for b in range(11) if s[a][b] < -9}  # groups that don't know of each other
    pairs = table(spark, s, [7 * k + 100 for k in range(11)], far)
    one = dict(exemplars.affinity_propagation(pairs, 0.5, -4.0).collect())
    assert one == dict(exemplars.affinity_propagation(pairs, 0.5, -4.0, few=0).collect())
    assert len(set(one.values())) == 3


def test_nodes_without_neighbours_and_empty_tables(spark):
    s = groups(np.random.default_rng(4), (4, 4, 4))
    lone = spark.createDataFrame([(90, 90, 1.0), (91, None, 1.0), (None, 91, 1.0), (92, 0, float("nan")), (0, 1, -99.0)], "i long, k long, s double")
    pairs = table(spark, s).union(lone)
    got = dict(exemplars.affinity_propagation(pairs, 0.6, -4.0).collect())
    assert got.pop(90) == 90 and got == dict(exemplars.affinity_propagation(table(spark, s), 0.6, -4.0).collect())
    assert exemplars.affinity_propagation(pairs.limit(0)).isEmpty()


def test_a_warning_where_exemplars_still_change(spark):
    with pytest.warns(ConvergenceWarning):
        exemplars.affinity_propagation(table(spark, groups(np.random.default_rng(5))), 0.5, -4.0, most=3)


def test_exposons_are_numbered_by_their_exemplars(spark):
    s = np.kron(np.eye(3), np.full((4, 4), 0.8)) + 0.01 + np.random.default_rng(6).uniform(0, 0.05, (12, 12))
    mi = table(spark, (s + s.T) / 2).toDF("fa", "fb", "mi")
    labels = dict(info.exposon_labels(mi, 0.9).collect())
    assert [labels[k] for k in range(12)] == [0] * 4 + [1] * 4 + [2] * 4
