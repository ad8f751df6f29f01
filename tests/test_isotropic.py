"""Isotropic transfer efficiency over all pairs of states."""

import math
import time

import numpy as np

from ensemblake.operators import fret as fr

SCHEMA = "p double, origin array<double>, dipole array<double>"


def plain(donors, acceptors, j, qd, n=1.333):
    """Pair by pair; None takes no part in a sum."""
    top = all_ = 0.0
    for p, o, u in donors:
        for q, at, w in acceptors:
            if p is None or q is None:
                continue
            all_ += p * q
            if o is None or None in o or math.hypot(*u) == 0 or math.hypot(*w) == 0 or (r := math.dist(o, at)) == 0:
                continue
            d, a, b = (np.array(v) / np.linalg.norm(v) for v in (u, w, np.array(at) - o))
            r0 = 0.02108 * ((d @ a - 3 * (d @ b) * (a @ b)) ** 2 * qd * j / n**4) ** (1 / 6)
            top += p * q * r0**6 / (r0**6 + r**6)
    return top / all_


def states(rng, n, at=0.0):
    return [(float(rng.random()), (rng.normal(size=3) + [at, 0, 0]).tolist(), rng.normal(size=3).tolist()) for _ in range(n)]


def test_odd_states_weigh_but_do_not_transfer(spark, monkeypatch):
    monkeypatch.setattr(fr, "DONORS", 7)
    monkeypatch.setattr(fr, "ACCEPTORS", 5)
    monkeypatch.setattr(fr, "PAIRS", 100)
    rng = np.random.default_rng(4)
    d, a = states(rng, 40), states(rng, 30, 3.0)
    d += [(0.5, None, [1.0, 0.0, 0.0]), (0.3, [1.0, None, 0.0], [1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0], [1.0, 0.0, 0.0]), (0.7, [0.0, 1.0, 2.0], [0.0, 0.0, 0.0]), (0.7, *a[0][1:]), d[0], d[0]]
    a += [(0.9, [1.0, 0.0, 4.0], [0.0, 0.0, 0.0]), a[3]]
    got = fr.isotropic_efficiency(spark.createDataFrame(d, SCHEMA), spark.createDataFrame(a, SCHEMA), 2.4e15, 0.92).first().fe
    assert abs(got - plain(d, a, 2.4e15, 0.92)) < 1e-12
    same = [(1.0, [1.0, 2.0, 3.0], [1.0, 0.0, 0.0])]
    assert fr.isotropic_efficiency(spark.createDataFrame(same, SCHEMA), spark.createDataFrame(same, SCHEMA), 2.4e15, 0.92).first().fe is None
    assert fr.isotropic_efficiency(spark.createDataFrame([], SCHEMA), spark.createDataFrame(a, SCHEMA), 2.4e15, 0.92).first().fe is None


def test_many_pairs_are_spread_and_in_time(spark):
    """The product of 12,000 states by 12,000 took minutes in one task a part of the donors."""
    rng = np.random.default_rng(5)
    d, a = states(rng, 12_000), states(rng, 12_000, 5.0)
    at = time.time()
    got = fr.isotropic_efficiency(spark.createDataFrame(d, SCHEMA), spark.createDataFrame(a, SCHEMA), 2.4e15, 0.92).first().fe
    assert time.time() - at < 60
    top, (q, o2, w) = 0.0, (np.array(x) for x in zip(*a, strict=True))
    w /= np.linalg.norm(w, axis=1)[:, None]
    for p, o, u in d:
        b = o2 - o
        r = np.sqrt((b * b).sum(axis=1))
        u = np.array(u) / np.linalg.norm(u)
        r06 = 0.02108**6 * (w @ u - 3 * (b @ u) * (b * w).sum(axis=1) / r**2) ** 2 * 0.92 * 2.4e15 / 1.333**4
        top += p * float(q @ (r06 / (r06 + r**6)))
    assert abs(got - top / (sum(p for p, *_ in d) * q.sum())) < 1e-9
