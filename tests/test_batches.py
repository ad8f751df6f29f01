"""Kernels that take a batch of rows at once, against one row at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblake.functions import geometry, linalg
from ensemblake.operators import fret


def kabsch(x, y):
    """Least RMSD by the textbook: singular values of the covariance, the last one negative for a mirror image."""
    a, b = x - x.mean(axis=0), y - y.mean(axis=0)
    h = a.T @ b
    s = np.linalg.svd(h, compute_uv=False)
    s[2] *= np.sign(np.linalg.det(h)) or 1
    return np.sqrt(max((a**2).sum() + (b**2).sum() - 2 * s.sum(), 0) / len(a))


def test_superposition_of_a_batch():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 9, 3)), rng.normal(size=(40, 9, 3))
    y[:10] = x[:10] * [1, 1, -1]  # mirror images, which no turn brings back
    y[10:20, :, 2] = x[10:20, :, 2] = 0  # flat ones
    placed, least = linalg.superpose_many(x, y)
    assert np.allclose(least, [kabsch(a, b) for a, b in zip(x, y)], atol=1e-9)
    assert np.allclose(np.sqrt(((placed - y) ** 2).sum(axis=(1, 2)) / 9), least)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    assert linalg.superpose_many(x @ turn + 5, x)[1].max() < 1e-9
    assert np.allclose(linalg.superpose_many(x, y[:1])[1], [kabsch(a, y[0]) for a in x])
    x[4, 2, 1] = np.nan
    again = linalg.superpose_many(x, y)[1]
    assert np.isnan(again[4]) and np.allclose(np.delete(again, 4), np.delete(least, 4))


def test_structures_of_any_size_and_nulls(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=3 * n).tolist(), rng.normal(size=3 * n).tolist()) for k, n in enumerate([5, 7, 5, 1, 7, 5])]
    df = spark.createDataFrame([*rows, (6, None, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0], None), (8, [], [])], "k int, x array<double>, y array<double>").coalesce(1)
    got = dict(df.select("k", geometry.rmsd(F.col("x"), F.col("y"))).collect())
    for k, x, y in rows:
        assert got[k] == pytest.approx(kabsch(np.reshape(x, (-1, 3)), np.reshape(y, (-1, 3))), abs=1e-9)
    assert got[6] is None and got[7] is None and np.isnan(got[8])
    moved = geometry.superposed(df.where("k IN (0, 2, 6)").select("k", F.col("x").alias("xyz")), rows[5][1])
    out = dict(moved.collect())
    assert out[6] is None
    for k in (0, 2):
        assert np.allclose(np.reshape(out[k], (-1, 3)), linalg.superpose(np.reshape(rows[k][1], (-1, 3)), np.reshape(rows[5][1], (-1, 3)))[0])


def test_areas_of_a_batch(monkeypatch):
    rng = np.random.default_rng(5)
    xyz, radii = rng.uniform(0, 1, (6, 30, 3)), rng.uniform(0.1, 0.2, 30)

    def plain(xyz, points=240):
        r = radii + 0.14
        spots = linalg.sphere(points)
        out = []
        for k in range(len(xyz)):
            at = xyz[k] + r[k] * spots
            free = [all(np.sum((p - xyz[j]) ** 2) >= r[j] ** 2 for j in range(len(xyz)) if j != k) for p in at]
            out.append(4 * np.pi * r[k] ** 2 * np.mean(free))
        return out

    wanted = [plain(x) for x in xyz]
    assert np.allclose(linalg.sasa_many(xyz, radii, points=240), wanted)
    monkeypatch.setattr(linalg, "TILE", 7_000)  # parts of a structure, and of an atom's neighbours
    assert np.allclose(linalg.sasa_many(xyz, radii, points=240), wanted)
    assert np.allclose(linalg.sasa(xyz[0], radii, points=240), wanted[0])


def test_distances_of_blocks(spark):
    rng = np.random.default_rng(6)
    clouds = [[(f, *p) for f in (0, 1) for p in rng.normal(size=(n, 3)).tolist()] for n in (90, 70)]
    clouds[0] += [clouds[0][0]] * 40  # one point, many times
    schema = "frame int, px double, py double, pz double"
    gone = [(0, None, 1.0, 2.0), (1, float("nan"), 1.0, 2.0), (2, 1.0, 1.0, 1.0)]
    a, b = spark.createDataFrame([*clouds[0], *gone], schema), spark.createDataFrame(clouds[1], schema)
    for side in (16, 1024):
        got = {(r.frame, r.bin): r.n for r in fret.distance_histogram(a, b, 0.25, side=side).collect()}
        for f in (0, 1):
            x, y = (np.array([p[1:] for p in c if p[0] == f]) for c in clouds)
            d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
            wanted = np.bincount(np.floor(d / 0.25).astype(int).ravel())
            assert [got[f, k] for k in range(len(wanted))] == wanted.tolist() and got[f, len(wanted)] == 0
        assert {f for f, _ in got} == {0, 1}
    assert fret.distance_histogram(a.limit(0), b).isEmpty()
