"""Ragged tables, files, molecules and space."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblake.exceptions import DataInvalid, ImproperlyConfigured
from ensemblake.functions import fret, geometry, linalg, metrics
from ensemblake.operators import fret as fr
from ensemblake.operators import pockets as pk
from ensemblake.operators import ragged as rg
from ensemblake.sources import tables


def table(spark, rows):
    return rg.Ragged(spark.createDataFrame([(t, f, v) for t, row in enumerate(rows) for f, v in enumerate(row)], "traj_id long, frame long, value int"))


def rows_of(r):
    out = {}
    for x in r.df.orderBy("traj_id", "frame").collect():
        out.setdefault(x.traj_id, []).append(x.value)
    return out


ROWS = [[1, 2, 3], [4, 5, 6, 7, 8], [9]]


def test_slices(spark):
    a = table(spark, ROWS)
    for s in (slice(None, -1), slice(-2, None), slice(1, 3), slice(None, None, 2), slice(-4, -1)):
        assert rows_of(a[:, s]) == {k: r[s] for k, r in enumerate(ROWS) if r[s]}
    assert rows_of(a[-1]) == {2: [9]} and rows_of(a[[0, 2], [0]]) == {0: [1], 2: [9]} and rows_of(a[1:, -1]) == {1: [8], 2: [9]}
    assert rows_of(a[:-1]) == {0: ROWS[0], 1: ROWS[1]}
    with pytest.raises(IndexError):
        a[-9]


def test_arithmetic_is_pythons(spark):
    a = table(spark, [[-7, 7, 0], [5]])
    flat = lambda r: [v for row in rows_of(r).values() for v in row]
    own = [-7, 7, 0, 5]
    assert flat(a // 3) == [v // 3 for v in own] and flat(a % 3) == [v % 3 for v in own] and flat(a % -3) == [v % -3 for v in own]
    assert flat(10 - a) == [10 - v for v in own] and flat(a**2) == [v**2 for v in own] and flat(~a) == [~v for v in own]
    assert flat(a / 0)[:2] == [float("-inf"), float("inf")] and np.isnan(flat(a / 0)[2])
    assert flat(a + a) == [2 * v for v in own] and flat((a > 0) | (a == 0)) == [v >= 0 for v in own] and flat((a > 0) ^ (a > 5)) == [(v > 0) ^ (v > 5) for v in own]


def test_shape_append_nested(spark):
    a = table(spark, ROWS)
    assert len(a) == 3 and a.max() == 9 and a.min() == 1 and a.all() and tuple(a.shape().first()) == (3, 9, None)
    both = a.append(table(spark, [[0]]))
    assert rows_of(both)[3] == [0] and not both.all() and both.any()
    assert rg.Ragged.from_nested(a.to_nested()).equal(a)
    flat = a.flatten().withColumnRenamed("flat", "flat")
    assert rows_of(rg.Ragged.from_flat(flat, [3, 5, 1])) == rows_of(a)
    with pytest.raises(DataInvalid):
        rg.Ragged.from_flat(flat, [3, 5])


def test_running_total_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(rg, "BLOCK", 4)
    df = spark.createDataFrame([(k * 3, k % 5) for k in range(50)], "k long, v long")
    got = [r.s for r in rg.running_total(df, "k", "v", "s").orderBy("k").collect()]
    assert got == np.concatenate(([0], np.cumsum([k % 5 for k in range(50)])[:-1])).tolist()


def test_partition_indices(spark):
    ids = spark.createDataFrame([(3,), (23,), (103,), (999,)], "flat long")
    assert sorted((r.flat, r.traj_id, r.frame) for r in rg.partition_indices(ids, [10, 20, 100]).collect()) == [(3, 0, 3), (23, 1, 13), (103, 2, 73)]
    assert rg.compute_batches([3, 3, 3, 9, 1], 7) == [[0, 1], [2], [3], [4]]


def test_files(spark, tmp_path):
    df = table(spark, ROWS).df
    tables.save(df, f"{tmp_path}/r")
    back = tables.load(f"{tmp_path}/r", keys=[1], stride=2, spark=spark)
    assert sorted(r.value for r in back.collect()) == [4, 6, 8]
    for k, n in enumerate((7, 3)):
        np.save(f"{tmp_path}/f{k}.npy", np.arange(n * 2).reshape(n, 2) + 100 * k)
    got = {(r.traj_id, r.frame): list(r.x) for r in tables.load_features(spark, f"{tmp_path}/*.npy", stride=2).collect()}
    assert got == {(0, f): [4.0 * f, 4 * f + 1] for f in range(4)} | {(1, f): [100 + 4.0 * f, 101 + 4 * f] for f in range(2)}


def test_saved_files_do_not_grow_with_trajectories(spark, tmp_path):
    own = spark.range(3000).selectExpr("id % 500 AS traj_id", "id div 500 AS frame", "id AS value")
    tables.save(own, f"{tmp_path}/r")
    assert len(list((tmp_path / "r").rglob("*.parquet"))) <= 4
    back = tables.load(f"{tmp_path}/r", spark=spark)
    assert back.dtypes == own.dtypes and back.exceptAll(own).isEmpty() and back.count() == 3000
    some = tables.load(f"{tmp_path}/r", keys=[3, 499, 1000], stride=2, spark=spark)
    assert sorted((r.traj_id, r.frame, r.value) for r in some.collect()) == [(t, f, f * 500 + t) for t in (3, 499) for f in (0, 2, 4)]
    one = tables.load(f"{tmp_path}/r", keys=[3], spark=spark)
    assert one.count() == 6 and "__part#" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]


def test_saved_keys_keep_their_type(spark, tmp_path):
    own = spark.createDataFrame([("007", 0, 1.0), ("7", 0, 2.0), (None, 0, 3.0)], "traj_id string, frame long, value double")
    tables.save(own, f"{tmp_path}/r")
    back = tables.load(f"{tmp_path}/r", spark=spark)
    assert back.dtypes == own.dtypes and back.exceptAll(own).isEmpty() and back.count() == 3
    assert [r.value for r in tables.load(f"{tmp_path}/r", keys=["007"], spark=spark).collect()] == [1.0]


PDB = """MODEL        1
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N
ATOM      2  CA  ALA A   1      11.639   6.071  -5.147  1.00  0.00           C
ATOM      3  CB  GLY A   2      10.000   0.000  -5.000  1.00  0.00           C
ENDMDL
MODEL        2
ATOM      1  N   ALA A   1       1.000   2.000   3.000  1.00  0.00           N
ENDMDL
"""


def test_pdb_and_selections(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    atoms = tables.load_pdb(spark, f"{tmp_path}/a.pdb").cache()
    assert [(r.frame, r.atom_id, r.name, r.res_seq, r.x) for r in atoms.orderBy("frame", "atom_id").collect()] == [(0, 0, "N", 1, 1.1104), (0, 1, "CA", 1, 1.1639), (0, 2, "CB", 2, 1.0), (1, 0, "N", 1, 0.1)]
    first = atoms.where("frame = 0")
    pick = lambda t: [r.atom_id for r in first.where(geometry.selection(t)).orderBy("atom_id").collect()]
    assert pick("name CA CB") == [1, 2] and pick("resSeq 1 to 1 and not name N") == [1] and pick("(element N or resname GLY) and all") == [0, 2]
    with pytest.raises(DataInvalid):
        geometry.selection("colour red")
    with pytest.raises(ImproperlyConfigured):
        tables.select_atoms(first, first, "name ZZ")
    tables.write_pdb(first.withColumn("structure", F.lit("s1")), f"{tmp_path}/out")
    again = tables.load_pdb(spark, f"{tmp_path}/out/structure=s1")
    assert again.select("atom_id", "name", "res_seq", "x").exceptAll(first.select("atom_id", "name", "res_seq", "x")).isEmpty()


def test_metrics(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 0.0, 3.0])], "a array<double>, b array<double>")
    one = lambda m: df.select(metrics.metric(m)(F.col("a"), F.col("b"))).first()[0]
    assert one("euclidean") == 13**0.5 and one("manhattan") == 5 and one("hamming") == 2 / 3 and one("chebyshev") == 3
    with pytest.raises(Exception, match="differ in size"):
        df.select(metrics.euclidean(F.col("a"), F.slice("b", 1, 2))).collect()


def test_superposition(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(12, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    moved, r = linalg.superpose(a @ q + 5, a)
    assert r < 1e-9 and np.allclose(moved, a)
    df = spark.createDataFrame([((a @ q).ravel().tolist(), a.ravel().tolist())], "x array<double>, y array<double>")
    assert df.select(geometry.rmsd(F.col("x"), F.col("y"))).first()[0] < 1e-9


def test_accessible_area():
    assert np.isclose(linalg.sasa(np.zeros((1, 3)), np.array([0.17]))[0], 4 * np.pi * 0.31**2)
    two = linalg.sasa(np.array([[0, 0, 0], [0.2, 0, 0.0]]), np.array([0.17, 0.17]), points=5000)
    assert np.allclose(two, 2 * np.pi * 0.31 * (0.31 + 0.1), rtol=0.01)


def test_pockets_of_a_box(spark):
    wall = [(x * 0.2, y * 0.2, z * 0.2) for x in range(6) for y in range(6) for z in range(6) if {x, y, z} & {0, 5}]
    atoms = spark.createDataFrame([(0, *p, 0.1) for p in wall], "frame int, x double, y double, z double, radius double")
    found = pk.pockets(atoms, 0.1, 0.05, 5, 2, 0.1).collect()
    assert found and {r.cluster for r in found} == {0} and all(0 < r.x < 10 and 0 < r.y < 10 and 0 < r.z < 10 for r in found)


def test_clashes(spark):
    rng = np.random.default_rng(5)
    pts, atm = rng.uniform(0, 2, (200, 3)), rng.uniform(0, 2, (60, 3))
    points = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(pts)], "frame int, id long, px double, py double, pz double")
    atoms = spark.createDataFrame([(0, *map(float, p), 0.15) for p in atm], "frame int, x double, y double, z double, radius double")
    d = np.sqrt(((pts[:, None] - atm[None]) ** 2).sum(axis=2)).min(axis=1)
    assert {r.id for r in fr.remove_clashes(points, atoms).collect()} == set(np.flatnonzero(d >= 0.32).tolist())


def test_transfer_probabilities(spark):
    df = spark.range(1).select(fret.transfer_probabilities(F.lit(0.2), F.lit(0.1), F.lit(0.5), 0.1).alias("a"), fret.transfer_probabilities(F.lit(0.2), F.lit(0.1), F.lit(1e9), 1.0).alias("b"))
    a, b = df.first()
    assert np.isclose(sum(a), 1) and np.isclose(sum(b), 1) and b.excited == 0 and np.isclose(a.radiative, 1 - np.exp(-0.02))


def test_bursts_are_repeatable(spark):
    t, pi = linalg.scatter(spark, np.array([[0.9, 0.1], [0.5, 0.5]])), linalg.scatter(spark, np.array([5 / 6, 1 / 6]))
    photons = spark.range(400).selectExpr("id % 20 AS burst_id", "id AS k", "(id DIV 20) * 30 AS frame")
    a = fr.sample_bursts(photons, t, pi, 2, 3)
    assert a.exceptAll(fr.sample_bursts(photons.repartition(7), t, pi, 2, 3)).isEmpty()
    assert abs(a.agg({"state": "avg"}).first()[0] - 1 / 6) < 0.08
