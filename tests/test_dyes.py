"""Explicit dyes: placement, dipoles, lifetimes and bursts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblake.exceptions import DataInvalid
from ensemblake.functions import linalg
from ensemblake.operators import dyes

NAMES = ["N", "CA", "C", "O", "C6", "M1", "M2"]
KIND = dyes.Dye(("name M1", "name M2"), "name M1")


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(7)
    local = np.array([[0, 0.146, 0], [0, 0, 0], [0.152, 0, 0], [0.2, -0.1, 0.05], [-0.05, -0.05, 0.14]])
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    protein = []
    for f in range(4):
        for seq, shift in ((1, 0.0), (2, 4.0)):
            xyz = local @ q + np.array([f * 0.1 + shift, 0, 0])
            protein += [(f, 10 * seq + k, n, "ALA", seq, *map(float, xyz[k]), 0.15) for k, n in enumerate(["N", "CA", "C", "O", "CB"])]
    atoms = spark.createDataFrame(protein, "frame int, atom_id long, name string, res_name string, res_seq int, x double, y double, z double, radius double")
    conformers = []
    for c in range(3):
        arm = np.vstack([local, rng.uniform(0.4, 0.9, (2, 3))])
        conformers += [(c, k, n, *map(float, arm[k] + 3)) for k, n in enumerate(NAMES)]
    dye = spark.createDataFrame(conformers, "conformer int, atom_id long, name string, x double, y double, z double")
    return atoms, dye, q, local


def test_placed_on_the_backbone(world):
    atoms, dye, *_ = world
    placed = dyes.place_dye(dye, atoms, 1, "C6")
    both = placed.where("name = 'CA'").join(atoms.where("name = 'CA' AND res_seq = 1"), "frame")
    assert both.count() == 12 and both.agg(F.max(F.abs(F.col("px") - F.col("x")))).first()[0] < 1e-6
    with pytest.raises(Exception, match="missing"):
        dyes.place_dye(dye, atoms, 1, "ZZ").count()


def test_dipoles_and_clashes(world):
    atoms, dye, *_ = world
    free = dyes.map_dye(dye, atoms, 1, KIND, "C6", atom_tol=6)
    assert free.count() == 12 and set(free.columns) == {"frame", "conformer", "centre", "origin", "dipole"}


def test_lifetimes_and_bursts(spark, world):
    atoms, dye, *_ = world
    donor, acceptor = (dyes.map_dye(dye, atoms, s, KIND, "C6").cache() for s in (1, 2))
    c = np.full((3, 3), 5.0) + 20 * np.eye(3)
    ask = dict(d_counts=c, a_counts=c, j=2.4e15, qd=0.9, td=4.0, dt=0.05, n_samples=150, seed=1)
    found = {k: dyes.lifetimes(donor, acceptor, treatment=k, **ask).cache() for k in ("monte-carlo", "static", "isotropic")}
    share = {}
    for k, events in found.items():
        assert events.groupBy("state").count().where("count <> 150").isEmpty() and events.select("state").distinct().count() == 4
        share[k] = events.agg(F.avg((F.col("outcome") == "energy_transfer").cast("double"))).first()[0]
        assert events.exceptAll(dyes.lifetimes(donor.repartition(5), acceptor, treatment=k, **ask)).isEmpty()
    assert abs(share["static"] - share["isotropic"]) < 0.1 and abs(share["monte-carlo"] - share["static"]) < 0.25
    counts = linalg.scatter(spark, np.full((5, 5), 3.0))
    _, t, _ = dyes.protein_model(counts, found["static"], 5)
    dense = linalg.gather(t, 5)
    assert np.allclose(dense[:4, :4], 0.25) and not dense[4].any() and not dense[:, 4].any()
    photons = spark.range(60).selectExpr("id % 6 AS burst_id", "id AS k", "id DIV 6 AS frame")
    drawn = dyes.run_bursts(photons, counts, found["static"], 5, 2)
    assert drawn.count() == 60 and drawn.where("outcome = 'non_radiative'").isEmpty()
    pi = linalg.scatter(spark, np.array([0.25] * 4))
    t4 = linalg.scatter(spark, np.full((4, 4), 0.25))
    assert dyes.simulate_bursts(photons, t4, pi, 4, donor, acceptor, 2.4e15, 0.9).count() == 6
    with pytest.raises(DataInvalid):
        dyes.lifetimes(donor, acceptor, treatment="x", **ask)


def test_dye_model_without_clashing_conformers():
    c = np.array([[8.0, 2, 1], [2, 8, 1], [1, 1, 8]])
    t, pi = dyes.dye_model(c, [0, 1])
    assert np.allclose(t, [[0.8, 0.2, 0], [0.2, 0.8, 0], [0, 0, 0]]) and np.allclose(pi, [0.5, 0.5, 0])
    assert dyes.dye_model(c, [])[1].tolist() == [0, 0, 0]


def test_exposons_from_structures(spark):
    rng = np.random.default_rng(9)
    base = np.array([[0, 0, 0], [0.15, 0, 0], [1.5, 0, 0], [1.65, 0, 0]])
    rows = [(0, f, (base + rng.normal(0, 0.02, (4, 3))).ravel().tolist()) for f in range(12)]
    structures = spark.createDataFrame(rows, "traj_id int, frame int, xyz array<double>")
    atoms = spark.createDataFrame([(0, "CA", 0), (1, "CB", 0), (2, "CA", 1), (3, "CB", 1)], "atom_id long, name string, res_id int")
    mi, labels = dyes.exposons(structures, atoms, [0.17] * 4, 0.9, threshold=2.2)
    assert mi.count() == 4 and labels.count() == 2
