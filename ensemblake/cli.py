"""Command line: jobs over tables of trajectories, features, angles, atoms and photons.

    python -m ensemblake.cli cluster --features DIR --metric euclidean --clusters 100 --out DIR
    python -m ensemblake.cli cluster --trajectories a.pdb b.pdb --atoms "name CA" --metric rmsd --radius 0.2 --out DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exceptions import DataInvalid, ImproperlyConfigured
from .functions import fret as fx
from .functions import linalg, metrics
from .operators import cards, clustering, dyes, fret, info, msm
from .sources import tables
from .util import readable_path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ensemblake", description="Jobs over trajectory tables")
    jobs = top.add_subparsers(dest="job", required=True)
    c = jobs.add_parser("cluster", help="cluster features (traj_id, frame, x) or structures, then assign all frames")
    c.add_argument("--features", nargs="+")
    c.add_argument("--trajectories", nargs="+", action="append", help="PDB or DCD files; may be repeated, with an --atoms for each")
    c.add_argument("--atoms", action="append", help="selection of the atoms to compare")
    c.add_argument("--topology", action="append", help="PDB file with the atoms of a group of DCD files, or none for a group of PDB files; once for each --trajectories")
    c.add_argument("--metric")
    c.add_argument("--algorithm", choices=["kcenters", "khybrid", "kmedoids"], default="khybrid")
    c.add_argument("--clusters", type=int)
    c.add_argument("--radius", type=float)
    c.add_argument("--iterations", type=int, default=5)
    c.add_argument("--subsample", type=int, default=1)
    r = jobs.add_parser("reassign", help="assign features or structures to given centres (state, x)")
    r.add_argument("--features", nargs="+")
    r.add_argument("--trajectories", nargs="+", action="append")
    r.add_argument("--atoms", action="append")
    r.add_argument("--topology", action="append")
    r.add_argument("--centers", required=True)
    r.add_argument("--metric")
    t = jobs.add_parser("implied", help="implied timescales of assignments (traj_id, frame, state)")
    t.add_argument("--assignments", required=True)
    t.add_argument("--lag-times", default="1:10:1", help="first:last:step")
    t.add_argument("--symmetrization", choices=sorted(msm.BUILDERS), default="transpose")
    t.add_argument("--prior", action="store_true", help="a pseudocount of one over the number of states")
    t.add_argument("--n-eigenvalues", type=int)
    t.add_argument("--trim", action="store_true")
    unit = t.add_mutually_exclusive_group()
    unit.add_argument("--timestep", type=float, help="time units a frame")
    unit.add_argument("--infer-timestep", help="table (traj_id, frame, time) whose first two frames tell it")
    k = jobs.add_parser("cards", help="correlations of rotamers and disorder from angles (traj_id, feature, frame, kind, angle)")
    e = jobs.add_parser("entropy", help="entropy of each dihedral's rotamers")
    for j in (k, e):
        j.add_argument("--angles", required=True)
        j.add_argument("--buffer-width", type=float, default=15)
    d = jobs.add_parser("dye-clouds", help="distance distributions of a dye cloud (id, x, y, z in a residue's axes) on pairs of residues")
    d.add_argument("--atoms", required=True, help="table (frame, atom_id, name, res_seq, x, y, z, radius)")
    d.add_argument("--cloud", required=True)
    d.add_argument("--pairs", required=True, nargs="+", help="residues as 12:40")
    d.add_argument("--bin-width", type=float, default=0.1)
    b = jobs.add_parser("fret-bursts", help="efficiencies of photon bursts from distance distributions, for each of some time factors")
    b.add_argument("--distances", required=True, help="table (state, bin, lo, hi, p)")
    b.add_argument("--r0", type=float, required=True)
    f = jobs.add_parser("fit-fret", help="the time factor whose efficiencies are distributed as the measured ones")
    f.add_argument("--predicted", required=True, help="table (time_factor, burst_id, efficiency)")
    f.add_argument("--measured", required=True, help="table (efficiency)")
    f.add_argument("--bins", type=int, default=20)
    m = jobs.add_parser("dye-lifetimes", help="excitations of two explicit dyes (tables of conformers) in every protein state")
    m.add_argument("--atoms", required=True)
    for side in ("donor", "acceptor"):
        m.add_argument(f"--{side}", required=True, help="table (conformer, atom_id, name, x, y, z)")
        m.add_argument(f"--{side}-residue", type=int, required=True)
        m.add_argument(f"--{side}-counts", required=True, help="transition counts (i, j, v) of the dye's own model")
        m.add_argument(f"--{side}-atoms", required=True, help="names of both dipole atoms, the centre and the atom that stands for CB: M1,M2,R,CB")
    m.add_argument("--overlap", type=float, required=True)
    m.add_argument("--quantum-yield", type=float, required=True)
    m.add_argument("--lifetime", type=float, required=True)
    m.add_argument("--step", type=float, default=0.1)
    m.add_argument("--samples", type=int, default=1000)
    m.add_argument("--treatment", choices=["monte-carlo", "static", "isotropic"], default="monte-carlo")
    g = jobs.add_parser("dye-bursts", help="photon bursts of a protein with explicit dyes, for each of some time factors")
    g.add_argument("--events", required=True, help="what dye-lifetimes wrote")
    for j in (b, g):
        j.add_argument("--counts", required=True, help="transition counts (i, j, v) of the protein")
        j.add_argument("--photons", required=True, help="table (burst_id, k, dt_us)")
        j.add_argument("--lagtime", type=float, required=True, help="of the counts, in ns")
        j.add_argument("--time-factors", type=float, nargs="+", default=[1.0])
    for j in (m, b, g):
        j.add_argument("--seed", type=int, default=0)
    for j in jobs.choices.values():
        j.add_argument("--out", required=True, type=readable_path(exists=False))
    return top


def _frames(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, str]:
    """What a job clusters, and its metric."""
    if bool(a.features) == bool(a.trajectories):
        raise ImproperlyConfigured("needs either --features or --trajectories")
    if a.trajectories:
        if not a.atoms:
            raise ImproperlyConfigured("--trajectories needs --atoms")
        topologies = a.topology and [None if t == "none" else t for t in a.topology]
        return tables.load_trajectories(spark, a.trajectories, a.atoms, topologies), a.metric or "rmsd"
    if a.metric == "rmsd" or a.atoms:
        raise ImproperlyConfigured("features have neither atoms nor an rmsd")
    return tables.load_features(spark, a.features if len(a.features) > 1 else a.features[0]), a.metric or "euclidean"


def _cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.clusters is None and (a.radius is None or a.algorithm == "kmedoids"):
        raise ImproperlyConfigured("needs --clusters" if a.algorithm == "kmedoids" else "needs --clusters or --radius")
    whole, metric = _frames(spark, a)
    frames = whole.where(F.col("frame") % a.subsample == 0)
    if a.algorithm == "kmedoids":
        found = clustering.kmedoids(frames, metric, a.clusters, a.iterations)
    else:
        found = clustering.hybrid(frames, metric, a.iterations if a.algorithm == "khybrid" else 0, a.clusters or float("inf"), a.radius or 0.0)
    own = found.assignments if a.subsample == 1 else clustering.assign_to_nearest_center(whole, found.centers.select("state", "x"), metric).select("traj_id", "frame", "state", "distance")
    own.write.parquet(f"{a.out}/assignments")
    found.centers.write.parquet(f"{a.out}/centers")


def _reassign(spark: SparkSession, a: argparse.Namespace) -> None:
    whole, metric = _frames(spark, a)
    clustering.reassign(whole, spark.read.parquet(a.centers), metric).select("traj_id", "frame", "state", "distance").write.parquet(a.out)


def _implied(spark: SparkSession, a: argparse.Namespace) -> None:
    first, last, step = map(int, a.lag_times.split(":"))
    unit = a.timestep or 1.0
    if a.infer_timestep:
        two = spark.read.parquet(a.infer_timestep).orderBy("traj_id", "frame").limit(2).collect()
        if len(two) < 2 or two[0].traj_id != two[1].traj_id:
            raise DataInvalid("a timestep needs two frames of a trajectory")
        unit = float(two[1].time - two[0].time)
    found = msm.implied_timescales(spark.read.parquet(a.assignments), list(range(first, last + 1, step)), a.symmetrization, a.n_eigenvalues, trim=a.trim, prior=a.prior)
    found.withColumn("timescale", F.col("timescale") * unit).write.parquet(a.out)


def _angles(spark: SparkSession, a: argparse.Namespace) -> None:
    if not 0 < a.buffer_width < 360:
        raise ImproperlyConfigured("the buffer must be between 0 and 360 degrees")
    angles = spark.read.parquet(a.angles)
    states = cards.all_rotamers(angles, a.buffer_width)
    if a.job == "entropy":
        info.feature_entropies(states).write.csv(a.out, header=True)
        return
    sizes = {r.feature: len(cards.KINDS[r.kind][0]) - 1 for r in angles.select("feature", "kind").distinct().collect()}
    for name, mi in cards.cards(states, sizes).items():
        mi.write.parquet(f"{a.out}/{name}")


def _dye_clouds(spark: SparkSession, a: argparse.Namespace) -> None:
    atoms, cloud, found = spark.read.parquet(a.atoms), spark.read.parquet(a.cloud), None
    for pair in a.pairs:
        left, right = (fret.remove_clashes(fret.place_cloud(cloud, atoms, int(r)), atoms.where(F.col("res_seq") != int(r))) for r in pair.split(":"))
        p = fret.distance_histogram(left, right, a.bin_width)
        own = metrics.shares(p, "n", ["frame"], "p").select(F.lit(pair).alias("pair"), F.col("frame").alias("state"), "bin", "lo", "hi", "p")
        found = own if found is None else found.unionByName(own)
    found.write.partitionBy("pair").parquet(a.out)


def _photons(spark: SparkSession, a: argparse.Namespace):
    """(time factor, photons with frames) of each time factor."""
    for factor in a.time_factors:
        yield factor, fret.photon_frames(spark.read.parquet(a.photons), a.lagtime, factor)


def _fret_bursts(spark: SparkSession, a: argparse.Namespace) -> None:
    counts, distances, found = spark.read.parquet(a.counts), spark.read.parquet(a.distances), None
    n = msm.state_count(counts)
    # States without a distance aren't labelled and have no photons.
    states = spark.range(n).select(F.col("id").cast("int").alias("state"))
    bad = states.join(distances.select("state").distinct(), "state", "left_anti")
    _, t, pi = fret.labelled_model(counts, bad, bad, n)
    for factor, photons in _photons(spark, a):
        path = fret.sample_bursts(photons, t, pi, n, a.seed)
        far = fret.sample_distances(path, distances, "state", ["burst_id", "k"], a.seed + 1)
        own = fret.burst_efficiencies(far.withColumn("e", fx.fret_efficiency(F.col("r"), a.r0)), "e", a.seed + 2).select(F.lit(factor).alias("time_factor"), "burst_id", "efficiency")
        found = own if found is None else found.unionByName(own)
    found.write.parquet(a.out)


def _fit_fret(spark: SparkSession, a: argparse.Namespace) -> None:
    predicted = metrics.histogram_like(spark.read.parquet(a.predicted), "efficiency", 0, 1, a.bins, ["time_factor"])
    measured = metrics.histogram_like(spark.read.parquet(a.measured), "efficiency", 0, 1, a.bins)
    fret.fit_time_factor(predicted, measured).write.parquet(a.out)


def _dye_lifetimes(spark: SparkSession, a: argparse.Namespace) -> None:
    atoms, placed, counts = spark.read.parquet(a.atoms), [], []
    for side in ("donor", "acceptor"):
        m1, m2, r, cb = getattr(a, f"{side}_atoms").split(",")
        kind = dyes.Dye((f"name {m1}", f"name {m2}"), f"name {r}")
        placed.append(dyes.map_dye(spark.read.parquet(getattr(a, side)), atoms, getattr(a, f"{side}_residue"), kind, cb))
        counts.append(linalg.gather(spark.read.parquet(getattr(a, f"{side}_counts"))))
    found = dyes.lifetimes(*placed, *counts, j=a.overlap, qd=a.quantum_yield, td=a.lifetime, dt=a.step, n_samples=a.samples, treatment=a.treatment, seed=a.seed)
    found.write.parquet(a.out)


def _dye_bursts(spark: SparkSession, a: argparse.Namespace) -> None:
    counts, events, found = spark.read.parquet(a.counts), spark.read.parquet(a.events), None
    for factor, photons in _photons(spark, a):
        own = fret.burst_lifetimes(dyes.run_bursts(photons, counts, events, msm.state_count(counts), a.seed)).withColumn("time_factor", F.lit(factor))
        found = own if found is None else found.unionByName(own)
    found.write.parquet(a.out)


JOBS = {
    "cluster": _cluster, "reassign": _reassign, "implied": _implied, "cards": _angles, "entropy": _angles, "dye-clouds": _dye_clouds,
    "fret-bursts": _fret_bursts, "fit-fret": _fit_fret, "dye-lifetimes": _dye_lifetimes, "dye-bursts": _dye_bursts,
}


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    JOBS[a.job](spark, a)


def main() -> None:
    import sys

    run(SparkSession.builder.appName("ensemblake").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
