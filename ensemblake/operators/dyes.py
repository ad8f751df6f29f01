"""Explicit dyes on a protein: placed conformers, dipoles, their models and the light they give."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..exceptions import DataInvalid, InsufficientResourceError
from ..functions import fret, linalg
from ..functions.geometry import difference, selection
from ..plans.shared import workers_can_import
from .fret import clear_conformers, photon_events, resolve_excitations, sample_bursts, uniform
from .info import condense_sidechain_sasas, exposons_from_sasas
from .msm import normalize

#: Atoms of all of a dye library's conformers together.
MOST_ATOMS = 2_000_000
BACKBONE = ("N", "CA", "C", "O")


@dataclass
class Dye:
    """A library's entry: two dipole atoms, a centre atom and the atom that stands for CB, as atom selections."""

    mu: tuple[str, str]
    r: str
    cb: str = "name CB"


def anchor_atoms(residue: list[tuple[str, str]], dye_names: list[str], cb_name: str | None) -> tuple[list[str], list[str]]:
    """Names of protein and dye atoms that are laid on each other: backbone, and CB where the residue (name, atom) has one."""
    res_name = residue[0][0]
    both = list(BACKBONE)
    if res_name in ("GLY", "PRO") or cb_name is None:
        return both, both
    return [*both, "CB"], [*both, cb_name]


def place_dye(dye: DataFrame, atoms: DataFrame, res_seq: int, cb_name: str | None = None) -> DataFrame:
    """frame, conformer, atom_id, id, name, px, py, pz: every conformer laid on a residue of every protein frame.

    dye: (conformer, atom_id, name, x, y, z), a library of some hundred conformers; atoms: (frame, atom_id, name, res_name, res_seq, x, y, z).
    The library goes out with the tasks; a frame's residue is one row, so frames are placed in parallel.
    """
    workers_can_import(dye.sparkSession)
    if (n := dye.count()) > MOST_ATOMS:
        raise InsufficientResourceError(f"a library of {n} atoms is too large to go out with every task")
    library = dye.orderBy("conformer", "atom_id").toPandas()
    names = library[library["conformer"] == library["conformer"].iloc[0]]["name"].tolist()
    xyz = library[["x", "y", "z"]].to_numpy(float).reshape(-1, len(names), 3)
    conformers, ids = library["conformer"].to_numpy()[:: len(names)], library["atom_id"].to_numpy()[: len(names)]

    def place(batches):
        for batch in batches:
            for frame, residue in zip(batch["frame"], batch["residue"]):
                at = {a["name"]: (a["x"], a["y"], a["z"]) for a in residue}
                own, other = anchor_atoms([(a["res_name"], a["name"]) for a in residue], names, cb_name)
                if missing := [n for n in own if n not in at] + [n for n in other if n not in names]:
                    raise DataInvalid(f"atoms to lay a dye on are missing: {', '.join(missing)}")
                fixed, pick = np.array([at[n] for n in own]), [names.index(n) for n in other]
                for c, conformer in zip(conformers, xyz):
                    a = conformer[pick]
                    u, _, vt = np.linalg.svd((a - a.mean(axis=0)).T @ (fixed - fixed.mean(axis=0)))
                    turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt
                    out = (conformer - a.mean(axis=0)) @ turn + fixed.mean(axis=0)
                    yield pd.DataFrame({"frame": frame, "conformer": c, "atom_id": ids, "id": [f"{c}:{i}" for i in ids], "name": names, "px": out[:, 0], "py": out[:, 1], "pz": out[:, 2]})

    residue = atoms.where(F.col("res_seq") == res_seq).groupBy("frame").agg(F.collect_list(F.struct("res_name", "name", "x", "y", "z")).alias("residue"))
    kinds, dk = dict(atoms.dtypes), dict(dye.dtypes)
    return residue.mapInPandas(place, f"frame {kinds['frame']}, conformer {dk['conformer']}, atom_id {dk['atom_id']}, id string, name string, px double, py double, pz double")


def dipoles(placed: DataFrame, dye: Dye) -> DataFrame:
    """frame, conformer, centre, origin, dipole of placed conformers: the centre atom, the first dipole atom, the first less the second."""
    point = F.array("px", "py", "pz")
    at = lambda text: F.max(F.when(selection(text), point))
    found = placed.groupBy("frame", "conformer").agg(at(dye.r).alias("centre"), at(dye.mu[0]).alias("origin"), at(dye.mu[1]).alias("__end"))
    return found.withColumn("dipole", difference(F.col("origin"), F.col("__end"))).drop("__end")


def map_dye(dye: DataFrame, atoms: DataFrame, res_seq: int, kind: Dye, cb_name: str | None = None, probe_radius: float = 0.04, atom_tol: int = 6) -> DataFrame:
    """frame, conformer, centre, origin, dipole of the conformers that fit on a residue in each frame; a frame may have none."""
    placed = place_dye(dye, atoms, res_seq, cb_name)
    n = dye.select("atom_id").distinct().count()
    clear = clear_conformers(placed, atoms.where(F.col("res_seq") != res_seq), n, probe_radius, atom_tol)
    return dipoles(placed.join(clear, ["frame", "conformer"], "left_semi"), kind)


def sample_pairs(bursts: DataFrame, donor: DataFrame, acceptor: DataFrame, seed: int = 0) -> DataFrame:
    """bursts (burst_id, k, state) with k2 and r of a donor's and an acceptor's conformer drawn for the state (frame) of each photon."""
    out = bursts
    for name, dye, s in (("d", donor, seed), ("a", acceptor, seed + 1)):
        w = Window.partitionBy("frame").orderBy("conformer")
        own = dye.withColumn("at", F.row_number().over(w) - 1).select(F.col("frame").alias("state"), "at", F.col("centre").alias(f"{name}c"), F.col("dipole").alias(f"{name}m"))
        sizes = own.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
        out = out.join(sizes, "state").withColumn("at", F.floor(uniform("burst_id", "k", seed=s) * F.col("n")).cast("int")).drop("n")
        out = out.join(own, ["state", "at"]).drop("at")
    k2, r = fret.kappa2_r(F.col("dc"), F.col("dm"), F.col("ac"), F.col("am"))
    return out.withColumn("k2", k2).withColumn("r", r).drop("dc", "dm", "ac", "am")


def simulate_bursts(photons: DataFrame, t: DataFrame, populations: DataFrame, n_states: int, donor: DataFrame, acceptor: DataFrame, j: float, qd: float, n: float = 1.333, seed: int = 0) -> DataFrame:
    """burst_id, efficiency: bursts of a protein's model with a dye geometry, and so a Foerster radius, for every photon."""
    path = sample_bursts(photons, t, populations, n_states, seed)
    both = sample_pairs(path, donor, acceptor, seed + 10)
    e = fret.fret_efficiency(F.col("r"), fret.forster_radius(F.col("k2"), qd, j, n))
    red = (uniform("burst_id", "k", seed=seed + 20) < e).cast("double")
    return both.groupBy("burst_id").agg(F.avg(red).alias("efficiency"))


def dye_model(counts: np.ndarray, clear: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(T, populations) of a dye's own model without the conformers that clash."""
    own = np.zeros_like(counts, float)
    own[np.ix_(clear, clear)] = counts[np.ix_(clear, clear)]
    t = linalg.row_normalized(own)
    used = np.flatnonzero(own.sum(axis=1))
    pi = np.zeros(len(own))
    if len(used) > 1:
        pi[used] = np.abs(linalg.stationary(linalg.row_normalized(own[np.ix_(used, used)])))
    elif len(used):
        pi[used] = 1
    return t, pi


def _rates(d: list, a: list, j: float, qd: float, td: float, n: float) -> np.ndarray:
    """Transfer rates by donor and acceptor conformer (centre, dipole)."""
    dc, dm, ac, am = (np.array([np.asarray(x[k], float) for x in rows]) for rows, k in ((d, 0), (d, 1), (a, 0), (a, 1)))
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    between = ac[None] - dc[:, None]
    r = np.linalg.norm(between, axis=-1)
    dm, am, u = unit(dm), unit(am), unit(between)
    k2 = ((dm @ am.T) - 3 * np.einsum("ik,ijk->ij", dm, u) * np.einsum("jk,ijk->ij", am, u)) ** 2
    r0 = fret.R0_FACTOR * (k2 * qd * j / n**4) ** (1 / 6)
    return (r0 / r) ** 6 / td


def lifetimes(donor: DataFrame, acceptor: DataFrame, d_counts: np.ndarray, a_counts: np.ndarray, j: float, qd: float, td: float, dt: float, n_samples: int = 1000, treatment: str = "monte-carlo", n: float = 1.333, seed: int = 0) -> DataFrame:
    """state, event_id, lifetime, outcome of excitations in every protein state (frame) that both dyes fit on.

    monte-carlo: dyes move through their models. static: both stand still. isotropic: every pair of conformers at its probability decides one rate.
    States are independent tasks, with a seed for each.
    """
    if treatment not in ("monte-carlo", "static", "isotropic"):
        raise DataInvalid(f"unknown treatment {treatment!r}")
    workers_can_import(donor.sparkSession)
    krad, knon = qd / td, (1 - qd) / td
    pack = lambda df, name: df.groupBy("frame").agg(F.collect_list(F.struct("conformer", "centre", "dipole")).alias(name))
    both = pack(donor, "d").join(pack(acceptor, "a"), "frame")
    kind = dict(donor.dtypes)["frame"]

    def run(batches):
        for batch in batches:
            for frame, d, a in zip(batch["frame"], batch["d"], batch["a"]):
                rng = np.random.default_rng([seed, int(frame)])
                models = []
                for rows, counts in ((d, d_counts), (a, a_counts)):
                    rows = sorted(rows, key=lambda x: x["conformer"])
                    clear = [int(x["conformer"]) for x in rows]
                    t, pi = dye_model(counts, clear)
                    t, pi = t[np.ix_(clear, clear)], pi[clear]
                    models.append(([(x["centre"], x["dipole"]) for x in rows], t, pi))
                (dx, dt_, dpi), (ax, at_, api) = models
                if not dpi.sum() or not api.sum():
                    continue
                kret = _rates(dx, ax, j, qd, td, n)
                out = []
                weight = np.outer(dpi, api)
                mean = float((weight * kret / (kret + 1 / td)).sum() / weight.sum())
                for s in range(n_samples):
                    x, y = int(rng.choice(len(dpi), p=dpi / dpi.sum())), int(rng.choice(len(api), p=api / api.sum()))
                    if treatment == "isotropic":
                        rate = mean / (1 - mean) / td if mean < 1 else np.inf
                    else:
                        rate = kret[x, y]
                    if treatment != "monte-carlo":
                        total = krad + knon + rate
                        life = rng.exponential(1 / total) if np.isfinite(total) else 0.0
                        p = np.array([krad, knon, rate]) / total if np.isfinite(total) else np.array([0, 0, 1.0])
                        out.append((s, life, ("radiative", "non_radiative", "energy_transfer")[int(rng.choice(3, p=p))]))
                        continue
                    life = 0.0
                    while True:
                        life += dt
                        p = 1 - np.exp(-np.array([krad, knon, kret[x, y]]) * dt)
                        p = p / p.sum() if p.sum() > 1 else p
                        u = rng.random()
                        if u < p.sum():
                            out.append((s, life, ("radiative", "non_radiative", "energy_transfer")[int(np.searchsorted(np.cumsum(p), u, "right"))]))
                            break
                        x = int(rng.choice(len(dpi), p=dt_[x])) if dt_[x].sum() else x
                        y = int(rng.choice(len(api), p=at_[y])) if at_[y].sum() else y
                yield pd.DataFrame(out, columns=["event_id", "lifetime", "outcome"]).assign(state=frame)[["state", "event_id", "lifetime", "outcome"]]

    return both.mapInPandas(run, f"state {kind}, event_id long, lifetime double, outcome string")


def protein_model(counts: DataFrame, events: DataFrame, n_states: int):
    """The protein's model without states that have no event: those no dye fits on."""
    seen = events.select(F.col("state").cast("int").alias("i")).distinct()
    kept = counts.join(seen, "i", "left_semi").join(seen.withColumnRenamed("i", "j"), "j", "left_semi")
    return normalize(kept.select("i", "j", "v"), n_states=n_states)


def run_bursts(photons: DataFrame, counts: DataFrame, events: DataFrame, n_states: int, seed: int = 0) -> DataFrame:
    """burst_id, k, state, lifetime, outcome: photon bursts of the labelled protein, events drawn among those that gave light."""
    _, t, pi = protein_model(counts, events, n_states)
    return photon_events(sample_bursts(photons, t, pi, n_states, seed), events, seed + 1)


def exposons(structures: DataFrame, atoms: DataFrame, radii: list[float], damping: float = 0.5, probe_radius: float = 0.28, threshold: float = 0.02):
    """As exposons_from_sasas, from structures (traj_id, frame, xyz): areas of side chains by a rolling probe."""
    from ..functions.geometry import sasa

    own = sasa(structures, radii, probe_radius).select("traj_id", "frame", F.posexplode("areas").alias("atom_id", "sasa"))
    return exposons_from_sasas(condense_sidechain_sasas(own.withColumn("atom_id", F.col("atom_id").cast("long")), atoms), damping, None, threshold)


__all__ = ["Dye", "dipoles", "dye_model", "exposons", "lifetimes", "map_dye", "place_dye", "protein_model", "resolve_excitations", "run_bursts", "sample_pairs", "simulate_bursts"]
