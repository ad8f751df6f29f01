"""Information theory: joint counts of all feature pairs, and what follows from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..exceptions import DataInvalid
from ..functions import linalg
from ..functions.pairs import pair_counts
from ..plans.shared import workers_can_import, written
from .counts import assigns_to_counts
from .exemplars import affinity_propagation
from .msm import normalize, with_prior

FRAME = ["traj_id", "frame"]


def unpivot(df: DataFrame, features: list[str], keys: list[str] = FRAME) -> DataFrame:
    """keys, feature, state: one row per feature of a wide table, numbered in the order given."""
    cells = F.array(*(F.struct(F.lit(k).alias("feature"), F.col(c).cast("int").alias("state")) for k, c in enumerate(features)))
    return df.select(*keys, F.inline(cells))


def joint_counts(x: DataFrame, y: DataFrame | None = None, keys: list[str] = FRAME, weight: str | None = None) -> DataFrame:
    """(fa, fb, u, v, n): how often feature fa is in state u while fb is in v, in all frames of all trajectories.

    x, y: long tables (keys, feature, state). Alone, x is joined with itself for fa <= fb only, and the other half is mirrored after the counting.
    A frame's features meet in one array. Tasks count pairs of (feature, state) as products of indicator matrices and hand on sums alone, so what is shuffled
    doesn't grow with the frames, nor are pairs ever rows.
    """
    workers_can_import(x.sparkSession)
    cell = F.struct("feature", "state", *([F.col(weight).cast("double").alias("w")] if weight else []))
    both = x.groupBy(*keys).agg(F.collect_list(cell).alias("a"))
    if y is not None:
        both = both.join(y.groupBy(*keys).agg(F.collect_list(F.struct("feature", "state")).alias("b")), keys)
    kinds = [dict(t.dtypes) for t in (x, x if y is None else y)]
    schema = f"fa {kinds[0]['feature']}, fb {kinds[1]['feature']}, u {kinds[0]['state']}, v {kinds[1]['state']}, n {'double' if weight else 'long'}"
    found = both.select("a", *(["b"] if y is not None else [])).mapInArrow(pair_counts(weight is not None), schema)
    found = (found.where("fa <= fb") if y is None else found).groupBy("fa", "fb", "u", "v").agg(F.sum("n").alias("n"))
    if y is not None:
        return found
    mirror = found.where("fa < fb").select(F.col("fb").alias("fa"), F.col("fa").alias("fb"), F.col("v").alias("u"), F.col("u").alias("v"), "n")
    return found.unionByName(mirror)


def mutual_information(joint: DataFrame) -> DataFrame:
    """(fa, fb, mi) in nats. Windows are over one pair's cells, as many as its states."""
    pair = Window.partitionBy("fa", "fb")
    p = joint.where("n > 0").select("*", F.sum("n").over(pair).alias("all"), F.sum("n").over(Window.partitionBy("fa", "fb", "u")).alias("nu"), F.sum("n").over(Window.partitionBy("fa", "fb", "v")).alias("nv"))
    term = F.col("n") / F.col("all") * F.ln(F.col("n").cast("double") * F.col("all") / (F.col("nu").cast("double") * F.col("nv")))
    return p.groupBy("fa", "fb").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def channel_capacity_normalization(mi: DataFrame, n_states: dict[int, int], n_other: dict[int, int] | None = None) -> DataFrame:
    """mi over ln of the smaller number of states of the two features."""
    n_other = n_states if n_other is None else n_other
    if min([*n_states.values(), *n_other.values()]) < 2:
        raise DataInvalid("a feature has fewer than two states")
    look = lambda d, c: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))[F.col(c)]
    return mi.select("fa", "fb", (F.col("mi") / F.ln(F.least(look(n_states, "fa"), look(n_other, "fb")).cast("double"))).alias("mi"))


def mi_matrix(x: DataFrame, y: DataFrame | None, n_x: dict[int, int], n_y: dict[int, int] | None = None, normalize: bool = True, keys: list[str] = FRAME) -> DataFrame:
    """(fa, fb, mi) over all trajectories; counts merge, so there is one pass."""
    mi = mutual_information(joint_counts(x, y, keys))
    return channel_capacity_normalization(mi, n_x, n_y) if normalize else mi


def weighted_mi(x: DataFrame, weight: str, n_states: dict[int, int] | None = None, normalize: bool = True, keys: list[str] = FRAME) -> DataFrame:
    """As mi_matrix of x with itself, frames counting by their weight (a column of x)."""
    mi = mutual_information(joint_counts(x, None, keys, weight))
    if not normalize:
        return mi
    n_states = n_states or {r.feature: r.n for r in x.groupBy("feature").agg((F.max("state") + 1).alias("n")).collect()}
    return channel_capacity_normalization(mi, n_states)


def apc(m: DataFrame, n: int) -> DataFrame:
    """(i, j, v): the matrix times itself over n squared, the expected background of a symmetric matrix."""
    right = m.select(F.col("i").alias("k"), F.col("j").alias("j"), F.col("v").alias("b"))
    left = m.select("i", F.col("j").alias("k"), F.col("v").alias("a"))
    return left.join(right, "k").groupBy("i", "j").agg((F.sum(F.col("a") * F.col("b")) / (n * n)).alias("v"))


def _with_diagonal(m: DataFrame, marginal: DataFrame | None) -> DataFrame:
    h = m.where("i = j").select("i", F.col("v").alias("h")) if marginal is None else marginal.select("i", F.col("v").alias("h"))
    return m.join(h.toDF("i", "hi"), "i").join(h.toDF("j", "hj"), "j")


def nmi(m: DataFrame, marginal: DataFrame | None = None) -> DataFrame:
    """(i, j, v): information over joint entropy, 1 on the diagonal; 0 where undefined. marginal: entropies (i, v), else the diagonal."""
    joint = F.col("hi") + F.col("hj") - F.col("v")
    return _with_diagonal(m, marginal).select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce(F.try_divide("v", joint), F.lit(0.0))).alias("v"))


def nmi_apc(m: DataFrame, n: int, marginal: DataFrame | None = None) -> DataFrame:
    """(i, j, v): information less its background, over joint entropy."""
    both = _with_diagonal(m, marginal).join(apc(m, n).withColumnRenamed("v", "a"), ["i", "j"])
    share = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.try_divide("v", F.col("hi") + F.col("hj") - F.col("v")))
    joint = F.try_divide(F.col("v"), share)
    return both.select("i", "j", F.coalesce(F.try_divide(F.col("v") - F.col("a"), joint), F.lit(0.0)).alias("v"))


def check_symmetric(m: DataFrame) -> None:
    flipped = m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    if not m.select("i", "j", "v").exceptAll(flipped).isEmpty():
        raise DataInvalid("the matrix isn't symmetric")


def plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.ln(p)).otherwise(0.0)


def shannon_entropy(df: DataFrame, p: str = "p", by: list[str] = (), normalize: bool = True) -> DataFrame:
    """by, h in nats; p is divided by its group's sum first unless told not to."""
    if normalize:
        # -sum(p/s ln(p/s)) = ln s - sum(p ln p) / s, one aggregate
        total = F.sum(p)
        return df.groupBy(*by).agg((F.ln(total) - F.try_divide(F.sum(plogp(F.col(p))), total)).alias("h"))
    return df.groupBy(*by).agg((-F.sum(plogp(F.col(p)))).alias("h"))


def kl_divergence(p: DataFrame, q: DataFrame, base: float = 2) -> DataFrame:
    """(i, v): of each row of two matrices (i, j, v); infinite where q lacks what p has. Negative entries are an error."""
    both = p.select("i", "j", F.col("v").alias("p")).join(q.select("i", "j", F.col("v").alias("q")), ["i", "j"], "full")
    a, b = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    bad = F.raise_error(F.lit("negative probability")).cast("double")
    term = F.when((a < 0) | (b < 0), bad).when(a == 0, 0.0).when(b == 0, float("inf")).otherwise(a * F.ln(F.try_divide(a, b)))
    return both.groupBy("i").agg((F.sum(term) / math.log(base)).alias("v"))


def js_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """(i, v) in bits: the mean divergence of both from their middle."""
    middle = p.select("i", "j", "v").unionByName(q.select("i", "j", "v")).groupBy("i", "j").agg((F.sum("v") / 2).alias("v"))
    both = kl_divergence(p, middle).unionByName(kl_divergence(q, middle))
    return both.groupBy("i").agg((F.sum("v") / 2).alias("v"))


def q_from_assignments(assigns: DataFrame, n_states: int, lag_time: int = 1, builder=normalize, prior_counts: float | None = None) -> DataFrame:
    """T of assignments with a prior in every cell, by default one over the number of frame-to-frame steps."""
    if prior_counts is None:
        steps = assigns.groupBy("traj_id").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n")).first()[0]
        prior_counts = 1.0 / steps
    return builder(with_prior(assigns_to_counts(assigns, lag_time), prior_counts, n_states), calculate_eq_probs=False)[1]


def relative_entropy_per_state(p: DataFrame, q: DataFrame, weights: DataFrame | None = None, state_subset: list[int] | None = None, base: float = 2) -> DataFrame:
    """(i, v): divergence of each state's transitions, times its weight (i, v)."""
    out = kl_divergence(p, q, base)
    if state_subset is not None:
        out = out.where(F.col("i").isin(list(state_subset)))
    if weights is None:
        return out
    return out.join(weights.select("i", F.col("v").alias("w")), "i").select("i", (F.col("v") * F.col("w")).alias("v"))


def relative_entropy_msm(p: DataFrame, q: DataFrame, populations: DataFrame, state_subset: list[int] | None = None, base: float = 2) -> DataFrame:
    """One row, v: the mean over populations, which are renewed over a subset."""
    own = relative_entropy_per_state(p, q, None, state_subset, base).join(populations.select("i", F.col("v").alias("w")), "i")
    return own.agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def feature_entropies(x: DataFrame, by: list[str] = ("feature",)) -> DataFrame:
    """feature, h: entropy of each feature's states over all frames."""
    return shannon_entropy(x.groupBy(*by, "state").agg(F.count(F.lit(1)).cast("double").alias("p")), "p", list(by))


def residue_entropies(dihedral: DataFrame, mapping: DataFrame, residues: DataFrame) -> DataFrame:
    """residue, h, capacity, share: summed over a residue's dihedrals (feature, residue, n_states); NaN where it has none."""
    own = dihedral.join(mapping, "feature").groupBy("residue").agg(F.sum("h").alias("h"), F.sum(F.ln(F.col("n_states").cast("double"))).alias("capacity"))
    full = residues.select("residue").join(own, "residue", "left").select("residue", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("capacity", F.lit(0.0)).alias("capacity"))
    return full.withColumn("share", F.coalesce(F.try_divide("h", "capacity"), F.lit(float("nan"))))


BACKBONE = ["N", "C", "CA", "O", "HA", "H", "H1", "H2", "H3", "OXT"]  # fixed values: atoms that are no side chain


def sidechain_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.where(~F.col("name").isin(BACKBONE))


def condense_sidechain_sasas(sasas: DataFrame, atoms: DataFrame) -> DataFrame:
    """traj_id, frame, residue, sasa: area of a residue's side chain."""
    return sasas.join(sidechain_atoms(atoms).select("atom_id", F.col("res_id").alias("residue")), "atom_id").groupBy("traj_id", "frame", "residue").agg(F.sum("sasa").alias("sasa"))


def exposons_from_sasas(sasas: DataFrame, damping: float = 0.5, weight: str | None = None, threshold: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(mi (fa, fb, mi), labels (residue, exposon)): residues whose exposure (area over the threshold) goes together, numbered by their exemplars' order; -1 without one."""
    states = sasas.withColumn("state", (F.col("sasa") > threshold).cast("int")).withColumnRenamed("residue", "feature").withColumn("__w", F.col(weight) if weight else F.lit(1.0))
    names = sorted(r.feature for r in states.select("feature").distinct().collect())
    mi = weighted_mi(states, "__w", dict.fromkeys(names, 2))
    return mi, exposon_labels(mi, damping)


def exposon_labels(mi: DataFrame, damping: float = 0.5) -> DataFrame:
    """residue, exposon of couplings (fa, fb, mi): groups around exemplars; residues stand for themselves at no coupling."""
    found = written(affinity_propagation(mi.select(F.col("fa").alias("i"), F.col("fb").alias("k"), F.col("mi").alias("s")), damping, 0.0), "labels")
    order = Window.orderBy("exemplar")  # of exemplars alone: a row each, of one number
    numbers = found.where("exemplar IS NOT NULL").select("exemplar").distinct().withColumn("exposon", F.row_number().over(order) - 1)
    return found.join(numbers, "exemplar", "left").select(F.col("i").cast("int").alias("residue"), F.coalesce("exposon", F.lit(-1)).cast("int").alias("exposon"))


def deconvolve_network(observed: DataFrame, n: int | None = None) -> DataFrame:
    return linalg.scatter(observed.sparkSession, linalg.deconvolve(linalg.gather(observed, n)), keep_zeros=True)
