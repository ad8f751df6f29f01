"""Transition-path theory: flux arithmetic as joins, small linear solves on gathered matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from . import sparse
from .msm import eq_probs, state_count


def i_minus_q(t: DataFrame, absorbing: list[int], n_states: int | None = None) -> DataFrame:
    """(i, j, v) of 1 - T over the full grid, rows and columns of absorbing states replaced by those of the identity."""
    n = linalg.few_states(n_states or state_count(t))
    side = t.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    grid = side.crossJoin(side.withColumnRenamed("i", "j")).join(t, ["i", "j"], "left")
    one = (F.col("i") == F.col("j")).cast("double")
    ends = F.col("i").isin(absorbing) | F.col("j").isin(absorbing)
    return grid.select("i", "j", F.when(ends, one).otherwise(one - F.coalesce("v", F.lit(0.0))).alias("v"))


def committors(t: DataFrame, sources: list[int], sinks: list[int], n_states: int | None = None) -> DataFrame:
    """(i, v): the probability to reach a sink before a source."""
    return linalg.scatter(t.sparkSession, linalg.committors(linalg.gather(t, n_states), sources, sinks))


def mfpts(t: DataFrame, sinks: list[int] | None = None, populations: DataFrame | None = None, lagtime: float = 1.0, n_states: int | None = None) -> DataFrame:
    """Mean first passage times: (i, j, v) between all pairs, or (i, v) to the sinks."""
    dense = linalg.gather(t, n_states)
    pi = None if populations is None else linalg.gather_vector(populations, len(dense))
    return linalg.scatter(t.sparkSession, linalg.mfpts(dense, sinks, pi, lagtime), keep_zeros=True)


def committors_iterated(t: DataFrame, sources: list[int], sinks: list[int], steps: int) -> DataFrame:
    """(i, v) after so many sweeps q <- T q with the ends held fixed: for matrices too large to gather. A sweep is a join and a sum."""
    held = F.when(F.col("i").isin(sinks), 1.0).when(F.col("i").isin(sources), 0.0)
    states = t.select("i").union(t.select("j")).distinct()
    q = states.select("i", F.coalesce(held, F.lit(0.0)).alias("v"))
    for _ in range(steps):
        new = t.join(q.select(F.col("i").alias("j"), F.col("v").alias("q")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("q")).alias("v"))
        q = states.join(new, "i", "left").select("i", F.coalesce(held, F.col("v"), F.lit(0.0)).alias("v"))
    return q


def reactive_fluxes(t: DataFrame, sources: list[int], sinks: list[int], populations: DataFrame | None = None, forward: DataFrame | None = None) -> DataFrame:
    """(i, j, v): population of i, times 1 - committor, times T, times the committor of j; no diagonal."""
    pi = eq_probs(t) if populations is None else populations
    q = committors(t, sources, sinks) if forward is None else forward
    ends = pi.select("i", F.col("v").alias("p")).join(q.select("i", F.col("v").alias("q")), "i").select("i", (F.col("p") * (1 - F.col("q"))).alias("a"))
    both = t.where("i <> j").join(ends, "i").join(q.select(F.col("i").alias("j"), F.col("v").alias("q")), "j")
    return both.select("i", "j", (F.col("a") * F.col("v") * F.col("q")).alias("v"))


def net_of(flux: DataFrame) -> DataFrame:
    """(i, j, v) where what goes from i to j is more than what comes back."""
    back = flux.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("v")).alias("v"))
    return flux.select("i", "j", "v").unionByName(back).groupBy("i", "j").agg(F.sum("v").alias("v")).where("v > 0")


def net_fluxes(t: DataFrame, sources: list[int], sinks: list[int], populations: DataFrame | None = None) -> DataFrame:
    return net_of(reactive_fluxes(t, sources, sinks, populations))


def reactive_populations(t: DataFrame, sources: list[int], sinks: list[int], populations: DataFrame | None = None, forward: DataFrame | None = None) -> DataFrame:
    """(i, v): shares of population x committor x (1 - committor)."""
    pi = eq_probs(t) if populations is None else populations
    q = committors(t, sources, sinks) if forward is None else forward
    both = pi.select("i", F.col("v").alias("p")).join(q.select("i", F.col("v").alias("q")), "i").select("i", (F.col("p") * F.col("q") * (1 - F.col("q"))).alias("m"))
    total = both.agg(F.sum("m").alias("__all"))
    return both.crossJoin(F.broadcast(total)).select("i", F.try_divide("m", "__all").alias("v"))


def top_path(sources: list[int], sinks: list[int], net_flux: DataFrame, n_states: int | None = None) -> tuple[list[int], float]:
    return sparse.widest_path(net_flux, sources, sinks)


def paths(sources: list[int], sinks: list[int], net_flux: DataFrame, remove_path="subtract", num_paths: float = float("inf"), flux_cutoff: float = 1 - 1e-10, n_states: int | None = None) -> DataFrame:
    """(path_rank, step, state, flux) of the widest paths in order."""
    found = sparse.top_paths(net_flux, sources, sinks, remove_path, num_paths, flux_cutoff)
    rows = [(k, s, int(x), float(w)) for k, (path, w) in enumerate(found) for s, x in enumerate(path)]
    return net_flux.sparkSession.createDataFrame(rows, "path_rank int, step int, state int, flux double")
