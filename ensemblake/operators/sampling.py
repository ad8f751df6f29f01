"""Seeded sampling: bootstraps, synthetic paths, random rows. All draws are hashes of keys, so plans may be re-run in any partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg
from ..plans.shared import workers_can_import, written
from .fret import uniform


BLOCK = 65_536


def bootstrap_weights(assigns: DataFrame, n_trials: int, seed: int = 0) -> DataFrame:
    """trial, traj_id, times: how often each trajectory is drawn in a resample with replacement, of as many as there are."""
    ids = written(assigns.select("traj_id").distinct(), "trajectories")
    n = ids.count()
    # Numbers by blocks of some ten thousand, so no window has all trajectories.
    ids = ids.withColumn("block", F.pmod(F.xxhash64("traj_id"), F.lit(n // BLOCK + 1)))
    firsts = ids.groupBy("block").agg(F.count(F.lit(1)).alias("k"))
    firsts = firsts.select("block", F.coalesce(F.sum("k").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("traj_id")) - 1
    ids = ids.withColumn("inside", inside).join(firsts, "block").select("traj_id", (F.col("first") + F.col("inside")).alias("at"))
    draws = ids.select("at").crossJoin(assigns.sparkSession.range(n_trials).withColumnRenamed("id", "trial"))
    draws = draws.select("trial", F.floor(uniform("trial", "at", seed=seed) * n).cast("long").alias("at"))
    return draws.groupBy("trial", "at").agg(F.count(F.lit(1)).alias("times")).join(ids, "at").select("trial", "traj_id", "times")


def bootstrap_counts(assigns: DataFrame, lag_time: int, n_trials: int, seed: int = 0, sliding_window: bool = True) -> DataFrame:
    """trial, i, j, v: transition counts of every resample in one job: trajectories are counted once and weighted."""
    from .counts import transition_pairs

    own = transition_pairs(assigns, lag_time, sliding_window).groupBy("traj_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    return own.join(bootstrap_weights(assigns, n_trials, seed), "traj_id").groupBy("trial", "i", "j").agg(F.sum(F.col("n") * F.col("times")).cast("double").alias("v"))


def bootstrap_models(assigns: DataFrame, lag_time: int, n_trials: int, seed: int = 0) -> DataFrame:
    """trial, i, j, v: row-normalised models of the resamples."""
    counts = bootstrap_counts(assigns, lag_time, n_trials, seed)
    total = counts.groupBy("trial", "i").agg(F.sum("v").alias("s"))
    return counts.join(total, ["trial", "i"]).select("trial", "i", "j", (F.col("v") / F.col("s")).alias("v"))


def bootstrap(assigns: DataFrame, func, n_trials: int, seed: int = 0) -> list:
    """func of each resample, a table (traj_id, frame, state) in which a trajectory drawn twice has two ids."""
    weights, out = bootstrap_weights(assigns, n_trials, seed), []
    for k in range(n_trials):
        own = weights.where(F.col("trial") == k).select("traj_id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
        drawn = assigns.join(own, "traj_id").withColumn("traj_id", F.concat_ws(":", "traj_id", "copy")).drop("copy")
        out.append(func(drawn))
    return out


def synthetic_trajectories(t: DataFrame, n_states: int, n_trajectories: int, n_steps: int, start_state: int = 0, seed: int = 0) -> DataFrame:
    """traj_id, frame, state: kinetic Monte Carlo paths, a path per row of work and a seed per path."""
    spark = t.sparkSession
    workers_can_import(spark)
    cdf = np.cumsum(linalg.gather(t, n_states), axis=1)

    def run(batches):
        for batch in batches:
            for traj in batch["id"]:
                rng, state = np.random.default_rng([seed, int(traj)]), start_state
                states = np.empty(n_steps, np.int32)
                for k in range(n_steps):
                    states[k] = state
                    row = cdf[state]
                    if row[-1] > 0:
                        state = int(min(np.searchsorted(row, rng.random() * row[-1], "right"), n_states - 1))
                yield pd.DataFrame({"traj_id": traj, "frame": np.arange(n_steps), "state": states})

    return spark.range(n_trajectories).mapInPandas(run, "traj_id long, frame long, state int")


def random_row(df: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    """One row, every one as likely."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(1)


def remake_from_histogram(h: DataFrame, seed: int = 0) -> DataFrame:
    """value: n values spread evenly over each bin (bin, lo, hi, n)."""
    each = h.where("n > 0").select("bin", "lo", "hi", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    return each.select("bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * uniform("bin", "k", seed=seed)).alias("value"))


