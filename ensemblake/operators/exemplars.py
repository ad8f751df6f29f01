"""Exemplars by messages along the pairs of a similarity table; pairs that aren't there are never made."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..exceptions import ConvergenceWarning, DataInvalid
from ..plans.shared import sized, written
from .sparse import FEW, alone

#: Rounds in a row with the same exemplars, after which these are taken.
STEADY = 15


def _messages(i: np.ndarray, k: np.ndarray, s: np.ndarray, spare: float, damping: float, most: int) -> tuple[np.ndarray, bool]:
    """(places of the pairs (k, k) whose k is an exemplar, whether they settled), for pairs in order of i as flat arrays."""
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    row = np.cumsum(np.r_[False, i[1:] != i[:-1]])
    column = np.searchsorted(i[first], k)
    own = np.flatnonzero(i == k)
    r, a, last, same = np.zeros(len(s)), np.zeros(len(s)), None, 0
    for _ in range(most):
        both = a + s
        top = np.maximum.reduceat(both, first)[row]
        best = both == top
        alone_at_top = (np.add.reduceat(best.astype(np.int64), first) == 1)[row]
        second = np.maximum.reduceat(np.where(best, -np.inf, both), first)[row]
        other = np.where(best & alone_at_top, np.where(np.isinf(second), both - spare, second), top)
        r = damping * r + (1 - damping) * (s - other)
        support = np.maximum(r, 0)
        support[own] = 0
        given, self_ = np.bincount(column, support, len(first)), r[own]
        new = np.minimum(self_[column] + given[column] - support, 0)
        new[own] = given
        a = damping * a + (1 - damping) * new
        chosen = r[own] + a[own] > 0
        same = same + 1 if last is not None and (chosen == last).all() else 0
        last = chosen
        if same >= STEADY and chosen.any():
            return own[chosen], True
    return own[last], False


def _in_one_task(pairs: DataFrame, spare: float, damping: float, most: int) -> DataFrame:
    """(k, settled) of exemplars."""
    kind = dict(pairs.dtypes)["k"]

    def work(i: np.ndarray, k: np.ndarray, s: np.ndarray) -> list:
        order = np.lexsort((k, i))
        i, k, s = i[order], k[order], s[order]
        at, settled = _messages(i, k, s, spare, damping, most)
        return [k[at], np.full(len(at), settled)]

    return alone(pairs.select("i", "k", "s"), work, f"k {kind}, settled boolean")


def _in_rounds(pairs: DataFrame, spare: float, damping: float, most: int) -> DataFrame:
    """As _in_one_task, a round of messages at a time, each written to the shared folder.

    A round is one shuffle by i, for the two best choices of a row, and one of partial sums by k. What comes to the driver is how many exemplars there are, and a sum of their hashes.
    """
    own = F.col("i") == F.col("k")
    mine = Window.partitionBy("i")
    now = written(pairs.select("i", "k", "s", F.lit(0.0).alias("r"), F.lit(0.0).alias("a")), "messages")
    last, same = None, 0
    for _ in range(most):
        both = F.col("a") + F.col("s")
        rows = now.withColumn("v", both).withColumn("top", F.max("v").over(mine)).withColumn("best", F.col("v") == F.col("top"))
        rows = rows.withColumn("bests", F.count_if("best").over(mine)).withColumn("second", F.max(F.when(~F.col("best"), F.col("v"))).over(mine))
        other = F.when(F.col("best") & (F.col("bests") == 1), F.coalesce("second", F.col("v") - spare)).otherwise(F.col("top"))
        rows = rows.select("i", "k", "s", (damping * F.col("r") + (1 - damping) * (F.col("s") - other)).alias("r"), "a")
        support = F.when(own, 0.0).otherwise(F.greatest("r", F.lit(0.0)))
        sums = written(rows.groupBy("k").agg(F.sum(support).alias("given"), F.max(F.when(own, F.col("r"))).alias("own")), "support")
        new = F.when(own, F.col("given")).otherwise(F.least(F.col("own") + F.col("given") - support, F.lit(0.0)))
        a = damping * F.col("a") + (1 - damping) * new
        now = written(rows.join(sized(sums), "k").select("i", "k", "s", "r", a.alias("a")), "messages")
        chosen = now.where(own & (F.col("r") + F.col("a") > 0)).select("k")
        state = tuple(chosen.agg(F.count(F.lit(1)), F.sum(F.xxhash64("k").cast("decimal(38,0)"))).first())
        same = same + 1 if state == last else 0
        last = state
        if same >= STEADY and state[0]:
            return chosen.withColumn("settled", F.lit(True))
    return chosen.withColumn("settled", F.lit(False))


def affinity_propagation(similarities: DataFrame, damping: float = 0.5, preference: float | None = None, most: int = 10_000, few: int = FEW) -> DataFrame:
    """i, exemplar of a table (i, k, s) of how well k would stand for i, ids in whole numbers; preference: how well all stand for themselves, else the median of s.

    A pair that isn't there can't be chosen; of repeated pairs the largest s counts, pairs with a null or NaN don't, and those (i, i) give way to the preference. exemplar
    is null where no neighbour is one, and everywhere if none emerges. Equal choices are told apart by a hash of the pair, so a re-run chooses the same. Up to `few` pairs, counted
    first, one task passes the messages; beyond that a round is a job. A warning says where exemplars still change after `most` rounds.
    """
    if not 0.5 <= damping < 1:
        raise DataInvalid("damping is at least 0.5, and below 1")
    known = similarities.where("i IS NOT NULL AND k IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    named = written(known.groupBy("i", "k").agg(F.max(F.col("s").cast("double")).alias("s")), "similarities")
    pairs, ids = named.where("i <> k"), named.select("i").union(named.select("k")).distinct()
    chosen = F.median("s") if preference is None else F.lit(float(preference))
    low, high, own, n = pairs.agg(F.min("s"), F.max("s"), chosen, F.count(F.lit(1))).first()
    own = 0.0 if own is None else own
    low, high = (own, own) if low is None else (min(low, own), max(high, own))
    draw = F.pmod(F.xxhash64("i", "k"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    full = pairs.select("i", "k", "s").union(ids.select("i", F.col("i").alias("k"), F.lit(own).alias("s")))
    full = written(full.withColumn("s", F.col("s") + F.lit(1e-10 * (high - low)) * draw), "pairs")
    found = written((_in_one_task if full.count() <= few else _in_rounds)(full, high - low + 1, damping, most), "exemplars")
    if n and found.where("settled").isEmpty():
        warnings.warn(f"exemplars still change after {most} rounds", ConvergenceWarning, stacklevel=2)
    own_labels = found.select(F.col("k").alias("i"), F.col("k").alias("own"))
    best = full.join(found.select("k"), "k").groupBy("i").agg(F.max_by("k", "s").alias("best"))
    return ids.join(best, "i", "left").join(own_labels, "i", "left").select("i", F.coalesce("own", "best").alias("exemplar"))
