"""Distance-based clustering: nearest-centre assignment, farthest-point centres, medoid refinement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..exceptions import DataInvalid, ImproperlyConfigured
from ..functions import metrics
from ..plans.shared import bucketed, workers_can_import

#: Distances of a batch of vectors to all centres, for metrics with a matrix form.
MATRIX: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": lambda x, c: np.sqrt(((x[:, None, :] - c[None]) ** 2).sum(axis=2)),
    "sqeuclidean": lambda x, c: ((x[:, None, :] - c[None]) ** 2).sum(axis=2),
    "manhattan": lambda x, c: np.abs(x[:, None, :] - c[None]).sum(axis=2),
    "cityblock": lambda x, c: np.abs(x[:, None, :] - c[None]).sum(axis=2),
    "chebyshev": lambda x, c: np.abs(x[:, None, :] - c[None]).max(axis=2),
    "hamming": lambda x, c: (x[:, None, :] != c[None]).mean(axis=2),
}
#: Iterations between writes of the running state.
WRITE_EVERY = 10


@dataclass
class ClusterResult:
    """assignments (key..., state, distance), centers (state, key..., x)."""

    assignments: DataFrame
    centers: DataFrame

    def partition(self, lengths: list[int], index: str) -> DataFrame:
        """Assignments of one concatenated table, dealt back to trajectories of these lengths."""
        from .ragged import partition_list

        return partition_list(self.assignments, lengths, index)


def nearest(centers: list[list[float]], metric: str | metrics.Metric, x: str | Column = "x") -> Column:
    """struct(state, distance) of the nearest of some centres; ties go to the first. Rows whose x is null aren't looked at.

    The centres are few and go out with the task: rows aren't multiplied by centres. Metrics with a matrix form are computed for a batch at a time.
    """
    if not centers:
        raise DataInvalid("no centres")
    where = F.col(x) if isinstance(x, str) else x
    if metric in MATRIX:
        fixed, form = np.array(centers, float), MATRIX[metric]

        @F.pandas_udf("state int, distance double")
        def find(rows: pd.Series) -> pd.DataFrame:
            known = np.flatnonzero(rows.notna().to_numpy())
            best = pd.DataFrame({"state": pd.array([None] * len(rows), dtype="Int32"), "distance": np.full(len(rows), np.nan)})
            for a in range(0, len(known), 512):
                at = known[a : a + 512]
                d = form(np.stack(rows.iloc[at].to_numpy()).astype(float), fixed)
                k = d.argmin(axis=1)
                best.iloc[at, 0], best.iloc[at, 1] = k.astype(np.int32), d[np.arange(len(d)), k]
            return best

        return find(where)
    own = metrics.metric(metric)
    each = F.array(*(F.struct(own(where, vector(c)).alias("distance"), F.lit(k).alias("state")) for k, c in enumerate(centers)))
    found = F.array_min(each)
    return F.when(where.isNotNull(), F.struct(found["state"].alias("state"), found["distance"].alias("distance")))


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def assign_to_nearest_center(frames: DataFrame, centers: list[list[float]] | DataFrame, metric: str | metrics.Metric = "euclidean", x: str = "x") -> DataFrame:
    """frames with state and distance. centers: vectors in order of their labels, or a table (state, x)."""
    workers_can_import(frames.sparkSession)
    if isinstance(centers, DataFrame):
        rows = centers.select("state", "x").orderBy("state").collect()
        found = assign_to_nearest_center(frames, [list(r.x) for r in rows], metric, x)
        if [r.state for r in rows] == list(range(len(rows))):
            return found
        names = F.array(*(F.lit(r.state) for r in rows))
        return found.withColumn("state", names[F.col("state")])
    return frames.withColumn("__n", nearest(centers, metric, x)).select("*", "__n.state", "__n.distance").drop("__n")


def find_cluster_centers(assignments: DataFrame, key: list[str]) -> DataFrame:
    """state, key..., distance of the frame nearest to each state's centre; ties: the first frame."""
    best = F.min(F.struct("distance", *key)).alias("m")
    return assignments.where("state >= 0").groupBy("state").agg(best).select("state", *(f"m.{k}" for k in key), "m.distance")


def predict(frames: DataFrame, centers: DataFrame, metric: str | metrics.Metric, key: list[str], x: str = "x") -> ClusterResult:
    own = assign_to_nearest_center(frames, centers, metric, x)
    return ClusterResult(own.select(*key, "state", "distance"), find_cluster_centers(own, key))


def _centers(spark, rows: list[tuple], key: list[str], kinds: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(["state int", *(f"{k} {kinds[k]}" for k in key), "x array<double>"]))


def kcenters(frames: DataFrame, metric: str | metrics.Metric = "euclidean", n_clusters: float = float("inf"), dist_cutoff: float = 0.0, key: list[str] = ("traj_id", "frame"), x: str = "x", init_centers: list[list[float]] | None = None, use_triangle_inequality: bool = False) -> ClusterResult:
    """Farthest-point clustering: a new centre while there are fewer than n_clusters and a frame is farther than the cut-off.

    The first centre is the first frame. A round is one partial aggregate for the farthest frame (ties: the first), which alone comes to the driver.
    Vectors are written once, in buckets by key; every few rounds keys, state and distance are written in the same buckets, so the two join in
    place, and a row's distances since then are all that is computed again. With init_centers their labels come first.
    The triangle inequality skips distances where a frame is nearer to its centre than half way to the new one.
    """
    if n_clusters == float("inf") and dist_cutoff <= 0:
        raise ImproperlyConfigured("needs a number of clusters or a radius")
    key, own, spark = list(key), metrics.metric(metric), frames.sparkSession
    kinds = dict(frames.dtypes)
    base = bucketed(frames.select(*key, F.col(x).cast("array<double>").alias("x")), "vectors", key)
    centers: list[tuple] = []
    if init_centers:
        now = assign_to_nearest_center(base, init_centers, metric)
        centers = [(k, *[None] * len(key), list(map(float, c))) for k, c in enumerate(init_centers)]
    else:
        now = base.withColumn("state", F.lit(0)).withColumn("distance", F.lit(float("inf")))
    # Ties go to the first frame: distances are compared, then keys by falling order.
    farthest = F.min(F.struct((-F.col("distance")).alias("d"), *key)).alias("m")
    rounds = 0
    while len(centers) < n_clusters:
        top = now.agg(farthest).first().m
        if top is None or centers and -top.d <= dist_cutoff:
            break
        row = base.where(" AND ".join(f"{k} = {top[k]!r}" for k in key)).select("x").first()
        label, c = len(centers), vector(list(row.x))
        d = own(F.col("x"), c)
        if use_triangle_inequality and centers:
            gaps = spark.createDataFrame([(s, list(v)) for s, *_, v in centers], "state int, x array<double>").select("state", own(F.col("x"), c).alias("g")).collect()
            half = F.create_map(*(F.lit(v) for r in gaps for v in (r.state, r.g / 2)))[F.col("state")]
            d = F.when(F.col("distance") > half, d).otherwise(F.col("distance"))
        now = now.withColumn("__d", d).select(*key, "x", F.when(F.col("__d") < F.col("distance"), F.lit(label)).otherwise(F.col("state")).alias("state"), F.least("__d", "distance").alias("distance"))
        centers.append((label, *(top[k] for k in key), list(row.x)))
        rounds += 1
        if rounds % WRITE_EVERY == 0:
            now = base.join(bucketed(now.select(*key, "state", "distance"), "kcenters", key), key)
    return ClusterResult(now.select(*key, "state", "distance"), _centers(spark, centers, key, kinds))


def mean_square(now: DataFrame) -> float:
    return now.agg(F.avg(F.col("distance") * F.col("distance"))).first()[0]


def pam_cost(assignments: DataFrame) -> DataFrame:
    return assignments.agg(F.avg(F.col("distance") * F.col("distance")).alias("cost"))


def _proposals(now: DataFrame, key: list[str], seed: int) -> dict[int, tuple]:
    """A frame of each state, drawn by a hash: the same in any partitioning."""
    draw = F.min(F.struct(F.xxhash64(*key, F.lit(seed)).alias("h"), *key)).alias("m")
    return {r.state: tuple(r.m[k] for k in key) for r in now.groupBy("state").agg(draw).collect()}


def pam_sweep(base: DataFrame, result: ClusterResult, metric: str | metrics.Metric, key: list[str], proposals: dict[int, tuple] | None = None, seed: int = 0) -> ClusterResult:
    """One sweep over the medoids in order: each proposed frame replaces its medoid if the mean squared distance falls.

    base: key..., x. Frames nearer to the proposal move to it; of the others only those of the replaced medoid look for another, so a
    proposal costs a distance a row and those of one medoid's rows to the rest. A trial is one aggregate; where it is taken, keys, states and distances are written in
    buckets by key. Vectors are never written: where base is in such buckets too (see bucketed), both join in place.
    """
    spark, kinds = base.sparkSession, dict(base.dtypes)
    base = base.select(*key, F.col("x").cast("array<double>").alias("x"))
    centers = [(r.state, *(r[k] for k in key), list(r.x)) for r in result.centers.orderBy("state").collect()]
    own = metrics.metric(metric)
    state = bucketed(result.assignments.select(*key, "state", "distance"), "medoids", key)
    cost = mean_square(state)
    proposals = proposals or _proposals(state, key, seed)
    for at, (label, *_rest) in enumerate(centers):
        if label not in proposals:
            continue
        at_key = proposals[label]
        row = base.where(" AND ".join(f"{k} = {v!r}" for k, v in zip(key, at_key))).select("x").first()
        tried = [*centers]
        tried[at] = (label, *at_key, list(row.x))
        new = base.join(state, key).withColumn("__d", own(F.col("x"), vector(list(row.x))))
        closer, lost = F.col("__d") < F.col("distance"), F.col("state") == label
        new = new.withColumn("__n", nearest([c[-1] for c in tried], metric, F.when(lost & ~closer, F.col("x"))))
        new = new.select(
            *key,
            F.when(closer, F.lit(label)).when(lost, F.col("__n.state")).otherwise(F.col("state")).alias("state"),
            F.when(closer, F.col("__d")).when(lost, F.col("__n.distance")).otherwise(F.col("distance")).alias("distance"),
        )
        if (tried_cost := mean_square(new)) < cost:
            state, cost, centers = bucketed(new, "medoids", key), tried_cost, tried
    return ClusterResult(state, _centers(spark, centers, key, kinds))


def kmedoids(frames: DataFrame, metric: str | metrics.Metric = "euclidean", n_clusters: int | None = None, n_iters: int = 5, key: list[str] = ("traj_id", "frame"), x: str = "x", start: ClusterResult | None = None, proposals: list[dict[int, tuple]] | None = None, seed: int = 0) -> ClusterResult:
    """Medoids refined by sweeps, from a given result or from frames drawn by hash."""
    key = list(key)
    workers_can_import(frames.sparkSession)
    base = bucketed(frames.select(*key, F.col(x).cast("array<double>").alias("x")), "vectors", key)
    if start is None:
        if not n_clusters:
            raise ImproperlyConfigured("needs a number of clusters or a start")
        drawn = base.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n_clusters).collect()
        rows = [(k, *(r[c] for c in key), list(r.x)) for k, r in enumerate(drawn)]
        own = assign_to_nearest_center(base, [r[-1] for r in rows], metric)
        start = ClusterResult(own.select(*key, "state", "distance"), _centers(base.sparkSession, rows, key, dict(base.dtypes)))
    for k in range(n_iters):
        start = pam_sweep(base, start, metric, key, proposals[k] if proposals else None, seed + k)
    return start


def hybrid(frames: DataFrame, metric: str | metrics.Metric = "euclidean", n_iters: int = 5, n_clusters: float = float("inf"), dist_cutoff: float = 0.0, key: list[str] = ("traj_id", "frame"), x: str = "x", proposals: list[dict[int, tuple]] | None = None, seed: int = 0, **options) -> ClusterResult:
    """Farthest-point centres, then sweeps."""
    first = kcenters(frames, metric, n_clusters, dist_cutoff, key, x, **options)
    return first if n_iters == 0 else kmedoids(frames, metric, None, n_iters, key, x, first, proposals, seed)


class _Clusterer:
    def __init__(self, metric: str | metrics.Metric, n_clusters: float | None = None, cluster_radius: float | None = None, key: list[str] = ("traj_id", "frame"), x: str = "x", **options):
        if n_clusters is None and cluster_radius is None and not isinstance(self, KMedoids):
            raise ImproperlyConfigured("needs n_clusters or cluster_radius")
        self.metric, self.n_clusters, self.cluster_radius, self.key, self.x, self.options = metric, n_clusters, cluster_radius, list(key), x, options
        self.result_: ClusterResult | None = None

    def _fitted(self) -> ClusterResult:
        if self.result_ is None:
            raise ImproperlyConfigured("the clusterer isn't fitted")
        return self.result_

    def predict(self, frames: DataFrame) -> ClusterResult:
        return predict(frames, self._fitted().centers, self.metric, self.key, self.x)

    @property
    def labels_(self) -> DataFrame:
        return self._fitted().assignments.select(*self.key, "state")

    @property
    def distances_(self) -> DataFrame:
        return self._fitted().assignments.select(*self.key, "distance")

    @property
    def center_indices_(self) -> DataFrame:
        return self._fitted().centers.select("state", *self.key)

    @property
    def centers_(self) -> DataFrame:
        return self._fitted().centers


class KCenters(_Clusterer):
    def fit(self, frames: DataFrame, init_centers: list[list[float]] | None = None) -> KCenters:
        self.result_ = kcenters(frames, self.metric, self.n_clusters or float("inf"), self.cluster_radius or 0.0, self.key, self.x, init_centers, **self.options)
        return self


class KMedoids(_Clusterer):
    def fit(self, frames: DataFrame, start: ClusterResult | None = None) -> KMedoids:
        self.result_ = kmedoids(frames, self.metric, self.n_clusters, key=self.key, x=self.x, start=start, **self.options)
        return self


class KHybrid(_Clusterer):
    def fit(self, frames: DataFrame, init_centers: list[list[float]] | None = None) -> KHybrid:
        self.result_ = hybrid(frames, self.metric, n_clusters=self.n_clusters or float("inf"), dist_cutoff=self.cluster_radius or 0.0, key=self.key, x=self.x, init_centers=init_centers, **self.options)
        return self


def reassign(frames: DataFrame, centers: DataFrame, metric: str | metrics.Metric = "rmsd", x: str = "x") -> DataFrame:
    """All frames to their nearest centre. Spark's partitions bound the memory; there is no batch size to choose."""
    return assign_to_nearest_center(frames, centers, metric, x)


def pick_states(assignments: DataFrame, key: list[str], n_confs: int = 1, largest: float = float("inf"), seed: int = 0, states: list[int] | None = None) -> DataFrame:
    """state, rank, key..., distance: the frame nearest to each centre, then frames drawn by hash, within -0.1 < distance < largest."""
    own = assignments.where((F.col("distance") > -0.1) & (F.col("distance") < largest) & (F.col("state") != -1))
    own = own if states is None else own.where(F.col("state").isin(states))
    best = find_cluster_centers(own, key).withColumn("rank", F.lit(0))
    if n_confs == 1:
        return best.select("state", "rank", *key, "distance")
    others = own.join(best.select("state", *key), ["state", *key], "left_anti")
    w = Window.partitionBy("state").orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    others = others.withColumn("rank", F.row_number().over(w)).where(F.col("rank") < n_confs)
    return best.select("state", "rank", *key, "distance").unionByName(others.select("state", "rank", *key, "distance"))
