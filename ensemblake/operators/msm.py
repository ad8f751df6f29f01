"""Markov state models: builders, trimming, spectra, coarse-graining, and the estimator."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..exceptions import DataInvalid, ImproperlyConfigured
from ..functions import linalg
from ..plans.shared import sized, written
from . import sparse
from .counts import assigns_to_counts, counts_by_lag

#: So many eigenvalues at most come from block iterations on the edge table; all of a larger matrix, from a dense one of a checked size.
LEADING = 40


def with_prior(counts: DataFrame, prior: float | DataFrame | None, n_states: int | None = None) -> DataFrame:
    """Counts with a pseudocount, or a table of them, added to every cell of the n x n grid."""
    if prior is None:
        return counts
    if isinstance(prior, DataFrame):
        return counts.unionByName(prior.select("i", "j", F.col("v").cast("double"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
    n = linalg.few_states(n_states or state_count(counts))
    side = counts.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    grid = side.crossJoin(side.withColumnRenamed("i", "j"))
    return grid.join(counts, ["i", "j"], "left").select("i", "j", (F.coalesce("v", F.lit(0.0)) + F.lit(float(prior))).alias("v"))


def state_count(matrix: DataFrame) -> int:
    top = matrix.agg(F.max(F.greatest("i", "j"))).first()[0]
    return 0 if top is None else int(top) + 1


def row_normalize(counts: DataFrame) -> DataFrame:
    """Cells over their row's sum; rows that sum to 0 stay 0. Row sums are aggregated, so a full row is never sorted."""
    total = counts.groupBy("i").agg(F.sum("v").alias("__row"))
    return counts.join(total, "i").select("i", "j", F.when(F.col("__row") > 0, F.col("v") / F.col("__row")).otherwise(0.0).alias("v"))


def symmetrized(counts: DataFrame) -> DataFrame:
    return counts.select("i", "j", "v").unionByName(counts.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def row_shares(counts: DataFrame) -> DataFrame:
    """(i, v): row sums over the total."""
    rows = counts.groupBy("i").agg(F.sum("v").alias("s"))
    total = rows.agg(F.sum("s").alias("__all"))
    return rows.crossJoin(F.broadcast(total)).select("i", (F.col("s") / F.col("__all")).alias("v"))


Model = tuple[DataFrame, DataFrame, DataFrame | None]


def normalize(counts: DataFrame, prior_counts: float | DataFrame | None = None, calculate_eq_probs: bool = True, n_states: int | None = None) -> Model:
    """(counts, T, populations): rows over their sums; populations from the left eigenvector."""
    counts = with_prior(counts, prior_counts, n_states)
    t = row_normalize(counts)
    return counts, t, eq_probs(t, n_states) if calculate_eq_probs else None


def transpose(counts: DataFrame, prior_counts: float | DataFrame | None = None, calculate_eq_probs: bool = True, n_states: int | None = None) -> Model:
    """(counts, T, populations) of the counts averaged with their transpose; populations are its row sums' shares."""
    both = symmetrized(with_prior(counts, prior_counts, n_states))
    return both.withColumn("v", F.col("v") / 2), row_normalize(both), row_shares(both) if calculate_eq_probs else None


def mle(counts: DataFrame, prior_counts: float | DataFrame | None = None, calculate_eq_probs: bool = True, n_states: int | None = None) -> Model:
    """(counts, T, populations) of the most likely reversible model."""
    counts = with_prior(counts, prior_counts, n_states)
    t, pi = sparse.reversible_mle(counts, n_states)
    return counts, t, pi if calculate_eq_probs else None


BUILDERS: dict[str, Callable[..., Model]] = {"normalize": normalize, "transpose": transpose, "mle": mle}


def builder(method: str | Callable[..., Model]) -> Callable[..., Model]:
    if callable(method):
        return method
    if method not in BUILDERS:
        raise ImproperlyConfigured(f"unknown builder {method!r}; there are {', '.join(BUILDERS)}")
    return BUILDERS[method]


def eigenspectrum(t: DataFrame, n_eigs: int | None = None, left: bool = True, n_states: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling real part, and their vectors as columns of an array; the first sums to 1. Up to LEADING of them come from the edge table alone."""
    n = n_states or state_count(t)
    k = n if n_eigs is None else n_eigs
    if k < 2:
        raise ValueError("at least two eigenvalues")
    if k > LEADING:
        return linalg.eigenspectrum(linalg.gather(t, n), n_eigs, left)
    values, vectors = sparse.leading_spectrum(t, k, left, n)
    out = np.zeros((linalg.few_states(n), len(values)))
    for i, j, v in vectors.select("i", "k", "v").collect():
        out[i, j] = v
    return values, out


def eq_probs(t: DataFrame, n_states: int | None = None) -> DataFrame:
    """(i, v): the left vector of eigenvalue 1, with sum 1. Beyond what fits a dense matrix, from the edge table."""
    n = n_states or state_count(t)
    if n > linalg.MOST_STATES:
        return sparse.leading_spectrum(t, 1, n_states=n)[1].select("i", "v")
    return linalg.scatter(t.sparkSession, linalg.stationary(linalg.gather(t, n)))


def power_iteration(t: DataFrame, n_states: int, steps: int) -> DataFrame:
    """(i, v): uniform populations after so many steps of T. Each step is a join on the row and a sum by column."""
    p = t.sparkSession.range(n_states).select(F.col("id").cast("int").alias("i"), F.lit(1.0 / n_states).alias("v"))
    for _ in range(steps):
        p = step(p, t)
    return p


def step(p: DataFrame, t: DataFrame) -> DataFrame:
    both = t.select("i", "j", F.col("v").alias("t")).join(p, "i")
    return both.groupBy(F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("t")).alias("v"))


def trim_disconnected(counts: DataFrame, threshold: float = 1, renumber_states: bool = True, n_states: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mapping (original, mapped), counts) of the strongly connected part with the largest row sums.

    Parts are those of counts at or above the threshold; sums are of all counts; ties go to the smallest state. Kept states are numbered from 0, or keep their numbers.
    """
    counts = counts.select("i", "j", "v")
    states = counts.select("i").union(counts.select("j")).distinct()
    if threshold <= 0:  # cells that aren't there count too
        kept = counts.sparkSession.range(n_states or state_count(counts)).select(F.col("id").cast("int").alias("i"))
    else:
        part = sparse.strong_components(counts.where(F.col("v") >= threshold)).withColumnRenamed("state", "i")
        labels = written(states.join(part, "i", "left").select("i", F.coalesce("component", "i").alias("part")), "parts")
        rows = counts.groupBy("i").agg(F.sum("v").alias("w"))
        weight = labels.join(rows, "i", "left").groupBy("part").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("w"))
        top = weight.orderBy(F.col("w").desc(), "part").first()
        kept = labels.where(F.col("part") == (top.part if top else -1)).select("i")
    mapping = sparse.numbered(kept) if renumber_states else kept.select(F.col("i").cast("int").alias("original"), F.col("i").cast("int").alias("mapped"))
    mapping = written(mapping, "mapping")
    return mapping, apply_mapping(counts, mapping)


def apply_mapping(matrix: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells between kept states, under their new numbers."""
    rows, cols = mapping.toDF("i", "__i"), mapping.toDF("j", "__j")
    return matrix.join(sized(rows), "i").join(sized(cols), "j").select(F.col("__i").alias("i"), F.col("__j").alias("j"), "v")


class TrimMapping:
    """Kept states and their new numbers, a table (original, mapped)."""

    def __init__(self, df: DataFrame):
        self.df = df.select(F.col("original").cast("int"), F.col("mapped").cast("int"))

    @classmethod
    def of(cls, spark: SparkSession, pairs: list[tuple[int, int]]) -> TrimMapping:
        return cls(spark.createDataFrame(pairs, "original int, mapped int"))

    @property
    def to_mapped(self) -> dict[int, int]:
        return {r.original: r.mapped for r in self.df.collect()}

    @property
    def to_original(self) -> dict[int, int]:
        return {r.mapped: r.original for r in self.df.collect()}

    def __eq__(self, other: object) -> bool:
        pairs = set(other.to_mapped.items()) if isinstance(other, TrimMapping) else set(other)
        return set(self.to_mapped.items()) == pairs

    __hash__ = None

    def save(self, path: str) -> None:
        self.df.orderBy("original").coalesce(1).write.mode("overwrite").csv(path, header=True)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrimMapping:
        df = spark.read.csv(path, header=True, inferSchema=True)
        if df.columns != ["original", "mapped"]:
            raise DataInvalid(f"columns {df.columns} aren't original, mapped")
        return cls(df)


def timescales_of(t: DataFrame, lag_time: int, n_times: int, n_states: int) -> np.ndarray:
    """-lag / ln of the eigenvalues after the first."""
    values = eigenspectrum(t, n_times + 1, n_states=n_states)[0][1:] if n_times + 1 > LEADING else sparse.leading_spectrum(t, n_times + 1, n_states=n_states)[0][1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        return -lag_time / np.log(values)


def implied_timescales(assigns: DataFrame, lag_times: list[int], method: str | Callable[..., Model] = "normalize", n_times: int | None = None, sliding_window: bool = True, trim: bool = False, prior: bool = False) -> DataFrame:
    """(lag, k, timescale), k from 0: all lags are counted in one job; each lag's matrix stays a table of cells.

    prior: a pseudocount of one over the number of states in every cell first.
    """
    spark = assigns.sparkSession
    counts = written(counts_by_lag(assigns, lag_times, sliding_window), "lags")
    n = state_count(counts)
    n_times = min(n // 10 + 1 if n_times is None else n_times, n - 1)
    out = []
    for lag in lag_times:
        own, size = counts.where(F.col("lag") == lag).select("i", "j", "v"), n
        if trim:
            mapping, own = trim_disconnected(own, n_states=n)
            size = mapping.count()
        t = builder(method)(own, 1.0 / size if prior else None, False, size)[1]
        out += [(int(lag), k, float(x)) for k, x in enumerate(timescales_of(t, lag, min(n_times, size - 1), size))] if size > 1 else []
    return spark.createDataFrame(out, "lag int, k int, timescale double")


class MSM:
    """counts -> optional trimming -> builder, fitted to assignments (traj_id, frame, state)."""

    def __init__(self, lag_time: int, method: str | Callable[..., Model] = "normalize", trim: bool = False, sliding_window: bool = True, max_n_states: int | None = None):
        self.lag_time, self.method, self.trim, self.sliding_window, self.max_n_states = lag_time, method, trim, sliding_window, max_n_states
        builder(method)
        self.tcounts_ = self.tprobs_ = self.eq_probs_ = self.mapping_ = None

    @classmethod
    def from_assignments(cls, assigns: DataFrame, **options) -> MSM:
        return cls(**options).fit(assigns)

    def fit(self, assigns: DataFrame) -> MSM:
        spark = assigns.sparkSession
        counts = written(assigns_to_counts(assigns, self.lag_time, self.sliding_window), "counts")
        n = self.max_n_states or state_count(counts)
        if self.trim:
            mapping, counts = trim_disconnected(counts, n_states=n)
            n = mapping.count()
        else:
            mapping = spark.range(n).select(F.col("id").cast("int").alias("original"), F.col("id").cast("int").alias("mapped"))
        self.mapping_ = TrimMapping(mapping)
        self.tcounts_, self.tprobs_, self.eq_probs_ = builder(self.method)(counts, n_states=n)
        self._n = n
        return self

    @property
    def n_states_(self) -> int:
        if self.tprobs_ is None:
            raise ImproperlyConfigured("the model isn't fitted")
        return self._n

    @property
    def config(self) -> dict:
        return {"lag_time": self.lag_time, "method": self.method if isinstance(self.method, str) else self.method.__name__, "trim": self.trim, "sliding_window": self.sliding_window, "max_n_states": self.max_n_states}

    @property
    def result_(self) -> dict:
        self.n_states_  # noqa: B018
        return {"tcounts_": self.tcounts_, "tprobs_": self.tprobs_, "eq_probs_": self.eq_probs_, "mapping_": self.mapping_}

    def __eq__(self, other: object) -> bool:
        n = self.n_states_
        if not isinstance(other, MSM) or self.config != other.config or n != other.n_states_ or self.mapping_ != other.mapping_:
            return False
        same = all(np.array_equal(linalg.gather(getattr(self, k), n), linalg.gather(getattr(other, k), n)) for k in ("tcounts_", "tprobs_"))
        return same and np.allclose(linalg.gather_vector(self.eq_probs_, n), linalg.gather_vector(other.eq_probs_, n))

    __hash__ = None

    def __repr__(self) -> str:
        return f"MSM({', '.join(f'{k}={v!r}' for k, v in self.config.items())})"

    def save(self, path: str, force: bool = False) -> None:
        """A folder of Parquet tables and a manifest, by Spark's writers alone."""
        mode = "overwrite" if force else "error"
        self.tcounts_.write.mode(mode).parquet(f"{path}/tcounts")
        self.tprobs_.write.mode(mode).parquet(f"{path}/tprobs")
        self.eq_probs_.write.mode(mode).parquet(f"{path}/eq_probs")
        self.mapping_.df.write.mode(mode).parquet(f"{path}/mapping")
        spark = self.tcounts_.sparkSession
        spark.createDataFrame([(json.dumps(self.config | {"n": self._n}),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MSM:
        config = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        n = config.pop("n")
        out = cls(**config)
        out.tcounts_, out.tprobs_, out.eq_probs_ = (spark.read.parquet(f"{path}/{x}") for x in ("tcounts", "tprobs", "eq_probs"))
        out.mapping_, out._n = TrimMapping(spark.read.parquet(f"{path}/mapping")), n
        return out


def pseudo_scores(counts: DataFrame, n_states: int | None = None) -> DataFrame:
    """(i, v): log Bayes factor of each state against a state of pseudocounts alone. A sum by row over the whole grid."""
    n = n_states or state_count(counts)
    grid = with_prior(counts, 1.0 / n, n)
    w = grid.groupBy("i").agg(F.sum("v").alias("w"))
    both = grid.join(w, "i")
    flat = F.lit(1.0 / n)
    shared = (F.col("v") + flat) / (F.col("w") + 1)
    term = flat * F.ln(flat / shared) + F.col("v") * F.ln(F.col("v") / F.col("w") / shared)
    return both.groupBy("i").agg(F.sum(term).alias("v"))


def pair_scores(counts: DataFrame, n_states: int | None = None, least: float = 1) -> DataFrame:
    """(i, j, v): log Bayes factors of merging linked states i < j (more than `least` counts): their rows meet by column."""
    n = n_states or state_count(counts)
    grid = with_prior(counts, 1.0 / n, n)
    rows = grid.join(grid.groupBy("i").agg(F.sum("v").alias("w")), "i")
    pairs = counts.where((F.col("v") > least) & (F.col("i") != F.col("j"))).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    a = rows.select("i", F.col("j").alias("k"), F.col("v").alias("va"), F.col("w").alias("wa"))
    b = rows.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("vb"), F.col("w").alias("wb"))
    both = pairs.join(a, "i").join(b, ["j", "k"])
    shared = (F.col("va") + F.col("vb")) / (F.col("wa") + F.col("wb"))
    term = F.col("va") * F.ln(F.col("va") / F.col("wa") / shared) + F.col("vb") * F.ln(F.col("vb") / F.col("wb") / shared)
    return both.groupBy("i", "j").agg(F.sum(term).alias("v"))


def absorb(c: np.ndarray, states: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts with each listed state merged into the state it goes to most, and a label for every state (-1: an empty row)."""
    c, label = c.astype(float).copy(), np.arange(len(c))
    for s in states:
        own, c[s, s] = c[s, s], 0
        if not c[s].any():
            if own:
                raise DataInvalid(f"state {s} has no neighbour to go to")
            label[s] = -1
            continue
        to = int(c[s].argmax())
        c[to] += c[s]
        c[:, to] += c[:, s]
        c[to, to] += own
        c[s], c[:, s] = 0, 0
        gone = label[s]
        label = np.where(label >= gone, label - 1, label)
        label[s] = label[to]
    return c, label


def bayesian_prune(counts: DataFrame | np.ndarray, factor: float = float(np.log(3))) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, labels, kept states): states whose evidence against pseudocounts is under the factor are absorbed."""
    c = counts if isinstance(counts, np.ndarray) else linalg.gather(counts)
    n = len(c)
    v, flat = c + 1.0 / n, 1.0 / n
    w = v.sum(axis=1, keepdims=True)
    shared = (v + flat) / (w + 1)
    score = (flat * np.log(flat / shared) + v * np.log(v / w / shared)).sum(axis=1)
    return (*absorb(c, np.flatnonzero(score < factor).tolist()), np.flatnonzero(score >= factor))


def _xlogx(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.where(v > 0, v, 1))


class Mergers:
    """Linked pairs of states with what their merger loses, kept up from merger to merger.

    With g(v) = v ln v, rows a, b of sums w and r = a + b, a loss is the sum of g(a) + g(b) - g(r) over columns, less g(w_a) + g(w_b) - g(w_a + w_b). A merger
    replaces two columns by one: every pair's sum changes by three terms, and only the pairs of the merged state are made anew.
    """

    def __init__(self, c: np.ndarray):
        self.c, self.alive = c, np.ones(len(c), bool)
        self.w, self.s = c.sum(axis=1), _xlogx(c).sum(axis=1)
        self.p, self.q = np.nonzero(np.triu(np.maximum(c, c.T) > 1, 1))
        self.j = np.concatenate([np.zeros(0), *(_xlogx(c[self.p[k : k + 1000]] + c[self.q[k : k + 1000]]).sum(axis=1) for k in range(0, len(self.p), 1000))])

    def loss(self, x: int, y: int) -> float:
        """From both rows as they are."""
        a, b = self.c[x, self.alive], self.c[y, self.alive]
        wa, wb = a.sum(), b.sum()
        shared = (a + b) / (wa + wb)
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(np.nansum(a * np.log(a / wa / shared)) + np.nansum(b * np.log(b / wb / shared)))

    def best(self) -> tuple[float, int, int] | None:
        """(loss, x, y) of the least loss, ties to the smallest pair: what is least but for rounding is computed again."""
        if not len(self.p):
            return None
        w = self.w
        kept = self.s[self.p] + self.s[self.q] - self.j - _xlogx(w[self.p]) - _xlogx(w[self.q]) + _xlogx(w[self.p] + w[self.q])
        near = np.flatnonzero(kept <= kept.min() + 1e-10 * (1 + np.abs(self.j).max()))
        return min((self.loss(x, y), x, y) for x, y in zip(self.p[near].tolist(), self.q[near].tolist(), strict=True))

    def merge(self, x: int, y: int) -> None:
        """y goes into x."""
        c, p, q = self.c, self.p, self.q
        self.j -= _xlogx(c[p, x] + c[q, x]) + _xlogx(c[p, y] + c[q, y])
        self.s -= _xlogx(c[:, x]) + _xlogx(c[:, y])
        c[x] += c[y]
        c[:, x] += c[:, y]
        c[y], c[:, y] = 0, 0
        self.alive[y] = False
        self.j += _xlogx(c[p, x] + c[q, x])
        self.s += _xlogx(c[:, x])
        self.s[x], self.w[x], self.s[y], self.w[y] = _xlogx(c[x]).sum(), c[x].sum(), 0, 0
        stay = (p != x) & (q != x) & (p != y) & (q != y)
        others = np.flatnonzero((np.maximum(c[x], c[:, x]) > 1) & (np.arange(len(c)) != x))
        self.p = np.concatenate((p[stay], np.minimum(others, x)))
        self.q = np.concatenate((q[stay], np.maximum(others, x)))
        self.j = np.concatenate((self.j[stay], _xlogx(c[others] + c[x]).sum(axis=1)))


def bace(counts: DataFrame | np.ndarray, n_macrostates: int) -> tuple[dict[int, float], dict[int, np.ndarray]]:
    """(log Bayes factors, labels) by number of macrostates: the pair of linked states whose merger loses least, again and again."""
    c, label, kept = bayesian_prune(counts)
    own = Mergers(c[np.ix_(kept, kept)] + 1.0 / len(c))
    factors, labels = {}, {}
    left = len(kept)
    while left > n_macrostates and (found := own.best()):
        loss, x, y = found
        factors[left - 1] = loss
        own.merge(x, y)
        gone, to = label[kept[y]], label[kept[x]]
        label = np.where(label == gone, to, label)
        label = np.where(label > gone, label - 1, label)
        left -= 1
        labels[left] = label.copy()
    return factors, labels


def synthetic_ensemble(t: DataFrame, initial: DataFrame, n_steps: int, observable: DataFrame | None = None) -> DataFrame:
    """(t, i, p) populations from step 0 on; with an observable (i, v): (t, value), its mean."""
    p = initial.select("i", F.col("v").cast("double").alias("v"))
    out = p.select(F.lit(0).alias("t"), "i", F.col("v").alias("p"))
    for k in range(1, n_steps):
        p = step(p, t)
        out = out.unionByName(p.select(F.lit(k).alias("t"), "i", F.col("v").alias("p")))
    if observable is None:
        return out
    return out.join(observable.select("i", F.col("v").alias("o")), "i").groupBy("t").agg(F.sum(F.col("p") * F.col("o")).alias("value"))


