"""Operators on models kept as edge tables (i, j, v): strong components, leading spectra, reversible likelihood, widest paths. No n x n array is ever made.

Iterations carry a row a state, and are written to the shared folder. Where edges are counted to be at most FEW, one task runs the rounds over them as flat
arrays, with the same result: rounds of near-empty jobs take longer than the work.
"""

from __future__ import annotations

import heapq
import warnings
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..exceptions import ConvergenceWarning, DataInvalid
from ..plans.shared import workers_can_import, written
from .graph import components

FEW = 100_000
BLOCK = 1 << 16


def alone(rows: DataFrame, work: Callable[..., list], schema: str) -> DataFrame:
    """What work makes of the columns of rows, of which there are few, in one task."""
    workers_can_import(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = list(batches)
        if all_rows:
            table = pa.Table.from_batches(all_rows)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in work(*(c.to_numpy() for c in table.columns))], names=names)

    return rows.coalesce(1).mapInArrow(run, schema)


# --- strong components ---------------------------------------------------------------------------------------------


def tarjan(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, label) of states on edges, labels equal where states reach each other: depth first, with a stack of its own."""
    names, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    order = np.argsort(a, kind="stable")
    to, first = b[order].tolist(), np.searchsorted(a[order], np.arange(len(names) + 1)).tolist()
    n = len(names)
    index, low, label, stack, count = [-1] * n, [0] * n, [-1] * n, [], 0
    nxt = first[:-1].copy()
    for root in range(n):
        if index[root] >= 0:
            continue
        walk = [root]
        while walk:
            v = walk[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
            if nxt[v] < first[v + 1]:
                w = to[nxt[v]]
                nxt[v] += 1
                if index[w] < 0:
                    walk.append(w)
                elif label[w] < 0:
                    low[v] = min(low[v], index[w])
                continue
            walk.pop()
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[v])
            if low[v] == index[v]:
                while True:
                    w = stack.pop()
                    label[w] = v
                    if w == v:
                        break
    return names, names[np.array(label, np.int64)]


def _moved(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with states renamed by moves (state, into), without loops and repetitions."""
    a, b = moves.toDF("i", "__i"), moves.toDF("j", "__j")
    out = edges.join(a, "i", "left").join(b, "j", "left")
    return out.select(F.coalesce("__i", "i").alias("i"), F.coalesce("__j", "j").alias("j")).where("i <> j").distinct()


def _mutual(edges: DataFrame) -> DataFrame:
    """(state, into): states with edges both ways are of one component, and so are chains of them."""
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"))
    links = written(edges.where("i < j").join(back, ["i", "j"], "left_semi").select(F.col("i").alias("a"), F.col("j").alias("b")), "mutual")
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    return written(components(links, nodes).where("id <> component").select(F.col("id").alias("state"), F.col("component").alias("into")), "moves")


def _raked(edges: DataFrame) -> DataFrame:
    """Edges without states that nothing comes to or goes from; those are alone."""
    ins, outs = edges.select(F.col("j").alias("i")).distinct(), edges.select(F.col("i").alias("j")).distinct()
    return edges.join(ins, "i", "left_semi").join(outs, "j", "left_semi").select("i", "j")


def _single(edges: DataFrame, salt: int) -> DataFrame:
    """(state, into): states with one edge out, chosen by coins so that none goes into another of them."""
    only = edges.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.min("j").alias("into")).where("n = 1").select(F.col("i").alias("state"), "into")
    coin = only.where(F.xxhash64("state", F.lit(salt)) % 2 == 0)
    return coin.join(coin.select(F.col("state").alias("into")), "into", "left_anti").select("state", "into")


def strong_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(state, component): of states in a component of two or more, its smallest state; other states are components of their own and have no row.

    edges: (i, j); loops and repetitions don't matter. The graph is made smaller until few edges are left, which one task finishes: states linked both ways
    are joined at once; states without edges in or out go; a state with a single edge out gives its edges in to where that leads, and the same backwards. It is
    of that state's component if, in the end, one of those it gave away is, so a long chain is halved in a round instead of walked along. Where none of
    this helps any more, colours spread forwards, and from each colour's own state backwards, by the edges of states that changed.
    """
    now = written(edges.select("i", "j").where("i <> j").distinct(), "edges")
    log: list[tuple[str, DataFrame]] = []
    size, turn = now.count(), 0
    while size > few:
        before = size
        moves = _mutual(now)
        if not moves.isEmpty():
            log.append(("same", moves))
            now = _moved(now, moves)
        now = written(_raked(_raked(now)), "raked")
        for flip in (False, True):
            turn += 1
            here = now.select(F.col("j").alias("i"), F.col("i").alias("j")) if flip else now
            chosen = written(_single(here, turn), "single")
            if chosen.isEmpty():
                continue
            log.append(("maybe", written(here.join(chosen.select(F.col("state").alias("j"), "into"), "j").select(F.col("i").alias("other"), F.col("j").alias("state"), "into"), "given")))
            rest = _moved(here.join(chosen.select(F.col("state").alias("i")), "i", "left_anti"), chosen)
            now = written(rest.select(F.col("j").alias("i"), F.col("i").alias("j")) if flip else rest, "compressed")
        size = now.count()
        if size > 0.9 * before and size > few:
            whole, now = _coloured(now)
            log.append(("same", whole))
            size = now.count()
    labels = written(alone(now, lambda i, j: [x.astype(np.int64) for x in tarjan(i, j)], "state long, label long").where("state <> label"), "labels")
    for kind, rows in reversed(log):
        known = labels.select(F.col("state").alias("into"), F.col("label").alias("__into"))
        own = rows.join(known, "into", "left").withColumn("to", F.coalesce("__into", F.col("into").cast("long")))
        if kind == "maybe":
            others = labels.select(F.col("state").alias("other"), F.col("label").alias("__other"))
            own = own.join(others, "other", "left").where(F.coalesce("__other", F.col("other").cast("long")) == F.col("to"))
        labels = written(labels.unionByName(own.select(F.col("state").cast("long").alias("state"), F.col("to").alias("label")).distinct()), "labels")
    every = labels.unionByName(labels.select(F.col("label").alias("state"), "label")).distinct()
    least = every.groupBy("label").agg(F.min("state").alias("component"))
    kind = edges.schema["i"].dataType
    return every.join(least, "label").select(F.col("state").cast(kind).alias("state"), F.col("component").cast(kind).alias("component"))


def _spread(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, c): the largest c of all states that reach a state; only states whose c grew hand it on."""
    front = state
    while True:
        told = edges.join(front, "i").groupBy(F.col("j").alias("i")).agg(F.max("c").alias("__c"))
        state = written(state.join(told, "i", "left").select("i", F.greatest("c", "__c").alias("c"), (F.col("__c") > F.col("c")).alias("grew")), "colours")
        front = state.where("grew").select("i", "c")
        state = state.select("i", "c")
        if front.isEmpty():
            return state


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((state, into) of whole components, edges without their states): a state that no larger one reaches, and all of its colour that reach it."""
    states = edges.select("i").union(edges.select("j")).distinct()
    colour = _spread(states.select("i", F.col("i").alias("c")), edges)
    same = edges.join(colour, "i").join(colour.toDF("j", "__c"), "j").where(F.col("c") == F.col("__c")).select(F.col("j").alias("i"), F.col("i").alias("j"), "c")
    same = written(same, "one-colour")
    back = front = written(colour.where("i = c").select("i"), "roots")
    while not front.isEmpty():
        front = written(same.join(front, "i", "left_semi").select(F.col("j").alias("i")).distinct().join(back, "i", "left_anti"), "front")
        back = written(back.unionByName(front), "back")
    whole = written(back.join(colour, "i").select(F.col("i").alias("state"), F.col("c").alias("into")), "whole")
    gone = back.select("i")
    rest = edges.join(gone, "i", "left_anti").join(gone.withColumnRenamed("i", "j"), "j", "left_anti").select("i", "j")
    return whole.where("state <> into"), written(rest, "rest")


def numbered(states: DataFrame) -> DataFrame:
    """(original, mapped): states (i) numbered from 0 in order; places are counted by blocks first, so no window sees all states."""
    block = F.floor(F.col("i") / BLOCK)
    sizes = states.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))
    own = states.withColumn("b", block).withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("i")) - 1)
    return own.join(before, "b").select(F.col("i").cast("int").alias("original"), (F.col("k") + F.col("before")).cast("int").alias("mapped"))


# --- leading spectrum ----------------------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


class Flat:
    """Columns q over states 0 .. n - 1, and a block w that is to follow them, as arrays in a task; edges a -> b of weight t."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, t: np.ndarray, p: int):
        self.n, self.a, self.b, self.t = n, a, b, t
        self.q, self.w = np.zeros((n, 0)), np.random.default_rng(1).uniform(-1, 1, (n, p))
        self.w[:, 0] = 1

    def multiply(self, m: int, b: int) -> None:
        self.w = np.stack([np.bincount(self.b, self.t * self.q[self.a, c], self.n) for c in range(m - b, m)], axis=1)

    def gram(self, less: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (self.w - self.q @ less) @ turn
        return self.q.T @ w, w.T @ w

    def extend(self, less: np.ndarray, turn: np.ndarray) -> None:
        self.q = np.hstack((self.q, (self.w - self.q @ less) @ turn))

    def turn(self, turn: np.ndarray) -> None:
        self.q = self.q[:, : len(turn)] @ turn


class Rows:
    """As Flat, with a row (i, q, w) a state. Products of columns are sums over rows; only a multiplication shuffles."""

    def __init__(self, edges: DataFrame, n: int, p: int):
        self.edges, self.p = edges, p
        start = [F.lit(1.0), *(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1 for c in range(1, p))]
        self.rows = written(edges.sparkSession.range(n).select(F.col("id").cast("int").alias("i"), F.array().cast("array<double>").alias("q"), F.array(*start).alias("w")), "start")

    def multiply(self, m: int, b: int) -> None:
        q = self.rows.select("i", "q")
        last = q.select(F.col("i").alias("a"), F.slice("q", m - b + 1, b).alias("x"))
        made = self.edges.join(last, "a").groupBy(F.col("b").alias("i")).agg(*(F.sum(F.col("t") * F.col("x")[c]).alias(f"c{c}") for c in range(b)))
        self.rows = written(q.join(made, "i", "left").select("i", "q", F.array(*(F.coalesce(f"c{c}", F.lit(0.0)) for c in range(b))).alias("w")), "step")

    def gram(self, less: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(q'w, w'w) of (w - q less) turn for w; as many numbers as columns have products reach the driver."""
        m, p = len(less), turn.shape[1]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((m + p, p))
            for batch in batches:
                if batch.num_rows:
                    q, w = _matrix(batch.column(0)), _matrix(batch.column(1))
                    w = (w - q @ less) @ turn
                    total += np.hstack((q, w)).T @ w
            a, b = (x.ravel() for x in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total.ravel())], names=["a", "b", "v"])

        out = np.zeros((m + p, p))
        for a, b, v in self.rows.select("q", "w").mapInArrow(sums, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v")).collect():
            out[a, b] = v
        return out[:m], out[m:]

    def _map(self, make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = make(_matrix(batch.column(1)), _matrix(batch.column(2)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows)], names=["i", "q"])

        rows = self.rows if "w" in self.rows.columns else self.rows.withColumn("w", F.array().cast("array<double>"))
        self.rows = written(rows.mapInArrow(work, "i int, q array<double>"), "basis")

    def extend(self, less: np.ndarray, turn: np.ndarray) -> None:
        self._map(lambda q, w: np.hstack((q, (w - q @ less) @ turn)))

    def turn(self, turn: np.ndarray) -> None:
        self._map(lambda q, w: q[:, : len(turn)] @ turn)


def _basis(gram: np.ndarray, least: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(turn, r) with w turn orthonormal and w = (w turn) r, without directions whose length is next to nothing."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = np.sqrt(np.maximum(values, 0)) > least
    length = np.sqrt(values[keep])
    return vectors[:, keep] / length, (vectors[:, keep] * length).T


def _arnoldi(basis: Flat | Rows, k: int, p: int, size: int, tol: float, most: int) -> tuple[np.ndarray, float]:
    """Eigenvalues, and the largest residual that is left; the basis' columns become their vectors, real parts."""
    less, same = np.zeros((0, p)), np.eye(p)
    turn, _ = _basis(basis.gram(less, same)[1])
    basis.extend(less, turn)
    first = turn.shape[1]
    for again in range(most):
        m, b, h = first, first, np.zeros((0, 0))
        while True:
            basis.multiply(m, b)
            # What the columns have of w is taken out twice, and what is left is made orthonormal twice: of short rests the first time leaves noise.
            once, _ = basis.gram(np.zeros((m, b)), np.eye(b))
            twice, gram = basis.gram(once, np.eye(b))
            turn, r = _basis(gram - twice.T @ twice)
            less = once + twice
            if len(r):
                more, gram = basis.gram(less, turn)
                last, r_last = _basis(gram - more.T @ more, 0.1)
                less, turn, r = less + more @ r, turn @ last, r_last @ r
            grown = np.zeros((m + len(r), m))
            grown[: h.shape[0], : h.shape[1]] = h
            grown[:m, m - b :] = less
            grown[m:, m - b :] = r
            h = grown
            if not len(r) or m + len(r) > size:
                break
            basis.extend(less, turn)
            m, b = m + len(r), len(r)
        values, y = np.linalg.eig(h[:m, :m])
        order = np.argsort(-values.real, kind="stable")
        values, y = values[order], y[:, order]
        rest = float(np.linalg.norm(h[m:] @ y[:, :k], axis=0).max(initial=0)) if len(r) else 0.0
        if rest <= tol or again == most - 1:
            break
        # The leading vectors, real and imaginary parts, are the next block.
        kept, length, _ = np.linalg.svd(np.hstack((y[:, :p].real, y[:, :p].imag)), full_matrices=False)
        kept = kept[:, : min(p, int((length > 1e-9).sum()))]
        basis.turn(kept)
        first = kept.shape[1]
    basis.turn(y[:, :k].real)
    return values[:k].real, rest


def leading_spectrum(t: DataFrame, k: int, left: bool = True, n_states: int | None = None, tol: float = 1e-9, most: int = 40, few: int = FEW) -> tuple[np.ndarray, DataFrame]:
    """(the k eigenvalues of largest real part, falling; their vectors as (i, k, v), real parts, the first with sum 1).

    Block Arnoldi with restarts. A step multiplies a block of columns by the matrix, a join and a sum, and makes the result orthogonal to the columns before; rows hold a
    state's entries in all columns, so that needs no shuffle. What reaches the driver are products of columns. It ends when the residual of each
    vector is under tol, or the columns span all that the matrix makes of them; after `most` restarts with a ConvergenceWarning.
    """
    workers_can_import(t.sparkSession)
    n = n_states or (t.agg(F.max(F.greatest("i", "j"))).first()[0] or 0) + 1
    k = min(k, n)
    p = min(n, k + 2)
    edges = written(t.select(F.col("i" if left else "j").cast("int").alias("a"), F.col("j" if left else "i").cast("int").alias("b"), F.col("v").cast("double").alias("t")).where("t <> 0"), "matrix")
    if n <= few and edges.count() <= few:

        def work(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
            own = Flat(n, a, b, x, p)
            values, rest = _arnoldi(own, k, p, min(n, max(5 * p, 150)), tol, most)
            return [np.arange(n + 2, dtype=np.int32), [x.tolist() for x in (*own.q, values, np.full(k, rest))]]  # after the states' rows, values and residual

        rows = written(alone(edges, work, "i int, q array<double>"), "vectors")
        tail = {r.i: r.q for r in rows.where(F.col("i") >= n).collect()}
        values, rest, rows = np.array(tail[n]), tail[n + 1][0], rows.where(F.col("i") < n)
    else:
        own = Rows(edges, n, p)
        values, rest = _arnoldi(own, k, p, min(n, max(5 * p, 30)), tol, most)
        rows = own.rows
    if rest > tol:
        warnings.warn(f"eigenvectors still have residuals up to {rest:.1e} after {most} restarts", ConvergenceWarning, stacklevel=2)
    first = rows.agg(F.sum(F.col("q")[0])).first()[0]
    out = rows.select("i", F.posexplode("q").alias("k", "v"))
    return values, out.withColumn("v", F.when(F.col("k") == 0, F.col("v") / F.lit(float(first))).otherwise(F.col("v")))


# --- reversible likelihood -----------------------------------------------------------------------------------------


def _fixed_point(i: np.ndarray, j: np.ndarray, s: np.ndarray, c: np.ndarray, tol: float, most: int) -> list[np.ndarray]:
    names, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    rows = np.zeros(len(names))
    rows[a] = c
    x, settled = np.bincount(a, s, len(names)), False
    for _ in range(most):
        ratio = np.divide(rows, x, out=np.zeros(len(x)), where=x > 0)
        below = ratio[a] + ratio[b]
        new = np.bincount(a, np.divide(s, below, out=np.zeros(len(s)), where=below > 0), len(names))
        new *= x.sum() / new.sum() if new.sum() > 0 else 1
        settled = bool((np.abs(new - x) <= tol * x).all())
        x = new
        if settled:
            break
    return [names.astype(np.int32), x, np.full(len(names), settled)]


def reversible_mle(counts: DataFrame, n_states: int | None = None, tol: float = 1e-13, most: int = 100_000, few: int = FEW, together: int = 4) -> tuple[DataFrame, DataFrame]:
    """(T (i, j, v), populations (i, v)) of the most likely model under detailed balance.

    With s = c_ij + c_ji and row sums x_i of the flows, the flows are s / (c_i / x_i + c_j / x_j): the fixed point is one in x, a row a state. A round joins it to both
    ends of the edges and sums by row; `together` of them are written at once. It ends when no x_i changes by more than a share of tol, after `most` rounds with a ConvergenceWarning.
    """
    spark = counts.sparkSession
    own = counts.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v")).where("v <> 0")
    rows = own.groupBy("i").agg(F.sum("v").alias("c"))
    both = own.unionByName(own.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).groupBy("i", "j").agg(F.sum("v").alias("s"))
    edges = written(both.join(rows, "i", "left").select("i", "j", "s", F.coalesce("c", F.lit(0.0)).alias("c")), "flows")
    if edges.count() <= few:
        state = written(alone(edges, lambda i, j, s, c: _fixed_point(i, j, s, c, tol, most), "i int, x double, settled boolean"), "sums")
        settled = state.where("NOT settled").isEmpty()
        state = state.select("i", "x")
    else:
        state, settled, done = written(edges.groupBy("i").agg(F.sum("s").alias("x")), "sums"), False, 0
        ends = edges.select("i", "c").distinct()
        while not settled and done < most:
            was = new = state
            for _ in range(min(together, most - done)):
                was, new = new, _round(edges, ends, new)
                done += 1
            # A round keeps the sum of x but for what is still to settle, so the last two are held against each other as they are.
            both = written(new.join(was.withColumnRenamed("x", "__was"), "i"), "sums")
            settled = both.where(F.abs(F.col("x") - F.col("__was")) > F.lit(tol) * F.col("__was")).isEmpty()
            state = both.select("i", "x")
    if not settled:
        warnings.warn(f"the most likely model still changes after {most} rounds", ConvergenceWarning, stacklevel=2)
    ratio = edges.select("i", "c").distinct().join(state, "i").select("i", F.coalesce(F.try_divide("c", "x"), F.lit(0.0)).alias("r"))
    flow = _flows(edges, ratio)
    total = flow.groupBy("i").agg(F.sum("v").alias("row"))
    t = flow.join(total, "i").where("v > 0").select("i", "j", (F.col("v") / F.col("row")).alias("v"))
    every = spark.range(n_states).select(F.col("id").cast("int").alias("i")) if n_states else edges.select("i").distinct()
    whole = total.agg(F.sum("row").alias("all"))
    return t, every.join(total, "i", "left").crossJoin(F.broadcast(whole)).select("i", F.coalesce(F.try_divide("row", "all"), F.lit(0.0)).alias("v"))


def _flows(edges: DataFrame, ratio: DataFrame) -> DataFrame:
    with_ends = edges.join(ratio, "i").join(ratio.toDF("j", "__r"), "j")
    return with_ends.select("i", "j", F.coalesce(F.try_divide(F.col("s"), F.col("r") + F.col("__r")), F.lit(0.0)).alias("v"))


def _round(edges: DataFrame, ends: DataFrame, state: DataFrame) -> DataFrame:
    ratio = ends.join(state, "i").select("i", F.coalesce(F.try_divide("c", "x"), F.lit(0.0)).alias("r"))
    return _flows(edges, ratio).groupBy("i").agg(F.sum("v").alias("x"))


# --- widest paths --------------------------------------------------------------------------------------------------


def _widest(i: np.ndarray, j: np.ndarray, v: np.ndarray, sources: list[int], sinks: list[int]) -> tuple[list[int], float]:
    """Widest path over edge arrays: widths by a heap, then the shortest of the paths that are so wide, level by level."""
    out = defaultdict(list)
    for a, b, w in zip(i.tolist(), j.tolist(), v.tolist(), strict=True):
        if w > 0:
            out[a].append((b, w))
    done, heap, width, ends = set(), [(-np.inf, s) for s in sorted(sources)], 0.0, set(sinks)
    while heap:
        least, at = heapq.heappop(heap)
        if at in ends:
            width = float(-least)
            break
        if at not in done:
            done.add(at)
            for to, w in out[at]:
                heapq.heappush(heap, (max(least, -w), to))
    if not width:
        return [], 0.0
    before, level = {s: None for s in sources}, sorted(sources)
    while not (found := [s for s in level if s in ends]):
        longer: dict[int, int] = {}
        for at in level:  # in order of their paths, so the first to reach a state has the smallest one
            for to, w in out[at]:
                if w >= width and to not in before and to not in longer:
                    longer[to] = at
        rank = {s: k for k, s in enumerate(level)}
        level = sorted(longer, key=lambda s: (rank[longer[s]], s))
        before |= longer
    path = [found[0]]
    while before[path[-1]] is not None:
        path.append(before[path[-1]])
    return path[::-1], width


def widest_path(flux: DataFrame, sources: list[int], sinks: list[int], few: int = FEW) -> tuple[list[int], float]:
    """The path from a source to a sink whose least flux is largest, and that flux; none: ([], 0). Ties: fewer steps, then smaller states from the first on.

    Widths spread from the sources, from states whose width grew alone, and not beyond what a sink has already. Then, over edges that are wide enough, levels
    spread until a sink is met: a state keeps the state before it, of several the one whose own path is smallest.
    """
    if set(sources) & set(sinks):
        raise DataInvalid("a state is both source and sink")
    edges = flux.where("v > 0").select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v"))
    edges = written(edges, "fluxes")
    if edges.count() <= few:
        rows = edges.toArrow()
        return _widest(*(rows.column(c).to_numpy() for c in "ijv"), sources, sinks)
    spark = flux.sparkSession
    best = 0.0
    start = spark.createDataFrame([(int(s), float("inf")) for s in sources], "i int, w double")
    known, front = start, start
    while not front.isEmpty():
        told = edges.join(front, "i").where(F.least("v", "w") > best).groupBy(F.col("j").alias("i")).agg(F.max(F.least("v", "w")).alias("__w"))
        both = written(known.join(told, "i", "full").select("i", F.greatest("w", "__w").alias("w"), (F.col("__w") > F.coalesce("w", F.lit(0.0))).alias("grew")), "widths")
        known, front = both.select("i", "w"), both.where("grew").select("i", "w")
        best = max(best, known.where(F.col("i").isin(sinks)).agg(F.max("w")).first()[0] or 0.0)
    if not best:
        return [], 0.0
    wide = written(edges.where(F.col("v") >= best).select("i", "j"), "wide")
    levels = [written(spark.createDataFrame([(int(s), None, k) for k, s in enumerate(sorted(sources))], "i int, before int, rank long"), "level")]
    seen = levels[0].select("i")
    while (end := levels[-1].where(F.col("i").isin(sinks)).orderBy("rank").first()) is None:
        reached = wide.join(levels[-1].select("i", "rank"), "i").groupBy(F.col("j").alias("at")).agg(F.min(F.struct("rank", "i")).alias("b"))
        reached = reached.join(seen.withColumnRenamed("i", "at"), "at", "left_anti").select(F.col("at").alias("i"), F.col("b.i").alias("before"), F.col("b.rank").alias("above"))
        levels.append(written(_ranked(reached), "level"))
        seen = seen.unionByName(levels[-1].select("i"))
    path = [end.i]
    for level in reversed(levels):
        if (before := level.where(F.col("i") == path[-1]).first().before) is not None:
            path.append(before)
    return path[::-1], float(best)


def _ranked(reached: DataFrame) -> DataFrame:
    """(i, before, rank): ranks order a level's paths, by the rank before, then the state."""
    rows = reached.repartitionByRange("above", "i").sortWithinPartitions("above", "i")
    return rows.select("i", "before", F.monotonically_increasing_id().alias("rank"))


def top_paths(flux: DataFrame, sources: list[int], sinks: list[int], remove: str | Callable = "subtract", num_paths: float = np.inf, flux_cutoff: float = 1 - 1e-10, few: int = FEW) -> list[tuple[list[int], float]]:
    """Widest paths one after another, each taken out of the edge table, until they carry the cut-off's share of what leaves the sources.

    remove: "subtract" takes the path's flux from its edges and "bottleneck" its narrowest edge (the first of equal ones); a callable gets (edges, path) and returns edges.
    """
    left = written(flux.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v")), "flux")
    total = left.where(F.col("i").isin(sources)).agg(F.sum("v")).first()[0] or 0.0
    done, out, spark = 0.0, [], flux.sparkSession
    while len(out) < num_paths and done < flux_cutoff * total:
        path, width = widest_path(left, sources, sinks, few)
        if not path or not np.isfinite(width):
            break
        out.append((path, width))
        done += width
        if callable(remove):
            left = remove(left, path)
            continue
        steps = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(path, path[1:]))], "k int, i int, j int")
        least = left.join(F.broadcast(steps), ["i", "j"]).orderBy("v", "k").first()
        taken = F.when(F.col("k").isNull(), F.col("v")).otherwise(F.col("v") - (width if remove == "subtract" else 0.0))
        gone = (F.col("i") == least.i) & (F.col("j") == least.j)
        left = written(left.join(F.broadcast(steps), ["i", "j"], "left").where(~gone).select("i", "j", taken.alias("v")).where("v > 0"), "left-over")
    return out
