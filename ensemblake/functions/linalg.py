"""Numeric kernels on small dense matrices, gathered from (i, j, v) tables of a checked size."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..exceptions import ConvergenceWarning, DataInvalid, InsufficientResourceError

#: A dense matrix on the driver has at most so many rows.
MOST_STATES = 5000


def few_states(n: int) -> int:
    """n, where a matrix of so many rows fits one machine; else an error."""
    if n > MOST_STATES:
        raise InsufficientResourceError(f"{n} states don't fit a dense matrix on the driver")
    return n


def gather(matrix: DataFrame, n: int | None = None) -> np.ndarray:
    """A dense array of (i, j, v); n: its rows, else one more than the largest index."""
    if n is None:
        top = matrix.agg(F.max(F.greatest("i", "j"))).first()[0]
        n = 0 if top is None else int(top) + 1
    few_states(n)
    out = np.zeros((n, n))
    for i, j, v in matrix.select("i", "j", "v").collect():
        out[i, j] += v
    return out


def gather_vector(vector: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n)
    for i, v in vector.select("i", "v").collect():
        out[i] = v
    return out


def scatter(spark: SparkSession, a: np.ndarray, keep_zeros: bool = False) -> DataFrame:
    """(i, j, v) of an array, (i, v) of a vector."""
    if a.ndim == 1:
        return spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(a)], "i int, v double")
    at = np.argwhere(np.ones_like(a, bool) if keep_zeros else a != 0)
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in at], "i int, j int, v double")


def eigenspectrum(t: np.ndarray, n_eigs: int | None = None, left: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling real part, and their vectors as columns; the first sums to 1."""
    n = len(t) if n_eigs is None else n_eigs
    if n < 2:
        raise ValueError("at least two eigenvalues")
    values, vectors = np.linalg.eig(t.T if left else t)
    order = np.argsort(-values.real, kind="stable")[:n]
    values, vectors = values[order].real, vectors[:, order].real
    vectors[:, 0] /= vectors[:, 0].sum()
    return values, vectors


def stationary(t: np.ndarray) -> np.ndarray:
    return eigenspectrum(t)[1][:, 0]


def row_normalized(c: np.ndarray) -> np.ndarray:
    total = c.sum(axis=1, keepdims=True)
    return np.divide(c, total, out=np.zeros_like(c, float), where=total > 0)


def reversible_mle(c: np.ndarray, tol: float = 1e-12, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood transition matrix under detailed balance, and its populations.

    Fixed point of x_ij = (c_ij + c_ji) / (c_i / x_i + c_j / x_j) over symmetric x with row sums x_i.
    """
    both, rows = c + c.T, c.sum(axis=1)
    x = both.astype(float)
    for _ in range(most):
        sums = x.sum(axis=1)
        ratio = np.divide(rows, sums, out=np.zeros(len(c)), where=sums > 0)
        below = ratio[:, None] + ratio[None, :]
        new = np.divide(both, below, out=np.zeros_like(x), where=below > 0)
        new /= new.sum()
        if np.abs(new - x / x.sum()).max() < tol * 1e-3:
            x = new
            break
        x = new
    else:
        warnings.warn(f"the most likely model still changes after {most} rounds", ConvergenceWarning, stacklevel=2)
    return row_normalized(x), x.sum(axis=1) / x.sum()


def committors(t: np.ndarray, sources: list[int], sinks: list[int]) -> np.ndarray:
    """Probability to reach a sink before a source."""
    n, ends = len(t), [*sources, *sinks]
    if set(sources) & set(sinks):
        raise DataInvalid("a state is both source and sink")
    system, right = np.eye(n) - t, t[:, sinks].sum(axis=1)
    system[ends], system[:, ends] = 0, 0
    system[ends, ends] = 1
    right[sources], right[sinks] = 0, 1
    return np.linalg.solve(system, right)


def mfpts(t: np.ndarray, sinks: list[int] | None = None, populations: np.ndarray | None = None, lagtime: float = 1.0) -> np.ndarray:
    """Mean first passage times: between all pairs, or from each state to the sinks."""
    n = len(t)
    if sinks is None:
        pi = stationary(t) if populations is None else populations
        z = np.linalg.inv(np.eye(n) - t + pi[None, :])
        return lagtime * (np.diag(z)[None, :] - z) / pi[None, :]
    system, right = np.eye(n) - t, np.ones(n)
    system[sinks], system[:, sinks] = 0, 0
    system[sinks, sinks] = 1
    right[sinks] = 0
    return lagtime * np.linalg.solve(system, right)


def affinity_propagation(similarity: np.ndarray, damping: float = 0.5, preference: float | None = None, most: int = 10_000, steady: int = 15) -> np.ndarray:
    """Exemplar labels 0, 1, ... by message passing; -1 everywhere if no exemplar emerges."""
    s = similarity.astype(float).copy()
    n = len(s)
    np.fill_diagonal(s, np.median(s) if preference is None else preference)
    s += 1e-10 * np.ptp(s) * np.random.default_rng(0).random((n, n))  # equal choices would never settle
    r, a, last, same = np.zeros((n, n)), np.zeros((n, n)), None, 0
    rows = np.arange(n)
    for _ in range(most):
        both = a + s
        first = both.argmax(axis=1)
        top = both[rows, first]
        both[rows, first] = -np.inf
        new = s - top[:, None]
        new[rows, first] = s[rows, first] - both.max(axis=1)
        r = damping * r + (1 - damping) * new
        support = np.maximum(r, 0)
        np.fill_diagonal(support, np.diag(r))
        new = support.sum(axis=0)[None, :] - support
        own = np.diag(new).copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
        chosen = np.diag(a) + np.diag(r) > 0
        same = same + 1 if last is not None and (chosen == last).all() else 0
        last = chosen
        if same >= steady and chosen.any():
            break
    else:
        warnings.warn(f"exemplars still change after {most} rounds", ConvergenceWarning, stacklevel=2)
    exemplars = np.flatnonzero(last)
    if not len(exemplars):
        return np.full(n, -1)
    labels = s[:, exemplars].argmax(axis=1)
    labels[exemplars] = np.arange(len(exemplars))
    return labels


def superpose_many(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """m structures (m x n x 3), each rotated and shifted onto its own or the one fixed (m or 1 x n x 3) for the least RMSD, and these RMSDs (Kabsch).

    NaN where a coordinate isn't finite, or there are no atoms.
    """
    m, n = moving.shape[:2]
    if not m or not n:
        return moving, np.full(m, np.nan)
    good = np.isfinite(moving).all(axis=(1, 2)) & np.isfinite(fixed).all(axis=(1, 2))
    if not good.all():
        placed, least = np.full(moving.shape, np.nan), np.full(m, np.nan)
        if good.any():
            placed[good], least[good] = superpose_many(moving[good], fixed[good] if len(fixed) == m else fixed)
        return placed, least
    centre = fixed.mean(axis=1, keepdims=True)
    a, b = moving - moving.mean(axis=1, keepdims=True), fixed - centre
    u, _, vt = np.linalg.svd(np.swapaxes(a, 1, 2) @ b)
    u[:, :, 2] *= np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)[:, None]
    placed = a @ (u @ vt)
    return placed + centre, np.sqrt(((placed - b) ** 2).sum(axis=(1, 2)) / n)


def superpose(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, float]:
    """moving (n x 3) rotated and shifted onto fixed for the least RMSD, and that RMSD."""
    placed, least = superpose_many(np.asarray(moving, float)[None], np.asarray(fixed, float)[None])
    return placed[0], float(least[0])


def fit_exponentials(t: np.ndarray, y: np.ndarray, p0: list[float], most: int = 500) -> np.ndarray:
    """Least squares of a sum of I exp(-t / tau); p: all I, then all tau. Damped Gauss-Newton."""
    p, k, damp = np.array(p0, float), len(p0) // 2, 1e-3

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.exp(-t[:, None] / p[None, k:])
        return e @ p[:k], np.hstack([e, e * p[None, :k] * t[:, None] / p[None, k:] ** 2])

    f, jac = model(p)
    cost = ((y - f) ** 2).sum()
    for _ in range(most):
        square = jac.T @ jac
        step = np.linalg.lstsq(square + damp * np.diag(np.diag(square) + 1e-12), jac.T @ (y - f), rcond=None)[0]
        tried = p + step
        if (tried[k:] > 0).all() and ((y - model(tried)[0]) ** 2).sum() < cost:
            p, damp = tried, damp / 3
            f, jac = model(p)
            new = ((y - f) ** 2).sum()
            if cost - new <= 1e-14 * max(cost, 1e-300):
                break
            cost = new
        elif (damp := damp * 4) > 1e12:
            break
    return p


def sphere(n: int = 960) -> np.ndarray:
    """Points spread evenly over a unit sphere (golden spiral)."""
    k = np.arange(n) + 0.5
    z, angle = 1 - 2 * k / n, np.pi * (1 + 5**0.5) * k
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(angle), r * np.sin(angle), z], axis=1)


#: Distances, or tests of a spot against a neighbour, that are held at once.
TILE = 2_000_000


def sasa_many(xyz: np.ndarray, radii: np.ndarray, probe: float = 0.14, points: int = 960) -> np.ndarray:
    """m x n solvent-accessible areas of structures (m x n x 3): the share of an atom's sphere outside all others (Shrake-Rupley).

    A spot r u of an atom is within r' of a neighbour at v if u . v > (v . v + r r - r' r') / 2 r, so all spots of many atoms are one matrix product.
    """
    unit, r = sphere(points).T, radii + probe
    m, n = xyz.shape[:2]
    out = np.empty((m, n))
    for s, k in _tiles(m, n):
        there, own = xyz[s], xyz[s, k]
        d2 = ((own[:, :, None, :] - there[:, None, :, :]) ** 2).sum(axis=3)
        at, atom, other = np.nonzero((d2 < (r[k, None] + r[None, :]) ** 2) & (d2 > 0))
        mine = r[k][atom]
        bound = (d2[at, atom, other] + mine**2 - r[other] ** 2) / (2 * mine)
        name = at * own.shape[1] + atom  # in rising order
        away = there[at, other] - own[at, atom]
        hidden = np.zeros((own.shape[0] * own.shape[1], points), bool)
        step = max(1, TILE // points)
        for lo in range(0, len(name), step):
            part = slice(lo, lo + step)
            within = away[part] @ unit > bound[part, None]
            whose, first = np.unique(name[part], return_index=True)
            hidden[whose] |= np.logical_or.reduceat(within, first, axis=0)
        free = 1 - hidden.mean(axis=1).reshape(own.shape[:2])
        out[s, k] = 4 * np.pi * r[k] ** 2 * free
    return out


def _tiles(m: int, n: int) -> Iterator[tuple[slice, slice]]:
    """(structures, atoms) of which no more than about TILE distances or spots are held at once."""
    few = max(1, TILE // (max(n, 1_000) * max(n, 1)))
    rows = max(1, min(n, TILE // max(n, 1_000)))
    for lo in range(0, m, few):
        for first in range(0, n, rows if few == 1 else n):
            yield slice(lo, lo + few), slice(first, first + (rows if few == 1 else n))


def sasa(xyz: np.ndarray, radii: np.ndarray, probe: float = 0.14, points: int = 960) -> np.ndarray:
    """Accessible area of each atom of one structure."""
    return sasa_many(np.asarray(xyz, float)[None], radii, probe, points)[0]


def deconvolve(g: np.ndarray) -> np.ndarray:
    """Direct couplings from observed ones: g (1 + g)^-1."""
    return g @ np.linalg.inv(np.eye(len(g)) + g)
