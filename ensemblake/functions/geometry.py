"""Vectors and molecules: array expressions, and superposition in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..exceptions import DataInvalid
from . import linalg
from .metrics import cross, dot, let, norm_vec


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x + y)


def scaled(v: Column, k: Column | float) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(v.cast("array<double>"), lambda x: x * k)


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def angle_between(v: Column, to: Column) -> Column:
    """In radians; the cosine is rounded to five places first."""
    return F.acos(F.round(F.try_divide(dot(v, to), length(v) * length(to)), 5))


def plane_projection(v: Column, v1: Column, v2: Column, degree: bool = True) -> tuple[Column, Column]:
    """(signed angle from v1 towards v2, magnitude) of v's projection on the plane of two unit vectors."""
    a, b = dot(v, v1), dot(v, v2)
    size = F.sqrt(a * a + b * b)
    angle = F.acos(F.round(F.try_divide(a, size), 5)) * F.when(b < 0, -1.0).otherwise(1.0)
    return (F.degrees(angle) if degree else angle), size


def rodrigues(v: Column, axis: Column, theta: Column | float, centre: Column | None = None) -> Column:
    """v turned about a unit axis through a centre."""
    theta = theta if isinstance(theta, Column) else F.lit(float(theta))
    own = v if centre is None else difference(v, centre)
    turned = let(own, lambda w: plus(plus(scaled(w, F.cos(theta)), scaled(cross(axis, w), F.sin(theta))), scaled(axis, dot(axis, w) * (1 - F.cos(theta)))))
    return turned if centre is None else plus(turned, centre)


#: Mean CA-CB distance in nm, and its angle out of the plane's bisector (fixed values).
CB_DISTANCE, CB_ANGLE = 0.153, 30.0


def cb_coords(n: Column, ca: Column, c: Column) -> Column:
    """Ideal CB: away from the middle of N and C, and out of their plane with CA."""
    away = norm_vec(difference(ca, scaled(plus(n, c), 0.5)))
    normal = norm_vec(cross(norm_vec(difference(ca, n)), norm_vec(difference(ca, c))))
    turn = F.radians(F.lit(CB_ANGLE))
    return plus(ca, plus(scaled(away, F.sin(turn) * CB_DISTANCE), scaled(normal, F.cos(turn) * CB_DISTANCE)))


def residue_frame(n: Column, ca: Column, c: Column) -> Column:
    """Rows x, y, z of a residue's axes: z from CA to CB, x normal to N-CA and z, y normal to both."""
    down = norm_vec(difference(cb_coords(n, ca, c), ca))
    across = lambda z: norm_vec(cross(norm_vec(difference(n, ca)), z))
    return let(down, lambda z: let(across(z), lambda x: F.array(x, norm_vec(cross(z, x)), z)))


def placed(points: Column, frame: Column, origin: Column) -> Column:
    """A point given in a residue's axes, in space."""
    return plus(plus(plus(scaled(frame[0], points[0]), scaled(frame[1], points[1])), scaled(frame[2], points[2])), origin)


def _stacks(x: pa.Array, most: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, rows x n x 3) of an array of flat structures: those of equal length together, some 300,000 coordinates at a time; nulls are left out."""
    there = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
    own = x.drop_null()
    starts = np.concatenate(([0], np.cumsum(own.value_lengths().to_numpy())))
    flat = own.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    for n in np.unique(sizes):
        if n % 3:
            raise DataInvalid(f"{n} numbers aren't places in space")
        rows = np.flatnonzero(sizes == n)
        step = max(1, most // max(int(n), 1))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            yield there[part], flat[starts[part][:, None] + np.arange(n)].reshape(len(part), int(n) // 3, 3)


def rmsd(x: Column, y: Column) -> Column:
    """Least RMSD of two structures, flat arrays of x, y, z, after superposition; a batch of rows at once. Null where one is null, NaN where a coordinate isn't finite."""

    @F.arrow_udf("double")
    def least(both: pa.Array) -> pa.Array:
        a, b = both.field("a"), both.field("b")
        known = pc.and_(a.is_valid(), b.is_valid())
        rows = np.flatnonzero(known.to_numpy(zero_copy_only=False))
        a, b = a.filter(known), b.filter(known)
        if not a.value_lengths().equals(b.value_lengths()):
            raise DataInvalid("structures of different sizes")
        out = np.full(len(both), np.nan)
        for (at, moving), (_, fixed) in zip(_stacks(a), _stacks(b)):
            out[rows[at]] = linalg.superpose_many(moving, fixed)[1]
        return pa.array(out, mask=~known.to_numpy(zero_copy_only=False))

    return least(F.struct(x.cast("array<double>").alias("a"), y.cast("array<double>").alias("b")))


def _per_structure(x: pa.Array, work: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """An array of arrays, null where x is: what work makes of the structures of each stack."""
    out: list[np.ndarray | None] = [None] * len(x)
    for rows, stack in _stacks(x):
        for k, made in zip(rows, work(stack).reshape(len(stack), -1)):
            out[k] = made
    return pa.array(out, pa.list_(pa.float64()))


def superposed(df: DataFrame, reference: list[float], xyz: str = "xyz") -> DataFrame:
    """df with each structure moved onto the reference."""
    fixed = np.reshape(np.array(reference, float), (1, -1, 3))

    @F.arrow_udf("array<double>")
    def move(x: pa.Array) -> pa.Array:
        return _per_structure(x, lambda stack: linalg.superpose_many(stack, fixed)[0])

    return df.withColumn(xyz, move(F.col(xyz).cast("array<double>")))


def sasa(df: DataFrame, radii: list[float], probe: float = 0.14, xyz: str = "xyz") -> DataFrame:
    """df with areas: the accessible area of each atom."""
    own = np.array(radii, float)

    @F.arrow_udf("array<double>")
    def area(x: pa.Array) -> pa.Array:
        return _per_structure(x, lambda stack: linalg.sasa_many(stack, own, probe))

    return df.withColumn("areas", area(F.col(xyz).cast("array<double>")))


def rmsf(coords: DataFrame, weights: DataFrame | None = None, ref_frame: int = 0, by: str = "atom_id") -> DataFrame:
    """by, rmsf: root of the weighted mean squared distance to the reference frame.

    coords: superposed (frame, atom_id, x, y, z) with a column `by`, an atom or its residue, whose atoms are averaged; weights: (frame, w), else equal.
    """
    ref = coords.where(F.col("frame") == ref_frame).select("atom_id", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"))
    own = coords.join(weights, "frame") if weights is not None else coords.withColumn("w", F.lit(1.0))
    d2 = sum(F.pow(F.col(c).cast("double") - F.col(f"r{c}"), 2) for c in "xyz")
    return own.join(ref, "atom_id").groupBy(by).agg(F.sqrt(F.sum(d2 * F.col("w")) / F.sum("w")).alias("rmsf"))


def b_factors(atoms: DataFrame, fluctuations: DataFrame, by: str = "res_seq") -> DataFrame:
    """atoms with b_factor: the fluctuation (by, rmsf) of an atom or its residue, as structure files carry it; 0 where there is none."""
    return atoms.join(fluctuations.select(by, F.col("rmsf").alias("b_factor")), by, "left").withColumn("b_factor", F.coalesce("b_factor", F.lit(0.0)))


def running_mean(points: DataFrame, value: str, n: int, order: str, by: list[str] = ()) -> DataFrame:
    """Means of n values in a row; the last full window is left out."""
    w = Window.partitionBy(*by).orderBy(order)
    own = points.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    own = own.withColumn(f"{value}_mean", F.avg(value).over(w.rowsBetween(0, n - 1)))
    return own.where(F.col("__k") < F.col("__n") - n).drop("__k", "__n")


def helix_vectors(coords: DataFrame, n_avg: int = 12) -> DataFrame:
    """frame, direction, centre of a helix from its backbone atoms (frame, k, x, y, z) in order: the mean step of the running mean."""
    w = Window.partitionBy("frame").orderBy("k")
    own = coords.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("frame")))
    own = own.select("frame", "k", "__k", "__n", *(F.avg(c).over(w.rowsBetween(0, n_avg - 1)).alias(f"{c}_mean") for c in "xyz"))
    coords = own.where(F.col("__k") < F.col("__n") - n_avg)
    steps = coords.select("frame", *(F.col(f"{c}_mean").alias(c) for c in "xyz"), *((F.lead(f"{c}_mean").over(w) - F.col(f"{c}_mean")).alias(f"d{c}") for c in "xyz"))
    found = steps.groupBy("frame").agg(F.array(*(F.avg(f"d{c}") for c in "xyz")).alias("step"), F.array(*(F.avg(c) for c in "xyz")).alias("centre"))
    return found.select("frame", norm_vec(F.col("step")).alias("direction"), "centre")


def reference_vector(axis: Column, point: Column, reference: Column) -> Column:
    """Unit vector from a point on an axis to a reference atom, without its part along the axis."""
    return let(difference(reference, point), lambda d: norm_vec(difference(d, scaled(axis, dot(d, axis)))))


def find_atom(atoms: DataFrame, res_seq: int, name: str) -> int | None:
    found = atoms.where((F.col("res_seq") == res_seq) & (F.col("name") == name)).agg(F.min("atom_id")).first()[0]
    return found


def backbone(atoms: DataFrame, res_seqs: list[int] | None = None, names: tuple[str, ...] = ("N", "CA", "C")) -> DataFrame:
    """atom_id, k of backbone atoms by residue and id."""
    own = atoms.where(F.col("name").isin(*names))
    own = own if res_seqs is None else own.where(F.col("res_seq").isin(res_seqs))
    return own.select("atom_id", (F.row_number().over(Window.orderBy("res_seq", "atom_id")) - 1).alias("k"))


def selection(text: str) -> Column:
    """A predicate over atoms from a selection such as `name CA or resSeq 3 to 9 and not resname GLY`.

    Fields: name, element, resname, resSeq, resid, index; a field takes one or more values or `a to b`. Also all, none, not, and, or, parentheses.
    """
    fields = {"name": "name", "element": "element", "resname": "res_name", "resSeq": "res_seq", "residue": "res_seq", "resid": "res_id", "index": "atom_id"}
    words = text.replace("(", " ( ").replace(")", " ) ").split()
    stops = {"and", "or", "not", "(", ")"}
    at = 0

    def peek() -> str | None:
        return words[at] if at < len(words) else None

    def take() -> str:
        nonlocal at
        at += 1
        if at > len(words):
            raise DataInvalid(f"selection ends early: {text!r}")
        return words[at - 1]

    def atom() -> Column:
        word = take()
        if word == "not":
            return ~atom()
        if word == "(":
            found = either()
            if take() != ")":
                raise DataInvalid(f"missing ) in {text!r}")
            return found
        if word in ("all", "none"):
            return F.lit(word == "all")
        if word not in fields:
            raise DataInvalid(f"unknown word {word!r} in {text!r}")
        values = [take()]
        while peek() is not None and peek() not in stops:
            values.append(take())
        column = F.col(fields[word])
        if len(values) == 3 and values[1] == "to":
            return column.between(int(values[0]), int(values[2]))
        return column.isin([int(v) if fields[word] in ("res_seq", "res_id", "atom_id") else v for v in values])

    def both() -> Column:
        found = atom()
        while peek() == "and":
            take()
            found = found & atom()
        return found

    def either() -> Column:
        found = both()
        while peek() == "or":
            take()
            found = found | both()
        return found

    found = either()
    if peek() is not None:
        raise DataInvalid(f"unread words in selection {text!r}")
    return found


