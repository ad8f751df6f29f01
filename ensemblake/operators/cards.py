"""Rotamer states with hysteresis, order and disorder, and the correlations of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..exceptions import ImproperlyConfigured
from ..plans.shared import written
from .info import FRAME, mi_matrix

SERIES = ["traj_id", "feature"]
#: Boundaries of the basins of each kind of dihedral, and the shift before binning (fixed values).
KINDS = {"phi": ([0, 180, 360], 0), "psi": ([0, 160, 360], -100), "chi": ([0, 120, 240, 360], 0)}


def dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Angle of four points in degrees from 0, at most 359.5."""
    from ..functions.geometry import difference
    from ..functions.metrics import cross, dot, norm_vec

    b1, b2, b3 = difference(b, a), difference(c, b), difference(d, c)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    angle = F.degrees(F.atan2(dot(cross(n1, n2), norm_vec(b2)), dot(n1, n2)))
    return F.least(F.pmod(angle, F.lit(360.0)), F.lit(359.5))


def gates(boundaries: list[float], buffer_width: float) -> list[tuple[float, float]]:
    """(low, high) of each basin: where an angle must be to have left it. The first and last basins wrap around."""
    out = []
    for k, (a, z) in enumerate(zip(boundaries, boundaries[1:])):
        out.append(((a if k else 360) - buffer_width, (z if k < len(boundaries) - 2 else 0) + buffer_width))
    return out


def left_basin(state: Column, angle: Column, boundaries: list[float], buffer_width: float) -> Column:
    """Whether an angle is beyond the buffers of a basin. Ends count as left for basins that wrap, and as inside for others."""
    out = F.lit(False)
    for k, (low, high) in enumerate(gates(boundaries, buffer_width)):
        gone = angle.between(high, low) if high < low else ~angle.between(low, high) if high > low else F.lit(False)
        out = F.when(state == k, gone).otherwise(out)
    return out


def basin(angle: Column, boundaries: list[float]) -> Column:
    return sum(((angle >= b).cast("int") for b in boundaries[1:-1]), F.lit(0))


def rotamers(angles: DataFrame, boundaries: list[float], buffer_width: float = 15, shift: float = 0, by: list[str] = SERIES) -> DataFrame:
    """by, frame, state: the first frame's basin, kept until an angle is beyond its buffers.

    With two basins the state is that of the last frame in either core, one window. With more, what leaving means depends on where
    one is, so frames are maps from basin to basin, which are composed.
    """
    if not 0 <= buffer_width < 360:
        raise ImproperlyConfigured("the buffer must be from 0 to under 360 degrees")
    own = angles.select(*by, "frame", F.pmod(F.col("angle") + F.lit(float(shift)), F.lit(360.0)).alias("angle"))
    ordered = Window.partitionBy(*by).orderBy("frame")
    if len(boundaries) == 3:
        hard = basin(F.col("angle"), boundaries)
        first = F.row_number().over(ordered) == 1
        out0, out1 = (left_basin(F.lit(k), F.col("angle"), boundaries, buffer_width) for k in (0, 1))
        core = F.when(first, hard).when(out0 & out1, F.lit(None)).when(out0, 1).when(out1, 0)
        if gates(boundaries, buffer_width)[0][1] < gates(boundaries, buffer_width)[0][0]:
            return own.withColumn("core", core).select(*by, "frame", F.last("core", True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("state"))
    return _many_basins(own, boundaries, buffer_width, by)


def _many_basins(own: DataFrame, boundaries: list[float], buffer_width: float, by: list[str]) -> DataFrame:
    """A frame maps each basin one may be in to the one after it; what the maps of all frames so far make of the first frame's basin is the state.

    Maps of twice as many frames are composed in each round, so a series of n frames takes log2(n) rounds of one window, in whose order the rows
    are already. The first frame's map is constant.
    """
    ordered = Window.partitionBy(*by).orderBy("frame")
    n, angle = len(boundaries) - 1, F.col("angle")
    longest = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    hard, first = basin(angle, boundaries), F.row_number().over(ordered) == 1
    now = own.select(*by, "frame", *(F.when(first | left_basin(F.lit(k), angle, boundaries, buffer_width), hard).otherwise(k).cast("int").alias(f"__{k}") for k in range(n)))
    step = 1
    while step < longest:
        now = now.select("*", *(F.lag(f"__{k}", step).over(ordered).alias(f"__before{k}") for k in range(n)))
        through = [F.coalesce(*(F.when(F.col(f"__before{k}") == x, F.col(f"__{x}")) for x in range(n)), F.col(f"__{k}")) for k in range(n)]
        now = now.select(*by, "frame", *(t.alias(f"__{k}") for k, t in enumerate(through)))
        step *= 2
    return now.select(*by, "frame", F.col("__0").alias("state"))


def phi_rotamers(angles: DataFrame, buffer_width: float = 15) -> DataFrame:
    return rotamers(angles, KINDS["phi"][0], buffer_width)


def psi_rotamers(angles: DataFrame, buffer_width: float = 15) -> DataFrame:
    return rotamers(angles, KINDS["psi"][0], buffer_width, KINDS["psi"][1])


def chi_rotamers(angles: DataFrame, buffer_width: float = 15) -> DataFrame:
    return rotamers(angles, KINDS["chi"][0], buffer_width)


def all_rotamers(angles: DataFrame, buffer_width: float = 15) -> DataFrame:
    """As rotamers, for a table that says each series' kind (phi, psi, chi)."""
    out = None
    for kind, (boundaries, shift) in KINDS.items():
        own = rotamers(angles.where(F.col("kind") == kind), boundaries, buffer_width, shift)
        out = own if out is None else out.unionByName(own)
    return out


def transition_times(states: DataFrame, by: list[str] = SERIES) -> DataFrame:
    """by, t, gap: frames before a change of state, and how long since the one before (the first: since the start)."""
    w = Window.partitionBy(*by).orderBy("frame")
    t = states.withColumn("__next", F.lead("state").over(w)).where("__next <> state").select(*by, F.col("frame").alias("t"))
    return t.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(*by).orderBy("t")))


def transition_stats(states: DataFrame, by: list[str] = SERIES) -> DataFrame:
    """by, ord_time, n_ord, disord_time, n_disord for every series, zeros where nothing changes.

    Disordered time is the mean gap between changes; ordered time the mean wait for one from any moment.
    """
    t = transition_times(states, by)
    wait = F.coalesce("gap", "t").cast("double")
    half = wait * (wait + 1) / 2
    found = t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.sum(half).alias("halves"), F.sum(wait).alias("waits"), F.min("t").alias("first"), F.max("t").alias("last"))
    many = F.col("n") > 1
    out = found.select(
        *by,
        F.when(many, F.try_divide("halves", "waits")).otherwise(F.col("halves")).alias("ord_time"),
        F.col("last").cast("double").alias("n_ord"),
        F.when(many, F.col("mean_gap")).otherwise(0.0).alias("disord_time"),
        F.when(many, F.col("last") - F.col("first")).otherwise(0).cast("double").alias("n_disord"),
    )
    return states.select(*by).distinct().join(out, by, "left").fillna(0.0, ["ord_time", "n_ord", "disord_time", "n_disord"])


def mean_times(states: DataFrame) -> DataFrame:
    """feature, ord_time, disord_time: means over all trajectories by their lengths, still ones included."""
    lengths = states.groupBy(*SERIES).agg(F.count(F.lit(1)).cast("double").alias("len"))
    both = transition_stats(states).join(lengths, SERIES)
    mean = lambda c: (F.sum(F.col(c) * F.col("len")) / F.sum("len")).alias(c)
    return both.groupBy("feature").agg(mean("ord_time"), mean("disord_time"))


def disorder(states: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """traj_id, feature, frame, state: 1 in gaps between changes that are likelier disordered (a ratio of 3 or more), else 0."""
    times = mean_times(states) if times is None else times
    w = Window.partitionBy(*SERIES).orderBy("frame")
    change = F.coalesce(F.lead("state").over(w) != F.col("state"), F.lit(False))
    own = states.withColumn("__t", F.when(change, F.col("frame")))
    before = F.last("__t", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__t", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    own = own.withColumn("__gap", (after - before).cast("double")).join(times, "feature")
    ratio = F.try_divide("ord_time", "disord_time") * F.exp(-F.col("__gap") * (F.try_divide(F.lit(1.0), F.col("disord_time")) - F.try_divide(F.lit(1.0), F.col("ord_time"))))
    return own.select(*SERIES, "frame", F.coalesce((ratio >= 3).cast("int"), F.lit(0)).alias("state"))


def cards(states: DataFrame, n_states: dict[int, int]) -> dict[str, DataFrame]:
    """struct_struct, disorder_disorder, struct_disorder, disorder_struct: normalised (fa, fb, mi) of rotamer and disorder states."""
    apart = max(n_states) + 1
    still = disorder(states).withColumn("feature", F.col("feature") + apart)
    both = states.select("traj_id", "feature", "frame", "state").unionByName(still.select("traj_id", "feature", "frame", "state"))
    # Both families are counted in one job; the matrix is small, so its four parts read it back.
    mi = written(mi_matrix(both, None, n_states | {f + apart: 2 for f in n_states}, keys=FRAME), "cards")
    part = lambda a, b: mi.where((F.col("fa") >= apart) == a).where((F.col("fb") >= apart) == b).select((F.col("fa") % apart).alias("fa"), (F.col("fb") % apart).alias("fb"), "mi")
    return {"struct_struct": part(False, False), "disorder_disorder": part(True, True), "struct_disorder": part(False, True), "disorder_struct": part(True, False)}


class RotamerFeaturizer:
    """transform(angles (traj_id, feature, frame, kind, angle)) gives rotamer states; nothing is learned."""

    def __init__(self, buffer_width: float = 15):
        self.buffer_width = buffer_width

    def transform(self, angles: DataFrame) -> DataFrame:
        return all_rotamers(angles, self.buffer_width)
