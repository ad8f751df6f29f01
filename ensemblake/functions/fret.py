"""Resonance energy transfer as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import difference, length
from .metrics import dot, let, norm_vec

#: Of the Foerster radius in nm, for J in M^-1 cm^-1 nm^4 (fixed value).
R0_FACTOR = 0.02108


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def fret_efficiency(r: Column, r0: Column | float, offset: float = 0.0) -> Column:
    a, b = F.pow(_c(r0), 6), F.pow(r + offset, 6)
    return a / (a + b)


def forster_radius(k2: Column | float, qd: Column | float, j: Column | float, n: float = 1.333) -> Column:
    return R0_FACTOR * F.pow(_c(k2) * _c(qd) * _c(j) / n**4, 1 / 6)


def kappa2_r(donor_origin: Column, donor_dipole: Column, acceptor_origin: Column, acceptor_dipole: Column) -> tuple[Column, Column]:
    """(orientation factor, distance) of two dyes."""
    between = difference(acceptor_origin, donor_origin)
    d, a, r = norm_vec(donor_dipole), norm_vec(acceptor_dipole), norm_vec(between)
    turned = lambda d, a, r: dot(d, a) - 3 * dot(d, r) * dot(a, r)
    return let(d, lambda d: let(a, lambda a: let(r, lambda r: F.pow(turned(d, a, r), 2)))), length(between)


def fret_rate(r: Column, r0: Column | float, td: Column | float) -> Column:
    return F.pow(_c(r0) / r, 6) / _c(td)


def radiative_rates(qd: Column | float, td: Column | float) -> tuple[Column, Column]:
    """(radiative, non-radiative)."""
    k = _c(qd) / _c(td)
    return k, 1 / _c(td) - k


def transfer_probabilities(krad: Column, knon: Column, kret: Column, dt: float) -> Column:
    """struct(radiative, non_radiative, energy_transfer, excited) in a step; if they exceed 1, none stays excited and the rest are shares."""
    rad, non, ret = (1 - F.exp(-k * dt) for k in (krad, knon, kret))
    total = rad + non + ret
    by = F.when(total > 1, total).otherwise(1.0)
    return F.struct((rad / by).alias("radiative"), (non / by).alias("non_radiative"), (ret / by).alias("energy_transfer"), F.greatest(1 - total, F.lit(0.0)).alias("excited"))


def single_exp_decay(t: Column, i0: Column | float, tau: Column | float) -> Column:
    return _c(i0) * F.exp(-t / _c(tau))


def double_exp_decay(t: Column, i1: Column | float, i2: Column | float, tau1: Column | float, tau2: Column | float) -> Column:
    return single_exp_decay(t, i1, tau1) + single_exp_decay(t, i2, tau2)


def overlap_integral(donor: DataFrame, acceptor: DataFrame, ext_coeff: float) -> DataFrame:
    """One row, j: overlap of donor emission and acceptor excitation (wavelength, emission / excitation), by trapezoids on the shared grid."""
    both = donor.select("wavelength", "emission").join(acceptor.select("wavelength", F.coalesce("excitation", F.lit(0.0)).alias("excitation")), "wavelength")
    both = both.withColumn("f", F.col("emission") * F.col("excitation") * ext_coeff * F.pow(F.col("wavelength").cast("double"), 4))
    w = Window.orderBy("wavelength")  # a spectrum has some hundred rows
    step = (F.col("wavelength") - F.lag("wavelength").over(w)) / 2
    parts = both.select((step * (F.col("f") + F.lag("f").over(w))).alias("a"), (step * (F.col("emission") + F.lag("emission").over(w))).alias("b"))
    return parts.agg((F.sum("a") / F.sum("b")).alias("j"))


def trapezoid(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, area: under a curve of some rows."""
    w = Window.orderBy(x)
    return df.select(((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).alias("a")).agg(F.sum("a").alias("area"))
