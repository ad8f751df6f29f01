"""Distances, histograms and normalisations as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..exceptions import ImproperlyConfigured

Metric = Callable[[Column, Column], Column]


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _pairs(x: Column, y: Column, f: Metric) -> Column:
    """f over paired components as doubles; vectors of different sizes are an error."""
    same = F.when(F.size(x) == F.size(y), x).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("array<double>"))
    return F.zip_with(same.cast("array<double>"), y.cast("array<double>"), f)


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(sqeuclidean(x, y))


def sqeuclidean(x: Column, y: Column) -> Column:
    return _total(_pairs(x, y, lambda a, b: (a - b) * (a - b)))


def manhattan(x: Column, y: Column) -> Column:
    return _total(_pairs(x, y, lambda a, b: F.abs(a - b)))


def chebyshev(x: Column, y: Column) -> Column:
    return F.array_max(_pairs(x, y, lambda a, b: F.abs(a - b)))


def canberra(x: Column, y: Column) -> Column:
    return _total(_pairs(x, y, lambda a, b: F.when(F.abs(a) + F.abs(b) > 0, F.abs(a - b) / (F.abs(a) + F.abs(b))).otherwise(0.0)))


def braycurtis(x: Column, y: Column) -> Column:
    return F.try_divide(manhattan(x, y), _total(_pairs(x, y, lambda a, b: F.abs(a + b))))


def hamming(x: Column, y: Column) -> Column:
    """Share of components that differ."""
    return _total(_pairs(x, y, lambda a, b: (a != b).cast("double"))) / F.size(x)


def jaccard(x: Column, y: Column) -> Column:
    """Of the components that aren't zero in both, the share that differ."""
    some = _total(_pairs(x, y, lambda a, b: ((a != 0) | (b != 0)).cast("double")))
    return F.coalesce(F.try_divide(_total(_pairs(x, y, lambda a, b: ((a != b) & ((a != 0) | (b != 0))).cast("double"))), some), F.lit(0.0))


def cosine(x: Column, y: Column) -> Column:
    """1 less the cosine of the angle between them; null where one is zero."""
    return 1 - F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def correlation(x: Column, y: Column) -> Column:
    """As cosine, of the components less their means."""
    centred = lambda v: let(v.cast("array<double>"), lambda a: let(_total(a) / F.size(a), lambda m: F.transform(a, lambda c: c - m)))
    return let(centred(x), lambda a: let(centred(y), lambda b: cosine(a, b)))


def minkowski(p: float) -> Metric:
    """The metric of a power: 1 is manhattan, 2 euclidean."""
    return lambda x, y: F.pow(_total(_pairs(x, y, lambda a, b: F.pow(F.abs(a - b), p))), 1 / p)


METRICS: dict[str, Metric] = {"cosine": cosine, "correlation": correlation, "minkowski": minkowski(3), "euclidean": euclidean, "sqeuclidean": sqeuclidean, "manhattan": manhattan, "cityblock": manhattan, "chebyshev": chebyshev, "canberra": canberra, "braycurtis": braycurtis, "hamming": hamming, "jaccard": jaccard}


def metric(name: str | Metric) -> Metric:
    """A metric by name (minkowski: of power 3, else minkowski(p)), or a callable of two Columns as it is. `rmsd` needs superposition: see geometry.rmsd."""
    if callable(name):
        return name
    if name == "rmsd":
        from .geometry import rmsd

        return rmsd
    if name not in METRICS:
        raise ImproperlyConfigured(f"unknown metric {name!r}; there are {', '.join(sorted(METRICS))} and rmsd")
    return METRICS[name]


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) in which x is computed once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def norm_vec(v: Column) -> Column:
    """Unit vector; a zero vector has none (null components)."""
    length = lambda a: F.sqrt(_total(F.transform(a, lambda c: c * c)))
    return let(v.cast("array<double>"), lambda a: let(length(a), lambda n: F.transform(a, lambda c: F.try_divide(c, n))))


def dot(x: Column, y: Column) -> Column:
    return _total(_pairs(x, y, lambda a, b: a * b))


def cross(x: Column, y: Column) -> Column:
    def made(a: Column, b: Column) -> Column:
        c = lambda i, j: a[i] * b[j] - a[j] * b[i]
        return F.array(c(1, 2), c(2, 0), c(0, 1))

    return let(x, lambda a: let(y, lambda b: made(a, b)))


def moments(df: DataFrame, value: str, by: list[str] = (), with_mean: bool = True) -> DataFrame:
    """mean, standard deviation, skewness and excess kurtosis, all of the population."""
    found = [F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis")]
    return df.groupBy(*by).agg(*([F.avg(value).alias("mean")] if with_mean else []), *found)


def minmax(df: DataFrame, value: str, by: list[str] = (), out: str = "scaled") -> DataFrame:
    """Scaled to 0..1 within each group; a constant group is null. Extremes are aggregated, so no group is sorted."""
    ends = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    both = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))
    return both.withColumn(out, F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def histogram(df: DataFrame, value: str, width: float, by: list[str] = ()) -> DataFrame:
    """by, bin, lo, hi, n: equal bins from 0 up to one beyond the largest value, empty ones too."""
    return filled_bins(df.groupBy(*by, F.floor(F.col(value) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")), width, by)


def filled_bins(counts: DataFrame, width: float, by: list[str] = ()) -> DataFrame:
    """by, bin, lo, hi, n of counts (by, bin, n): bins from 0 up to one beyond the last, those without a count too."""
    tops = counts.groupBy(*by).agg((F.max("bin") + 1).alias("__top"))
    grid = tops.select(*by, F.explode(F.sequence(F.lit(0), "__top")).alias("bin"))
    out = grid.join(counts, [*by, "bin"], "left")
    return out.select(*by, "bin", (F.col("bin") * width).alias("lo"), ((F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_like(df: DataFrame, value: str, lo: float, hi: float, bins: int, by: list[str] = ()) -> DataFrame:
    """by, bin, p: shares on a fixed grid whose last bin is closed; values outside don't count."""
    inside = df.where(F.col(value).between(lo, hi))
    bin_ = F.least(F.floor((F.col(value) - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__all"))
    both = counts.join(totals, list(by)) if by else counts.crossJoin(F.broadcast(totals))
    return both.select(*by, "bin", (F.col("n") / F.col("__all")).alias("p"))


def int_norm(df: DataFrame, x: str, y: str, out: str = "y_norm") -> DataFrame:
    """y scaled so that its sum times the grid's step (of the first two x) is 1. The curve's total is one aggregate."""
    first = [r[0] for r in df.select(x).orderBy(x).limit(2).collect()]
    total = df.agg(F.sum(y)).first()[0]
    return df.withColumn(out, F.col(y) / F.lit(total * (first[1] - first[0])))


def int_norm_hist(df: DataFrame, n: str = "n", lo: str = "lo", hi: str = "hi", out: str = "density") -> DataFrame:
    """Bin counts over the area under them."""
    area = df.agg(F.sum(F.col(n) * (F.col(hi) - F.col(lo))).alias("__area"))
    return df.crossJoin(F.broadcast(area)).withColumn(out, F.try_divide(n, "__area")).drop("__area")


def sum_sq_resid(predicted: DataFrame, measured: DataFrame, by: list[str], bin_: str = "bin", p: str = "p") -> DataFrame:
    """by, rss: over all bins of either curve; a missing bin counts as 0."""
    groups = predicted.select(*by).distinct()
    grid = groups.crossJoin(F.broadcast(measured.select(F.col(bin_), F.col(p).alias("__m"))))
    both = predicted.select(*by, bin_, F.col(p).alias("__p")).join(grid, [*by, bin_], "full")
    d = F.coalesce("__p", F.lit(0.0)) - F.coalesce("__m", F.lit(0.0))
    return both.groupBy(*by).agg(F.sum(d * d).alias("rss"))


def energy_to_probability(df: DataFrame, u: str, kT: float = 2.479, out: str = "p") -> DataFrame:
    """Boltzmann weights of energies, taken from their mean."""
    mean = df.agg(F.avg(u)).first()[0]
    weighted = df.withColumn("__w", F.exp(-(F.col(u) - F.lit(mean)) / kT))
    total = weighted.agg(F.sum("__w").alias("__z"))
    return weighted.crossJoin(F.broadcast(total)).withColumn(out, F.col("__w") / F.col("__z")).drop("__w", "__z")


def shares(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """value over its group's total; 0 where that is 0."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(out, F.when(total != 0, F.col(value) / total).otherwise(0.0))
