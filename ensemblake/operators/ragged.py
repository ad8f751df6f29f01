"""Ragged tables: rows of different lengths as a long DataFrame (traj_id, frame, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..exceptions import DataInvalid

KEY = ["traj_id", "frame"]
#: Rows a block of a running total, which is first taken over blocks.
BLOCK = 65_536


def running_total(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """df with the sum of value over all smaller keys (distinct integers).

    Blocks of keys are summed first; only their totals, a 65536th of the keys, meet in one window.
    """
    block = F.floor(F.col(key) / BLOCK).cast("long")
    totals = df.groupBy(block.alias("__block")).agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("__block", block).withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(totals, "__block").withColumn(out, (F.col("__base") + F.col("__in")).cast("long")).drop("__block", "__base", "__in")


class Ragged:
    """A ragged table. Frames of a row count from 0 without gaps. Operations are lazy and return new tables."""

    def __init__(self, df: DataFrame, value: str = "value"):
        missing = {*KEY, value} - set(df.columns)
        if missing:
            raise DataInvalid(f"columns are missing: {', '.join(sorted(missing))}")
        self.df = df.select(*KEY, F.col(value).alias("value"))

    @classmethod
    def from_nested(cls, df: DataFrame, array: str = "values") -> Ragged:
        """From a row (traj_id, array) for each trajectory."""
        return cls(df.select("traj_id", F.posexplode(array).alias("frame", "value")).withColumn("frame", F.col("frame").cast("long")))

    @classmethod
    def from_flat(cls, df: DataFrame, lengths: list[int], index: str = "flat", value: str = "value") -> Ragged:
        """From values by flat index and the lengths of the rows, which must add up."""
        if (n := df.count()) != sum(lengths):
            raise DataInvalid(f"{n} values don't fill rows of {sum(lengths)} in all")
        return cls(partition_indices(df, lengths, index), value)

    def to_nested(self) -> DataFrame:
        """traj_id, values. One array must hold a whole row."""
        pairs = F.sort_array(F.collect_list(F.struct("frame", "value")))
        return self.df.groupBy("traj_id").agg(F.transform(pairs, lambda p: p["value"]).alias("values"))

    def lengths(self) -> DataFrame:
        return self.df.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))

    def starts(self) -> DataFrame:
        """traj_id, n, start: values in all rows before."""
        return running_total(self.lengths(), "traj_id", "n", "start")

    def shape(self) -> DataFrame:
        """One row: n_rows, n_values, and n_columns, null if rows differ."""
        n = self.lengths().agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_values"), F.min("n").alias("a"), F.max("n").alias("b"))
        return n.select("n_rows", "n_values", F.when(F.col("a") == F.col("b"), F.col("a")).alias("n_columns"))

    def _sized(self) -> DataFrame:
        return self.df.join(self.lengths(), "traj_id")

    def select(self, rows: int | slice | Iterable[int] | None = None, cols: int | slice | Iterable[int] | None = None) -> Ragged:
        """Rows and columns by number, slice or list, as a product. Negative columns count from each row's own end.

        A slice's stop is clipped to the row; single negative rows count from the last row.
        """
        df = self._sized()
        if rows is not None:
            df = df.where(self._rows(rows))
        if cols is not None:
            df = df.where(_columns(cols))
        return Ragged(df)

    def _rows(self, rows: int | slice | Iterable[int]) -> Column:
        if not isinstance(rows, slice):
            rows = [rows] if isinstance(rows, int) else list(rows)
            if all(r >= 0 for r in rows):
                return F.col("traj_id").isin(rows)
        elif min(rows.start or 0, rows.stop or 0) >= 0:
            return _span(F.col("traj_id"), rows, F.lit(2**62))
        n = self.lengths().count()
        if isinstance(rows, slice):
            return F.col("traj_id").between((span := range(*rows.indices(n))).start, span.stop - 1) & ((F.col("traj_id") - span.start) % span.step == 0)
        found = [r + n if r < 0 else r for r in rows]
        if min(found) < 0:
            raise IndexError(rows)
        return F.col("traj_id").isin(found)

    def where(self, predicate: Callable[[Column], Column] | None = None) -> DataFrame:
        """traj_id, frame of the values that are true, or for which the predicate holds."""
        return self.df.where(predicate(F.col("value")) if predicate else F.col("value").cast("boolean")).select(*KEY)

    def mask(self, other: Ragged) -> Ragged:
        """Values where a boolean table of the same keys is true; frames keep their numbers."""
        return Ragged(self.df.join(other.df.where("value").select(*KEY), KEY, "left_semi"))

    def set_where(self, predicate: Column, value: Column) -> Ragged:
        """Assignment: value where the predicate over traj_id, frame and value holds."""
        return Ragged(self.df.withColumn("value", F.when(predicate, value).otherwise(F.col("value"))))

    def map(self, f: Callable[[Column], Column]) -> Ragged:
        return Ragged(self.df.withColumn("value", f(F.col("value"))))

    def map_operator(self, f: Callable[[Column, Column], Column], other: object) -> Ragged:
        """f(value, other): with a scalar or Column, or with another table on equal keys."""
        if not isinstance(other, Ragged):
            return self.map(lambda v: f(v, other if isinstance(other, Column) else F.lit(other)))
        both = self.df.join(other.df.withColumnRenamed("value", "__other"), KEY)
        return Ragged(both.withColumn("value", f(F.col("value"), F.col("__other"))))

    def aggregate(self) -> DataFrame:
        """One row: all_true, any_true, min_value, max_value."""
        true = F.col("value").cast("boolean")
        return self.df.agg(F.bool_and(true).alias("all_true"), F.bool_or(true).alias("any_true"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))

    def all(self) -> bool:
        return self.aggregate().first().all_true

    def any(self) -> bool:
        return self.aggregate().first().any_true

    def min(self):
        return self.aggregate().first().min_value

    def max(self):
        return self.aggregate().first().max_value

    def append(self, other: Ragged) -> Ragged:
        """Other's rows after the last own row."""
        last = self.df.agg(F.coalesce(F.max("traj_id") + 1, F.lit(0)).alias("__next"))
        moved = other.df.crossJoin(F.broadcast(last)).select((F.col("traj_id") + F.col("__next")).alias("traj_id"), "frame", "value")
        return Ragged(self.df.unionByName(moved))

    def flatten(self) -> DataFrame:
        """flat, value: each value with its index when all rows are put end to end."""
        return self.df.join(self.starts().select("traj_id", "start"), "traj_id").select((F.col("start") + F.col("frame")).alias("flat"), "value")

    def zeros_like(self) -> Ragged:
        return Ragged(self.df.withColumn("value", F.lit(0).cast(self.df.schema["value"].dataType)))

    def equal(self, other: Ragged) -> bool:
        """The same keys and values."""
        return self.df.exceptAll(other.df).isEmpty() and other.df.exceptAll(self.df).isEmpty()

    def __len__(self) -> int:
        return self.lengths().count()

    def __getitem__(self, at):
        return self.mask(at) if isinstance(at, Ragged) else self.select(*at) if isinstance(at, tuple) else self.select(at)

    def __invert__(self):
        boolean = self.df.schema["value"].dataType.typeName() == "boolean"
        return self.map(lambda v: ~v if boolean else F.bitwise_not(v))

    __hash__ = None
    __eq__ = lambda self, o: self.map_operator(lambda a, b: a == b, o)
    __ne__ = lambda self, o: self.map_operator(lambda a, b: a != b, o)
    __lt__ = lambda self, o: self.map_operator(lambda a, b: a < b, o)
    __le__ = lambda self, o: self.map_operator(lambda a, b: a <= b, o)
    __gt__ = lambda self, o: self.map_operator(lambda a, b: a > b, o)
    __ge__ = lambda self, o: self.map_operator(lambda a, b: a >= b, o)
    __add__ = __radd__ = lambda self, o: self.map_operator(lambda a, b: a + b, o)
    __mul__ = __rmul__ = lambda self, o: self.map_operator(lambda a, b: a * b, o)
    __sub__ = lambda self, o: self.map_operator(lambda a, b: a - b, o)
    __rsub__ = lambda self, o: self.map_operator(lambda a, b: b - a, o)
    __truediv__ = lambda self, o: self.map_operator(divide, o)
    __rtruediv__ = lambda self, o: self.map_operator(lambda a, b: divide(b, a), o)
    __floordiv__ = lambda self, o: self.map_operator(lambda a, b: F.floor(a / b), o)
    __rfloordiv__ = lambda self, o: self.map_operator(lambda a, b: F.floor(b / a), o)
    __pow__ = lambda self, o: self.map_operator(F.pow, o)
    __rpow__ = lambda self, o: self.map_operator(lambda a, b: F.pow(b, a), o)
    __mod__ = lambda self, o: self.map_operator(floored_mod, o)
    __rmod__ = lambda self, o: self.map_operator(lambda a, b: floored_mod(b, a), o)
    __and__ = lambda self, o: self.map_operator(_bits("bitwiseAND", lambda a, b: a & b, self), o)
    __or__ = lambda self, o: self.map_operator(_bits("bitwiseOR", lambda a, b: a | b, self), o)
    __xor__ = lambda self, o: self.map_operator(_bits("bitwiseXOR", lambda a, b: a != b, self), o)


def _bits(name: str, boolean: Callable[[Column, Column], Column], of: Ragged) -> Callable[[Column, Column], Column]:
    return boolean if of.df.schema["value"].dataType.typeName() == "boolean" else lambda a, b: getattr(a, name)(b)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: a signed infinity or NaN over zero."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def floored_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    return F.when(b > 0, F.pmod(a, b)).otherwise(-F.pmod(-a, -b))


def _span(x: Column, s: slice, n: Column) -> Column:
    """Whether an index is in a slice of n; both ends may be negative."""
    end = lambda v: F.lit(v) if v >= 0 else F.greatest(n + v, F.lit(0))
    step = s.step or 1
    if step < 1:
        raise IndexError("slices of ragged rows go forward")
    start = end(s.start or 0)
    inside = (x >= start) & (x < n)
    if s.stop is not None:
        inside = inside & (x < end(s.stop))
    return inside & ((x - start) % step == 0) if step > 1 else inside


def _columns(cols: int | slice | Iterable[int]) -> Column:
    frame, n = F.col("frame"), F.col("n")
    if isinstance(cols, slice):
        return _span(frame, cols, n)
    cols = [cols] if isinstance(cols, int) else list(cols)
    out = frame.isin([c for c in cols if c >= 0])
    if negative := [c for c in cols if c < 0]:
        out = out | (frame - n).isin(negative)
    return out


def renumbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with frame counted anew within each trajectory."""
    return df.withColumn("frame", (F.row_number().over(Window.partitionBy("traj_id").orderBy(*order)) - 1).cast("long"))


def _starts(df: DataFrame, lengths: list[int]) -> DataFrame:
    rows, at = [], 0
    for k, n in enumerate(lengths):
        rows.append((k, at, at + n))
        at += n
    return df.sparkSession.createDataFrame(rows, "traj_id long, start long, stop long")


def partition_indices(df: DataFrame, lengths: list[int] | DataFrame, index: str = "flat") -> DataFrame:
    """df with traj_id and frame of each flat index, given rows of these lengths. What lies outside is dropped.

    lengths: a list, or a table (traj_id, start, n). A row's values are found by blocks of indices, an equi-join with one exact check.
    """
    spans = _starts(df, lengths) if isinstance(lengths, list) else lengths.select("traj_id", "start", (F.col("start") + F.col("n")).alias("stop"))
    spans = spans.where("stop > start").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("stop") - 1) / BLOCK))))
    keyed = df.withColumn("__b", F.floor(F.col(index) / BLOCK))
    found = keyed.join(spans, "__b").where((F.col(index) >= F.col("start")) & (F.col(index) < F.col("stop")))
    return found.withColumn("frame", F.col(index) - F.col("start")).drop("__b", "start", "stop")


def partition_list(df: DataFrame, lengths: list[int], index: str = "flat") -> DataFrame:
    """As partition_indices, but the lengths must add up to the rows."""
    if (n := df.count()) != sum(lengths):
        raise DataInvalid(f"{n} rows don't split into {sum(lengths)}")
    return partition_indices(df, lengths, index)


def to_flat(df: DataFrame, starts: DataFrame) -> DataFrame:
    """df with flat index of (traj_id, frame); frames outside their row are an error."""
    both = df.join(starts.select("traj_id", "start", F.col("n").alias("__n")), "traj_id")
    ok = (F.col("frame") >= 0) & (F.col("frame") < F.col("__n"))
    return both.withColumn("flat", F.when(ok, F.col("start") + F.col("frame")).otherwise(F.raise_error(F.lit("frame outside its row")).cast("long"))).drop("start", "__n")


def nonnegative(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """df (traj_id, frame) with negative frames counted from their row's end; still negative ones are an error."""
    own = df.join(lengths.select("traj_id", F.col("n").alias("__n")), "traj_id")
    moved = F.when(F.col("frame") < 0, F.col("frame") + F.col("__n")).otherwise(F.col("frame"))
    return own.withColumn("frame", F.when(moved >= 0, moved).otherwise(F.raise_error(F.lit("index out of range")).cast("long"))).drop("__n")


def divide_chunks(df: DataFrame, index: str, size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(index) / size).cast("long"))


def compute_batches(lengths: list[int], batch_size: int) -> list[list[int]]:
    """In order, a new batch begins where the sum would reach the size."""
    out: list[list[int]] = [[]]
    for k, n in enumerate(lengths):
        if out[-1] and sum(lengths[j] for j in out[-1]) + n >= batch_size:
            out.append([])
        out[-1].append(k)
    return out


def merge_histograms(df: DataFrame, bin_: str = "bin", n: str = "n", weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """Weighted sum of histograms on one grid; missing bins are empty."""
    value = F.col(n) * F.col(weight) if weight else F.col(n)
    return df.groupBy(*by, bin_).agg(F.sum(value).alias(n))


def make_distribution(df: DataFrame, by: list[str], n: str = "n", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """df with p, the share within its group, and the bin's middle."""
    total = df.groupBy(*by).agg(F.sum(n).alias("__all"))
    return df.join(total, by).withColumn("p", F.try_divide(n, "__all")).withColumn("middle", (F.col(lo) + F.col(hi)) / 2).drop("__all")


def unique_states(df: DataFrame) -> DataFrame:
    return df.where("state <> -1").select("state").distinct()
