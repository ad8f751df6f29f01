"""Pockets: grid cells between parts of a protein, and their connected groups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written
from .graph import components

CELL = ["x", "y", "z"]


def create_grid(atoms: DataFrame, spacing: float, padding: int = 0, by: list[str] = ("frame",)) -> DataFrame:
    """by, x, y, z (indices), px, py, pz (places): a regular grid over each frame's atoms, and padding cells on each side."""
    ends = atoms.groupBy(*by).agg(*(f(c).alias(f"{n}{c}") for c in CELL for n, f in (("lo", F.min), ("hi", F.max))))
    count = lambda c: (F.ceil((F.col(f"hi{c}") - F.col(f"lo{c}")) / spacing) + 2 * padding).cast("int")
    grid = ends
    for c in CELL:
        grid = grid.withColumn(f"i{c}", F.explode(F.sequence(F.lit(0), count(c))))
    return grid.select(*by, *(F.col(f"i{c}").alias(c) for c in CELL), *((F.col(f"lo{c}") + (F.col(f"i{c}") - padding) * spacing).alias(f"p{c}") for c in CELL))


def near_points(points: DataFrame, atoms: DataFrame, place: list[str], reach: Column, cell: float, by: list[str]) -> DataFrame:
    """Pairs of a point and an atom of one frame at a distance under `reach` (a column of atoms).

    A range join as an equi-join: space is cut into cells at least as wide as the longest reach, each atom looks in its own and the 26 around.
    """
    bin_ = lambda v: F.floor(v / cell).cast("int")
    around = F.array(*(F.struct(*(F.lit(d).alias(c) for d, c in zip(ds, ("dx", "dy", "dz")))) for ds in ((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    own = points.select("*", *(bin_(F.col(p)).alias(f"__b{c}") for p, c in zip(place, CELL)))
    other = atoms.select(*by, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), reach.alias("__reach"), F.explode(around).alias("d"))
    other = other.select("*", *((bin_(F.col(f"a{c}")) + F.col(f"d.d{c}")).alias(f"__b{c}") for c in CELL)).drop("d")
    d2 = sum((F.col(p) - F.col(f"a{c}")) * (F.col(p) - F.col(f"a{c}")) for p, c in zip(place, CELL))
    return own.join(other, [*by, "__bx", "__by", "__bz"]).where(d2 < F.col("__reach") * F.col("__reach")).drop("__bx", "__by", "__bz", "__reach", "ax", "ay", "az")


def touches_protein(grid: DataFrame, atoms: DataFrame, probe_radius: float, most_radius: float, by: list[str] = ("frame",)) -> DataFrame:
    """grid with touch, 1 where a cell is within an atom's radius and the probe's. most_radius bounds column `radius` of atoms."""
    by = list(by)
    hit = near_points(grid, atoms, ["px", "py", "pz"], F.col("radius") + probe_radius, most_radius + probe_radius, by).select(*by, *CELL).distinct().withColumn("touch", F.lit(1))
    return grid.join(hit, [*by, *CELL], "left").withColumn("touch", F.coalesce("touch", F.lit(0)))


def _between(line: list[str], order: str, by: list[str]) -> Column:
    """1 for an empty cell with touching ones before and after it on its line."""
    w = Window.partitionBy(*by, *line)
    at = F.when(F.col("touch") == 1, F.col(order))
    return F.coalesce(((F.col("touch") == 0) & (F.min(at).over(w) < F.col(order)) & (F.max(at).over(w) > F.col(order))).cast("int"), F.lit(0))


def ranks(touched: DataFrame, by: list[str] = ("frame",)) -> DataFrame:
    """touched with rank: on how many of three axes and four families of diagonals a cell lies between protein.

    Diagonals run with all indices rising. The three faces they start from share no line but one: those from the edge x = y = 0, z > 0 aren't scanned.
    """
    by = list(by)
    own = touched.withColumn("__p", F.col("x") - F.col("z")).withColumn("__q", F.col("y") - F.col("z"))
    rank = _between(["y", "z"], "x", by) + _between(["x", "z"], "y", by) + _between(["x", "y"], "z", by)
    skipped = (F.col("__p") == F.col("__q")) & (F.col("__p") < 0)
    diagonal = F.when(skipped, 0).otherwise(_between(["__p", "__q"], "z", by))
    return own.withColumn("rank", rank + diagonal).drop("__p", "__q")


def all_ranks(touched: DataFrame, by: list[str] = ("frame",)) -> DataFrame:
    """As ranks, with the other three families of diagonals: y, x, or both reversed."""
    by = list(by)
    top = touched.groupBy(*by).agg(F.max("x").alias("__mx"), F.max("y").alias("__my"))
    own = touched.join(top, by)
    total = ranks(own, by)
    flips = [("x", F.col("x"), F.col("__my") - F.col("y")), ("y", F.col("__mx") - F.col("x"), F.col("y")), ("xy", F.col("__mx") - F.col("x"), F.col("__my") - F.col("y"))]
    for _, fx, fy in flips:
        total = total.withColumn("__p", fx - F.col("z")).withColumn("__q", fy - F.col("z"))
        skipped = (F.col("__p") == F.col("__q")) & (F.col("__p") < 0)
        total = total.withColumn("rank", F.col("rank") + F.when(skipped, 0).otherwise(_between(["__p", "__q"], "z", by)))
    return total.drop("__p", "__q", "__mx", "__my")


def pocket_cells(atoms: DataFrame, grid_spacing: float = 0.1, probe_radius: float = 0.07, min_rank: int = 3, most_radius: float = 0.2, by: list[str] = ("frame",)) -> DataFrame:
    grid = create_grid(atoms, grid_spacing, 0, by)
    return all_ranks(touches_protein(grid, atoms, probe_radius, most_radius, by), by).where(F.col("rank") >= min_rank)


def _places(points: DataFrame, reach: float, by: list[str]) -> DataFrame:
    """points with their cell, a cube so small that all its points are within reach of each other, and `apart`: the id of a point without a place."""
    side = reach / 3**0.5 * (1 - 1e-9)
    sum_ = F.col("px") + F.col("py") + F.col("pz")
    own = points.select(*by, "id", *(F.col(f"p{c}").cast("double").alias(f"p{c}") for c in CELL), F.when(sum_.isNull() | F.isnan(sum_), F.col("id")).alias("apart"))
    return own.select("*", *(F.when(F.col("apart").isNull(), F.floor(F.col(f"p{c}") / side)).alias(f"c{c}") for c in CELL))


def _cells(places: DataFrame, by: list[str]) -> DataFrame:
    """by, cell (the smallest id in it), its place, how many points, the box around them and those at its ends."""
    ends = [f(F.struct("px", "py", "pz"), F.col(f"p{c}")) for c in CELL for f in (F.min_by, F.max_by)]
    box = [f(F.col(f"p{c}")).alias(f"{n}{c}") for c in CELL for n, f in (("lo", F.min), ("hi", F.max))]
    return places.groupBy(*by, "cx", "cy", "cz", "apart").agg(F.min("id").alias("cell"), F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(*ends)).alias("ends"), *box)


def _near_cells(cells: DataFrame, reach: float, by: list[str]) -> DataFrame:
    """(a, b, linked) of pairs of cells: linked where two of the points at their ends are within reach; else points between may be, by the boxes around them.

    Points within reach are at most two cells apart, so each cell asks half of the 124 around it.
    """
    half = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    around = F.array(*(F.struct(*(F.lit(d).cast("long").alias(c) for d, c in zip(ds, CELL))) for ds in half))
    box = [f"{n}{c}" for c in CELL for n in ("lo", "hi")]
    asked = cells.select(*by, F.col("cell").alias("a"), F.col("n").alias("na"), F.col("ends").alias("ea"), *(F.col(c).alias(f"a{c}") for c in box), "cx", "cy", "cz", F.explode(around).alias("d"))
    asked = asked.select(*by, "a", "na", "ea", *(f"a{c}" for c in box), *((F.col(f"c{c}") + F.col(f"d.{c}")).alias(f"c{c}") for c in CELL))
    both = asked.join(cells, [*by, "cx", "cy", "cz"])
    gap = [F.greatest(F.lit(0.0), F.col(f"lo{c}") - F.col(f"ahi{c}"), F.col(f"alo{c}") - F.col(f"hi{c}")) for c in CELL]
    both = both.where(sum(g * g for g in gap) <= reach * reach * (1 + 1e-9))
    d2 = lambda x, y: sum((x[f"p{c}"] - y[f"p{c}"]) * (x[f"p{c}"] - y[f"p{c}"]) for c in CELL)
    linked = F.exists("ea", lambda x: F.exists("ends", lambda y: d2(x, y) <= reach * reach))
    both = both.select("a", F.col("cell").alias("b"), linked.alias("linked"), "na", "n", F.size("ea").alias("ka"), F.size("ends").alias("kb"))
    return both.where("linked OR ka < na OR kb < n").select("a", "b", "linked")


def single_linkage(points: DataFrame, reach: float, by: list[str] = ("frame",)) -> DataFrame:
    """id, component (the smallest id it is connected to) of points (by, id, px, py, pz): those within reach are connected; ids are of one point of one `by`.

    A cell's points are one node, so links are as many as cells, however many points these hold. Most cells are told to be linked, or not, by their boxes and the points
    at their ends. Only pairs that aren't, and that nothing else has connected, have their points compared.
    """
    by = list(by)
    places = _places(points, reach, by)
    cells = written(_cells(places, by), "cells")
    near = written(_near_cells(cells, reach, by), "near")
    nodes = cells.select(F.col("cell").alias("id"))
    found = components(near.where("linked").select("a", "b"), nodes)
    open_ = near.where("NOT linked")
    if not open_.isEmpty():
        found = written(found, "linked")
        a, b = (found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
        open_ = written(open_.join(a, "a").join(b, "b").where("ca <> cb").select("a", "b", "ca", "cb"), "open")
        asked = open_.select(F.col("a").alias("cell")).union(open_.select("b")).distinct()
        keys = [*by, "cx", "cy", "cz"]
        inside = places.join(cells.join(asked, "cell").select(*keys, "cell"), keys).select("cell", "px", "py", "pz").distinct()
        one, other = (inside.select(F.col("cell").alias(c), *(F.col(f"p{x}").alias(f"{c}{x}") for x in CELL)) for c in "ab")
        d2 = sum((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in CELL)
        more = open_.join(one, "a").join(other, "b").where(d2 <= reach * reach).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        last = components(more, found.select(F.col("component").alias("id")).distinct())
        found = found.withColumnRenamed("component", "c").join(last.select(F.col("id").alias("c"), "component"), "c").select("id", "component")
    own = cells.select(*by, "cx", "cy", "cz", "apart", "cell").join(found.withColumnRenamed("id", "cell"), "cell")
    same = reduce(and_, (F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*by, "cx", "cy", "cz", "apart")))
    return places.alias("p").join(own.alias("o"), same).select("p.id", "o.component")


def cluster_points(points: DataFrame, reach: float, by: list[str] = ("frame",), min_size: int = 0, n_clouds: int | None = None) -> DataFrame:
    """points (by, id, px, py, pz) with cluster: single linkage at `reach`, numbered from 0 by falling size (ties: the smallest id), small ones left out."""
    by = list(by)
    found = points.join(single_linkage(points, reach, by), "id")
    sizes = found.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > min_size)
    rank = (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("size"), "component")) - 1).alias("cluster")
    sizes = sizes.select(*by, "component", "size", rank)
    sizes = sizes if n_clouds is None else sizes.where(F.col("cluster") < n_clouds)
    return found.join(sizes, [*by, "component"]).drop("component")


def pockets(atoms: DataFrame, grid_spacing: float = 0.1, probe_radius: float = 0.14, min_rank: int = 5, min_cluster_size: int = 0, most_radius: float = 0.2, by: list[str] = ("frame",)) -> DataFrame:
    """by, cells and their cluster for every frame, in one plan."""
    by = list(by)
    cells = pocket_cells(atoms, grid_spacing, probe_radius, min_rank, most_radius, by)
    names = F.concat_ws(",", *by, *CELL)
    return cluster_points(cells.withColumn("id", names), 1.5 * grid_spacing, by, min_cluster_size)


def as_structures(clustered: DataFrame, structure: str = "frame") -> DataFrame:
    """Points (structure, id, px, py, pz, cluster) as atoms for write_pdb: one residue a cluster, in order of clusters."""
    atom = (F.row_number().over(Window.partitionBy(structure).orderBy("cluster", "id")) - 1).cast("long")
    return clustered.select(F.col(structure).alias("structure"), atom.alias("atom_id"), F.lit("C").alias("name"), F.lit("POC").alias("res_name"), F.lit("A").alias("chain"), F.col("cluster").alias("res_seq"), *(F.col(f"p{c}").alias(c) for c in CELL), F.lit("C").alias("element"))


def radius_of(element: Column) -> Column:
    """Van der Waals radii in nm (Bondi's values, fixed)."""
    table = {"H": 0.12, "C": 0.17, "N": 0.155, "O": 0.152, "S": 0.18, "P": 0.18}
    out = F.lit(0.17)
    for name, r in table.items():
        out = F.when(element == name, F.lit(r)).otherwise(out)
    return out


