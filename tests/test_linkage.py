"""Single linkage of points, and components, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblake.operators import graph, pockets

SCHEMA = "frame int, id long, px double, py double, pz double"


def linkage(points, reach):
    """id: the smallest id it is connected to, point by point."""
    rows = [p for p in points if None not in p and not np.isnan(p[2:]).any()]
    root = {p[1]: p[1] for p in points}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    at = np.array([p[2:] for p in rows])
    for x, p in enumerate(rows):
        near = ((at - at[x]) ** 2).sum(axis=1) <= reach * reach
        for y in np.flatnonzero(near):
            if rows[y][0] == p[0]:
                a, b = top(p[1]), top(rows[y][1])
                root[max(a, b)] = min(a, b)
    return {k: top(k) for k in root}


@pytest.mark.parametrize("spread, reach", [(1.0, 0.12), (1.0, 0.3), (0.4, 0.08)])
def test_components_of_points(spark, spread, reach):
    rng = np.random.default_rng(8)
    points = [(f, f * 1000 + k, *p) for f in (0, 1) for k, p in enumerate((rng.normal(size=(400, 3)) * spread).tolist())]
    points += [(0, 5000, None, 1.0, 1.0), (0, 5001, None, 1.0, 1.0), (1, 5002, float("nan"), 0.0, 0.0), (0, 5003, *points[0][2:]), (1, 5004, -9.0, 0.0, 0.0)]
    df = spark.createDataFrame(points, SCHEMA)
    assert dict(pockets.single_linkage(df, reach).select("id", "component").collect()) == linkage(points, reach)


def test_cells_whose_ends_are_apart(spark):
    """Two dense cells meet at points that are no cell's outermost in any axis; a third is close, but not close enough."""
    side = 1 / 3**0.5
    ring = lambda x, r: [(0, x, 0.28 + r * np.cos(t), 0.28 + r * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 60)]
    rows = ring(0.01, 0.25) + [(0, 0.02, 0.45, 0.12)] + [(0, 2 * side - 0.16, 0.46, 0.13)] + [(0, 2 * side - 0.14, y, z) for y in (0.02, 0.55) for z in (0.02, 0.55)]
    points = [(f, k, float(x), float(y), float(z)) for k, (f, x, y, z) in enumerate(rows)]
    points += [(0, 900, 0.3, 0.3, 3.0), (0, 901, 0.3, 0.3, 4.0 + 1e-7)]
    for reach in (0.98, 0.99, 1.0, 1.05):
        assert dict(pockets.single_linkage(spark.createDataFrame(points, SCHEMA), reach).collect()) == linkage(points, reach)


def test_links_grow_with_cells_not_with_pairs(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(0, k, *p) for k, p in enumerate(rng.uniform(0, 1, (20_000, 3)).tolist())], SCHEMA)
    cells = pockets._cells(pockets._places(df, 0.5, ["frame"]), ["frame"])
    n = cells.count()
    assert n <= 4**3 and pockets._near_cells(cells, 0.5, ["frame"]).count() <= 62 * n
    assert pockets.single_linkage(df, 0.5).select("component").distinct().count() == 1


def test_few_and_many_links_agree(spark):
    rng = np.random.default_rng(10)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(400, 460)]
    links = spark.createDataFrame([*rows, (7, None)], "a long, b long")
    nodes = spark.range(500)
    few = dict(graph.components(links, nodes).collect())
    assert few == dict(graph.components(links, nodes, few=0).collect())
    named = lambda df: df.select(*(F.format_string("%03d", c).alias(c) for c in df.columns))
    strings = dict(graph.components(named(links.dropna()), named(nodes)).collect())
    assert {int(k): int(v) for k, v in strings.items()} == few
    assert graph.components(links.limit(0), nodes).where("id <> component").isEmpty()
