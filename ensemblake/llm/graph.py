"""Connected components with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _changes(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, few: int = 0) -> DataFrame:
    """node, component (its smallest node) of every node on an edge (a, b of one orderable type).

    Alternating large and small stars: each round links what a node sees to the smallest node it sees, so a
    chain of n edges takes about log(n)^2 rounds. Hubs are joined, never gathered: their smallest neighbour is a
    partial aggregate and the join's large side is split where it is skewed. Each round is written to the shared folder.
    Loops and nulls are ignored. Edges that are counted to be at most few take the same rounds in one partition each, without a shuffle: the driver
    keeps a record of every task, and rounds of many near-empty ones fill its memory.
    """
    alone = few > 0 and edges.count() <= few

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.coalesce(1) if alone else rows

    now = written(dealt(edges).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (state := _changes(dealt(now))) != before and state[0]:
        before = state
        both = dealt(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = dealt(written(large, "large-star"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = written(dealt(small).distinct(), "small-star")
    roots = dealt(now).select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
