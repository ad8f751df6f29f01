"""Connected components of large graphs, with DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import workers_can_import, written

FEW_LINKS = 100_000


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of all links as (a, b): each node and the smallest one it is connected to, which is passed on along links and jumped to."""
    links = list(batches)
    if not links:
        return
    table = pa.Table.from_batches(links)
    names, at = np.unique(np.concatenate([c.to_numpy() for c in table.columns]), return_inverse=True)
    a, b = at[: len(table)], at[len(table) :]
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(new, end, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    kinds = table.schema.field(0).type
    yield pa.RecordBatch.from_arrays([pa.array(names, kinds), pa.array(names[root], kinds)], names=["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, nodes: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """id, component (the smallest id it is connected to) of nodes (id), by links (a, b) of which loops and nulls don't count.

    Every round hangs what a node sees onto the smallest node it sees, first for larger, then for smaller neighbours, so a chain is halved again and
    again instead of walked along. A round is two joins and aggregates on node ids and is written to the shared folder. Up to `few` links, counted first, one task
    does the same over flat arrays.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if edges.count() <= few:
        workers_can_import(edges.sparkSession)
        edges = written(edges.coalesce(1).mapInArrow(_connected, edges.schema), "connected")
        return nodes.select("id").join(edges.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    before = None
    while (state := _state(edges)) != before and state[0]:
        before = state
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = seen.join(root, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        up = written(up, "larger")
        root = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(down.unionByName(root.select("a", F.col("m").alias("b"))).distinct(), "smaller")
    return nodes.select("id").join(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))
