"""Exact top-k inner products: a ball tree per shard, best bound first, with the k-th score that a query has reached anywhere shared."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, sized, table, written

#: Components become whole numbers: floor(SCALE * x).
SCALE = 256
#: Components of a shard's vectors, and rows of a leaf. A worker holds one shard at a time.
CELLS, LEAF = 1 << 20, 256
#: Queries that one task puts to one shard; of more, each part goes through the shard in a task of its own.
ASKED = 1 << 16
#: Whole numbers up to here are exact in the arithmetic of vectors; beyond, scores are added up one by one, and held at the ends of a long.
EXACT, LEAST, MOST = 2.0**53, -(2**63), 2**63 - 1

Hits = list[tuple[int, int]]


class BallTree:
    """Rows of whole numbers in nested balls, halved along the line of two far ones; equal rows lie in order of their ids.

    A ball's bound for a query q is q·centre + |q| radius, which no row in it exceeds. Only its first few rows are looked at in a ball of copies.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[self.order], vectors[self.order]
        self.spans: list[tuple[int, int]] = []
        self.below: list[tuple[int, int] | None] = []
        centres, radii, first = [], [], []
        place = np.arange(len(ids))
        self.copies: list[bool] = []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, z, above, side = todo.pop()
            part = place[a:z]
            own = rows[part]
            with np.errstate(all="ignore"):
                centre = own.mean(axis=0)
                far = np.sqrt(((own - centre) ** 2).sum(axis=1))
            me = len(self.spans)
            if above >= 0:
                mine = self.below[above] or (-1, -1)
                self.below[above] = (me, mine[1]) if side == 0 else (mine[0], me)
            same = bool((own == own[0]).all())
            self.spans.append((a, z))
            self.below.append(None)
            self.copies.append(same)
            centres.append(own[0] if same else centre)
            radii.append(0.0 if same else far.max())
            first.append(int(self.ids[part].min()))
            if z - a > leaf and not same:
                with np.errstate(all="ignore"):
                    one = own[np.argmax(far)]
                    line = one - own[np.argmax(((own - one) ** 2).sum(axis=1))]
                    place[a:z] = part[np.argsort(own @ line, kind="stable")]
                middle = (a + z) // 2
                place[a:middle].sort()
                place[middle:z].sort()
                todo += [(a, middle, me, 0), (middle, z, me, 1)]
        self.place, self.rows, self.ids = place, rows[place], self.ids[place]
        self.centres, self.radii, self.first = np.array(centres), np.array(radii), first
        self.largest = float(np.abs(vectors).max(initial=0))
        self.looked = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no score of a query with a ball's rows exceeds; rounding is allowed for."""
        with np.errstate(all="ignore"):
            size = np.sqrt((queries**2).sum(axis=1))[:, None]
            most = queries @ self.centres.T + size * self.radii
            most += 1e-9 * size * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii) + 1e-3
            return np.where(np.isnan(most), np.inf, np.floor(most))

    def scores(self, a: int, z: int, query: np.ndarray, least: int | None, exact: bool) -> Iterator[tuple[int, int]]:
        """(place, score) of a ball's rows, where exact arithmetic is that of vectors only those of at least least."""
        if exact:
            found = self.rows[a:z] @ query
            at = range(z - a) if least is None else np.flatnonzero(found >= least).tolist()
            return ((a + k, int(found[k])) for k in at)
        own = [int(x) for x in query]
        return ((a + k, min(MOST, max(LEAST, sum(int(x) * y for x, y in zip(row, own, strict=True))))) for k, row in enumerate(self.rows[a:z]))

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, reached: tuple[int, int] | None = None, own: int = -1) -> Hits:
        """The k rows of highest score, ties to the smaller id, as (score, id): best balls first, until none can hold a better row than the k-th.

        reached: a k-th hit from elsewhere, which rows must beat. own: place in the tree of a row that is left out.
        """
        exact = self.largest * float(np.abs(query).max(initial=0)) * max(1, len(query)) < EXACT
        best: list[tuple[int, int]] = []  # a heap whose top is the worst: (score, -id)
        worst = None if reached is None else (reached[0], -reached[1])
        todo = [(-bounds[0], self.first[0], 0)]
        while todo:
            most, first, node = heapq.heappop(todo)
            if worst is not None and (max(LEAST, min(MOST, -most)), -first) <= worst:
                break  # no later ball has a higher bound, or as high a one and a smaller id
            if below := self.below[node]:
                for x in below:
                    heapq.heappush(todo, (-bounds[x], self.first[x], x))
                continue
            a, z = self.spans[node]
            if self.copies[node]:
                z = min(z, a + k + 1)
            self.looked += z - a
            for at, score in self.scores(a, z, query, worst and worst[0], exact):
                hit = (score, -int(self.ids[at]))
                if at == own or (worst is not None and hit <= worst):
                    continue
                heapq.heappush(best, hit)
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k:
                    worst = best[0] if worst is None else max(worst, best[0])
        return [(s, -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]


def whole(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(len(column), -1)


def runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows whose first columns, keys of them, are equal."""
    own = np.array([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
    cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    for a, z in pairwise(cuts):
        if z > a:
            yield tuple(own[:, a].tolist()), batch.slice(a, z - a)


HIT = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))


def as_hits(found: list[Hits]) -> pa.Array:
    return pa.array([[{"score": s, "vec_id": i} for s, i in x] for x in found], HIT)


def top_k(vectors: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = CELLS) -> DataFrame:
    """query_id long, rank int from 1, vec_id long, score long: for each row of vectors that is asked, the k other rows of highest inner product.

    Components x count as floor(256 x). All rows are candidates but the query's own row; ties go to the smaller id. Rows without an id, and vectors that are
    null or hold null or non-finite components (or such that 256 x is not finite), take no part; vectors of different lengths are not compared. Ids are whole numbers
    and may repeat: each row that is asked is a query, and other rows of its id are candidates. Scores beyond a long are held at its ends, and tie there.
    No rows, or none that is asked, give an empty result. Columns other than the two are only read by asked, a condition on a row.

    Rows are dealt into shards of a bounded size, by row, so no id or vector that many rows share makes a shard large. First each query searches the
    shard it lies in; with the k-th score reached there it goes to every other shard of its length, where most balls fall below it. Only rows that
    beat it come back.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kind = dict(vectors.dtypes)[vector_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    fine = F.forall(F.col("vector"), lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < float("inf")))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    own = own.where("vec_id is not null and vector is not null").where(fine)
    own = written(own.select(F.monotonically_increasing_id().alias("row"), "vec_id", "asked", F.size("vector").alias("dim"), "vector"), "vectors", "snappy")
    sizes = own.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q")).where("q > 0")
    sizes = written(sizes.select("dim", F.ceil(F.col("n") * F.greatest("dim", F.lit(1)) / cells).alias("shards"), F.ceil(F.col("q") / ASKED).alias("parts")), "sizes")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sizes.agg(F.sum("shards")).first()[0] or 0)
    dealt = own.join(sized(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("row"), "shards"))

    at_home = dealt.select("dim", "shard", "shards", "parts", "row", "vec_id", "asked", "vector").repartition(width, "dim", "shard").sortWithinPartitions("dim", "shard", "row")
    first = f"dim int, shard long, shards long, parts long, row long, query_id long, vector {kind}, hits array<struct<score:long,vec_id:long>>"
    first = written(at_home.mapInArrow(_home(k), first), "at-home", "snappy")
    away = first.where("shards > 1").select("dim", "shards", "parts", "row", "query_id", "vector", "hits", F.col("shard").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    away = away.where("shard <> home").select("dim", "shard", F.pmod(F.xxhash64("row"), "parts").alias("part"), F.lit(1).alias("kind"), "row", F.col("query_id").alias("vec_id"), "vector", "hits")
    there = dealt.where("shards > 1").select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "row", "vec_id", "vector", F.lit(None).cast("array<struct<score:long,vec_id:long>>").alias("hits"))
    both = there.unionByName(away).repartition(width, "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "kind", "row")
    rest = both.mapInArrow(_away(k), "row long, query_id long, hits array<struct<score:long,vec_id:long>>")
    found = first.select("row", "query_id", F.inline("hits")).unionByName(rest.select("row", "query_id", F.inline("hits")))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _home(k: int):
    """Each shard's own queries against the shard."""

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        vectors, asked = whole(rows.column(7)), np.flatnonzero(rows.column(6).to_numpy(zero_copy_only=False))
        if not len(asked):
            return
        tree = BallTree(rows.column(5).to_numpy(), vectors)
        back = np.empty(len(vectors), np.int64)
        back[tree.order[tree.place]] = np.arange(len(vectors))
        for s in range(0, len(asked), 1000):
            some = asked[s : s + 1000]
            bounds = tree.bounds(vectors[some])
            hits = [tree.search(vectors[x], bounds[j], k, own=int(back[x])) for j, x in enumerate(some)]
            own = rows.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in range(6)), own.column(7), as_hits(hits)], names=["dim", "shard", "shards", "parts", "row", "query_id", "vector", "hits"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for batch in batches:
            for key, part in runs(batch, 2):
                if key != now and kept:
                    yield from found(kept)
                    kept = []
                now = key
                kept.append(part)
        if kept:
            yield from found(kept)

    return work


def _away(k: int):
    """Rows of a shard, then the queries of other shards: they search its tree for what beats the k-th hit they bring along."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, tree = None, [], None
        for batch in batches:
            for (*key, kind), part in runs(batch, 4):
                if key != now:
                    now, kept, tree = key, [], None
                if kind == 0:
                    kept.append(part)
                    continue
                if not kept:
                    continue
                if tree is None:
                    tree = BallTree(np.concatenate([x.column(5).to_numpy() for x in kept]), np.concatenate([whole(x.column(6)) for x in kept]))
                    kept = kept[:1]
                queries, brought = whole(part.column(6)), part.column(7).to_pylist()
                bounds = tree.bounds(queries)
                hits = [tree.search(q, b, k, (x[-1]["score"], x[-1]["vec_id"]) if len(x) == k else None) for q, b, x in zip(queries, bounds, brought, strict=True)]
                some = pa.array([j for j, x in enumerate(hits) if x], pa.int64())
                own = part.take(some)
                yield pa.RecordBatch.from_arrays([own.column(4), own.column(5), as_hits([x for x in hits if x])], names=["row", "query_id", "hits"])

    return work


def op12_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
