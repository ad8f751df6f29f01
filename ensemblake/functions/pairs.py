"""Counts of pairs of (feature, state) within frames, as products of indicator matrices, a task at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of the table of counts that a task keeps; beyond, it hands on what it has and starts anew.
KEPT = 1 << 25
#: Cells of the frames that are counted at once, and columns of a block of a product.
TOGETHER, BLOCK = 1 << 20, 2048
#: Where features have more states each than this, pairs are counted one by one instead: the matrices would be nearly empty.
WIDE = 64


class Columns:
    """Numbers of the (feature, state) pairs met so far."""

    def __init__(self):
        self.known: dict[tuple, int] = {}

    def of(self, cells: pa.StructArray) -> np.ndarray:
        feature, state = (pc.dictionary_encode(cells.field(k), null_encoding="encode") for k in (0, 1))
        n = len(state.dictionary)
        code = feature.indices.to_numpy().astype(np.int64) * n + state.indices.to_numpy()
        each, at = np.unique(code, return_inverse=True)
        features, states = feature.dictionary.to_pylist(), state.dictionary.to_pylist()
        number = [self.known.setdefault((features[c // n], states[c % n]), len(self.known)) for c in each.tolist()]
        return np.array(number, np.int64)[at]


class Side:
    """The cells of some frames: which frame each is in, its column, its weight."""

    def __init__(self, lists: pa.ListArray, columns: Columns, weighted: bool):
        cells, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.frame, self.column, self.sizes = np.repeat(np.arange(len(lists)), sizes), columns.of(cells), sizes
        self.weight = cells.field(2).to_numpy(zero_copy_only=False) if weighted else None

    def matrix(self, n: int, a: int, z: int, weighted: bool) -> np.ndarray:
        """n frames x columns [a, z)."""
        inside = slice(None) if a == 0 and z > self.column.max(initial=-1) else np.flatnonzero((self.column >= a) & (self.column < z))
        at = self.frame[inside] * (z - a) + self.column[inside] - a
        return np.bincount(at, self.weight[inside] if weighted else None, n * (z - a)).reshape(n, z - a).astype(np.float64)


class Counts:
    def __init__(self, weighted: bool, both: bool):
        self.weighted, self.both = weighted, both
        self.reset()

    def reset(self) -> None:
        self.left = Columns()
        self.right = Columns() if self.both else self.left
        self.total = np.zeros((0, 0))

    def add(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """Counts a batch; yields what isn't kept as (columns of both sides, counts)."""
        n = batch.num_rows
        for again in (False, True):
            a = Side(batch.column(0), self.left, self.weighted)
            b = Side(batch.column(1), self.right, False) if self.both else a
            p, q = len(self.left.known), len(self.right.known)
            if p * q <= KEPT or again:
                break
            yield from self.kept()
            self.reset()
        wide = min(p / max(1, a.sizes.max(initial=1)), q / max(1, b.sizes.max(initial=1))) > WIDE
        if p * q > KEPT or wide:
            yield from self.one_by_one(a, b, q) if wide else self.blocks(a, b, n, p, q)
            return
        if self.total.shape != (p, q):
            grown = np.zeros((p, q))
            grown[: self.total.shape[0], : self.total.shape[1]] = self.total
            self.total = grown
        left = a.matrix(n, 0, p, self.weighted)
        self.total += left.T @ (left if b is a and not self.weighted else b.matrix(n, 0, q, False))

    def blocks(self, a: Side, b: Side, n: int, p: int, q: int) -> Iterator[tuple]:
        for s in range(0, p, BLOCK):
            left = a.matrix(n, s, min(p, s + BLOCK), self.weighted)
            for t in range(0, q, BLOCK):
                found = left.T @ b.matrix(n, t, min(q, t + BLOCK), False)
                u, v = np.nonzero(found)
                yield u + s, v + t, found[u, v]

    def one_by_one(self, a: Side, b: Side, q: int) -> Iterator[tuple]:
        """Every pair of a frame's cells, some frames at a time."""
        pairs = a.sizes.astype(np.int64) * b.sizes
        part = np.cumsum(pairs) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(pairs)]
        first = [np.concatenate(([0], np.cumsum(x.sizes))) for x in (a, b)]
        for s, t in pairwise(cuts):
            i = np.repeat(np.arange(first[0][s], first[0][t]), np.repeat(b.sizes[s:t], a.sizes[s:t]))
            frame = a.frame[i]
            start = np.cumsum(np.concatenate(([0], pairs[s:t])))[frame - s]
            j = first[1][frame] + (np.arange(len(i)) - start) % b.sizes[frame]
            each, at = np.unique(a.column[i] * q + b.column[j], return_inverse=True)
            yield each // q, each % q, np.bincount(at, a.weight[i] if self.weighted else None)

    def kept(self) -> Iterator[tuple]:
        u, v = np.nonzero(self.total)
        if len(u):
            yield u, v, self.total[u, v]


def pair_counts(weighted: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows (a[, b]) of frames, lists of (feature, state[, weight]): (fa, fb, u, v, n) of all pairs of a cell of a with one of b (of a, if there is no b)."""

    def rows(now: Counts, found: tuple, schema: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        sides = [list(zip(*c.known, strict=True)) or [(), ()] for c in (now.left, now.right)]
        values = [pa.array(x, schema[2 * s + k]) for s, side in enumerate(sides) for k, x in enumerate(side)]
        for k in range(0, len(found[0]), TOGETHER):
            u, v, n = (x[k : k + TOGETHER] for x in found)
            u, v = pa.array(u), pa.array(v)
            count = pa.array(n, pa.float64()) if weighted else pa.array(np.rint(n).astype(np.int64))
            yield pa.RecordBatch.from_arrays([values[0].take(u), values[2].take(v), values[1].take(u), values[3].take(v), count], names=["fa", "fb", "u", "v", "n"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = None, []
        for batch in batches:
            if now is None:
                now = Counts(weighted, batch.num_columns == 2)
                cells = [batch.column(k).type.value_type for k in ((0, 1) if now.both else (0, 0))]
                schema = [c.field(k).type for c in cells for k in (0, 1)]
            sizes = np.maximum(1, pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
            step = max(1, TOGETHER // int(sizes.max(initial=1)))
            for k in range(0, batch.num_rows, step):
                for found in now.add(batch.slice(k, step)):
                    yield from rows(now, found, schema)
        if now is not None:
            for found in now.kept():
                yield from rows(now, found, schema)

    return work
