"""Many generators at once: the numbers of numpy.random.default_rng([seed, k]) for all k of an array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOW32, BITS32, ONE = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(1)
#: PCG64's factor, its two halves.
FACTOR = np.uint64(0x2360ED051FC65DA4), np.uint64(0x4385DF649FCCF645)


def _words(n: int) -> list[int]:
    """A number's 32-bit words, the lowest first; one at least."""
    return [(n >> at) & 0xFFFFFFFF for at in range(0, max(n.bit_length(), 1), 32)]


class _Hash:
    """SeedSequence's hash: its constant goes on from call to call, whatever is hashed."""

    def __init__(self, start: int, factor: int):
        self.now, self.factor = start, factor

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x ^ np.uint32(self.now)
        self.now = self.now * self.factor & 0xFFFFFFFF
        x *= np.uint32(self.now)
        x ^= x >> np.uint32(16)
        return x


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0xCA01F9DD)
    x -= y * np.uint32(0x4973F715)
    x ^= x >> np.uint32(16)
    return x


def _pool(words: list[np.ndarray]) -> list[np.ndarray]:
    """SeedSequence's four words of entropy."""
    hashed, none = _Hash(0x43B0D7E5, 0x931E8875), np.zeros_like(words[0])
    pool = [hashed(w) for w in [*words, none, none, none][:4]]
    for k in range(4):
        for to in range(4):
            if k != to:
                pool[to] = _mixed(pool[to], hashed(pool[k]))
    for w in words[4:]:
        for to in range(4):
            pool[to] = _mixed(pool[to], hashed(w))
    return pool


def _seeds(seed: int, keys: np.ndarray) -> Iterator[np.ndarray]:
    """The four 64-bit numbers that PCG64 starts from, for [seed, key] of each key."""
    own = [np.full(len(keys), w, np.uint32) for w in _words(seed)]
    pool, left = None, keys
    while pool is None or np.any(left > 0):  # keys differ in how many words they have
        own.append((left & 0xFFFFFFFF).astype(np.uint32))
        now = _pool(own)
        pool = now if pool is None else [np.where(left > 0, new, old) for new, old in zip(now, pool, strict=True)]
        left = left >> 32
    hashed = _Hash(0x8B51F9DD, 0x58F38DED)
    state = [hashed(pool[k % 4]).astype(np.uint64) for k in range(8)]
    return (state[k] | state[k + 1] << BITS32 for k in range(0, 8, 2))


class Draws:
    """A generator a key, all of which draw at once. keys: integers, none below 0, of any size as objects."""

    def __init__(self, seed: int, keys: np.ndarray):
        keys = keys.astype({"i": np.int64, "u": np.uint64}.get(keys.dtype.kind, object))
        if seed < 0 or np.any(keys < 0):
            raise ValueError("seeds and keys can't be negative")
        high, low, stream_high, stream_low = _seeds(seed, keys)
        self.step_high, self.step_low = stream_high << ONE | stream_low >> np.uint64(63), stream_low << ONE | ONE
        self.low = low + self.step_low
        self.high = high + self.step_high + (self.low < low)
        self._step()

    @classmethod
    def _of(cls, *parts: np.ndarray) -> Draws:
        out = cls.__new__(cls)
        out.high, out.low, out.step_high, out.step_low = parts
        return out

    def _parts(self) -> tuple[np.ndarray, ...]:
        return self.high, self.low, self.step_high, self.step_low

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, at: np.ndarray) -> Draws:
        return self._of(*(x[at] for x in self._parts()))

    def __add__(self, other: Draws) -> Draws:
        return self._of(*(np.concatenate(x) for x in zip(self._parts(), other._parts(), strict=True)))

    def _step(self) -> None:
        """state = state * FACTOR + step, in 128 bits of two halves each."""
        by_high, by_low = FACTOR
        a, b = self.low & LOW32, self.low >> BITS32
        c, d = by_low & LOW32, by_low >> BITS32
        middle = a * c
        middle >>= BITS32
        middle += b * c
        a *= d
        a += middle & LOW32
        a >>= BITS32
        middle >>= BITS32
        b *= d
        b += a
        b += middle
        self.high *= by_low
        self.high += b
        self.high += self.low * by_high
        self.high += self.step_high
        self.low *= by_low
        self.low += self.step_low
        self.high += self.low < self.step_low

    def random(self) -> np.ndarray:
        """A number from 0 up to 1 of each."""
        self._step()
        x, turn = self.high ^ self.low, self.high >> np.uint64(58)
        x = x >> turn | x << ((np.uint64(64) - turn) & np.uint64(63))
        x >>= np.uint64(11)
        return x * (1.0 / (1 << 53))
