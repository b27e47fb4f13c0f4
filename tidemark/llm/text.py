"""Texts of an Arrow column as one byte buffer: words, their hashes and n-grams by whole-array arithmetic.

Words are the longest runs of bytes other than 0x20 and 0x09 to 0x0D. A word's hash is a polynomial in a random odd
base modulo 2**64 over random values of its bytes, taken from running sums, and mixed; hashes of word n-grams are
polynomials over the words' hashes. Two independent hashes together have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64


#: The multipliers of a published 64-bit finaliser.
SPREAD = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * SPREAD[0]
    x = x ^ (x >> U(33))
    x = x * SPREAD[1]
    return x ^ (x >> U(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.r_[np.ones(1, U), np.full(size - 1, b, U)]) for b in (self.base, self.inverse))
        return self.up, self.down


class Hasher:
    def __init__(self, seed: int, lower: bool = False):
        random = np.random.default_rng(seed)
        self.values = random.integers(0, 1 << 64, 256, U, endpoint=False)
        if lower:
            self.values[ord("A") : ord("Z") + 1] = self.values[ord("a") : ord("z") + 1]
        self.powers = Powers(int(random.integers(1 << 62, dtype=np.int64)) << 1 | 1)
        self.step = U(int(random.integers(1 << 62, dtype=np.int64)) << 1 | 1)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]."""
        up, down = self.powers.to(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(self.values[data] * up[: len(data)], out=total[1:])
        return self.mixed(total, down, starts, ends)

    def mixed(self, total: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of start:end, from running sums over the data."""
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))

    def grams(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k words from each word on; the last k - 1 words begin none."""
        n = max(len(words) - k + 1, 0)
        total = np.zeros(n, U)
        for i in range(k):
            total *= self.step
            total += words[i : i + n]
        return mix(total + U(k))


@lru_cache(maxsize=16)
def hasher(seed: int, lower: bool = False) -> Hasher:
    """The worker's own hasher of a seed, with its powers."""
    return Hasher(seed, lower)


@dataclass
class Slice:
    """Some documents: their bytes, each followed by a newline, and their words."""

    first: int
    data: np.ndarray
    begins: np.ndarray  # of each document in data, and the end of data
    starts: np.ndarray  # of words
    ends: np.ndarray
    bounds: np.ndarray  # of each document among the words

    @property
    def doc(self) -> np.ndarray:
        """Each word's document."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return pc.fill_null(column.cast(pa.large_string()), "")


def laid_out(column: pa.Array, words: bool = True, size: int = 1 << 20) -> Iterator[Slice]:
    """The texts of a column (from text_column) in slices of about `size` bytes; a longer text has its own slice."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n, lo + (1 << 16))
        begins = offsets[lo : hi + 1] - offsets[lo] + np.arange(hi - lo + 1)
        out = np.full(int(begins[-1]), 10, np.uint8)
        own = np.ones(len(out), bool)
        own[begins[1:] - 1] = False
        out[own] = data[offsets[lo] : offsets[hi]]
        starts = ends = np.zeros(0, np.int64)
        if words:
            inside = ~SPACE[out]
            edge = np.diff(inside, prepend=False)
            at = np.flatnonzero(edge)
            starts, ends = at[::2], at[1::2]
        yield Slice(lo, out, begins, starts, ends, np.searchsorted(starts, begins))
        lo = hi
