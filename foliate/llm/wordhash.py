"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy.

A word's hash runs over its bytes in steps of eight, each step mixed whole before the next, so no two words share one by their form; words of over
64 bytes take BLAKE2b. A second hash with another seed makes 128 bits. An n-gram's hash is a polynomial of its words' hashes, mixed, from running
sums, so any n-gram costs a few operations. Texts are taken in slices of about a megabyte, so that a task's arrays stay small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Words of more bytes are hashed by BLAKE2b.
LONG = 64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Seeds of the two word hashes, and odd multipliers for words in either, which so have inverses modulo 2^64.
_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BASES = {1: 0xC2B2AE3D27D4EB4F, 2: 0x165667B19E3779F9}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n or more."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size, base = 1 << (n - 1).bit_length(), _BASES[which]
        made = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[which] = have = tuple(made)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array's rows and n + 1 places in them; null rows are empty."""
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to about `limit` bytes, of one row at least."""
    _, ends = raw(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, to
        at = to


class Bytes:
    """Runs of bytes begin[i] to end[i] of some data, to be hashed and compared eight at a time."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.data, self.begin, self.sizes = data, begin, end - begin
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self._eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def _steps(self, own: np.ndarray | None, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each step of eight bytes, the numbers of the runs (of own, or all) that reach it."""
        sizes = self.sizes if own is None else self.sizes[own]
        some = np.arange(len(sizes))
        for at in range(0, most, 8):
            some = some[sizes[some] > at]
            if not len(some):
                return
            yield at, some

    def _at(self, runs: np.ndarray, at: int) -> np.ndarray:
        return self._eights[self.begin[runs] + at] & _MASKS[np.minimum(self.sizes[runs] - at, 8)]

    def hashes(self, which: int = 0) -> np.ndarray:
        out = mix(self.sizes.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(_SEEDS[which]))
        for at, some in self._steps(None, LONG):
            out[some] = mix(out[some] ^ self._at(some, at))
        for i in np.flatnonzero(self.sizes > LONG):
            own = self.data[self.begin[i] : self.begin[i] + self.sizes[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(own, digest_size=8, salt=bytes([which])).digest(), "little")
        return out

    def equal(self, other: np.ndarray) -> np.ndarray:
        """For each run: has run other[i] the same bytes?"""
        out = self.sizes == self.sizes[other]
        out[other == np.arange(len(other))] = True
        todo = np.flatnonzero(out & (other != np.arange(len(other))))
        for at, some in self._steps(todo, LONG):
            own = todo[some]
            out[own] &= self._at(own, at) == self._at(other[own], at)
        for i in todo[self.sizes[todo] > LONG]:
            a, b, n = self.begin[i], self.begin[other[i]], self.sizes[i]
            out[i] = np.array_equal(self.data[a : a + n], self.data[b : b + n])
        return out


class Words:
    """The words of a slice of texts: hashes in order, and for each text the place of its first word."""

    def __init__(self, column: pa.Array, fold: bool = False):
        """column: string array; null has no words. Words are runs of bytes outside 0x20 and 0x09-0x0D."""
        data, ends = raw(column)
        if fold:
            data = _FOLD[data]
        size = len(data)
        solid = ~_BLANK[data]
        first, last = solid.copy(), solid.copy()
        if size:
            cuts = ends[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < size)]
            breaks = np.zeros(size + 1, bool)
            breaks[cuts] = True
            first[1:] &= ~solid[:-1] | breaks[1:size]
            last[:-1] &= ~solid[1:] | breaks[1:size]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._bytes = Bytes(data, begin, end)
        self.hashes = self._bytes.hashes()
        self.first = np.searchsorted(begin, ends)  # n + 1 places
        self.counts = np.diff(self.first)
        self._runs: dict[int, np.ndarray] = {}

    def grams(self, n: int, which: int = 1) -> np.ndarray:
        """Hashes of the n words from each place where so many are left in the slice (in the text: see `fits`). The hashes for which = 2 rest on the words' second hashes."""
        if which not in self._runs:
            h = self.hashes if which == 1 else self._bytes.hashes(1)
            run = np.empty(len(h) + 1, np.uint64)
            run[0] = 0
            np.cumsum(h * powers(which, len(h) + 1)[0][: len(h)], out=run[1:])
            self._runs[which] = run
        run, m = self._runs[which], max(0, len(self.hashes) - n + 1)
        return mix((run[n : n + m] - run[:m]) * powers(which, len(self.hashes) + 1)[1][:m])

    def fits(self, n: int) -> np.ndarray:
        """For each place as in `grams`: do the n words lie in one text?"""
        m = max(0, len(self.hashes) - n + 1)
        left = np.repeat(self.first[1:], self.counts)[:m] - np.arange(m)
        return left >= n

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)
