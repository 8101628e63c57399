"""Vectorised text helpers that run inside Arrow tasks.

Texts of a batch lie end to end in one byte array; words, hashes and windows are arrays
over it, so no Python object is made per word. Work is cut into pieces of a few megabytes
(never inside a text), which bounds memory whatever the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Texts:
    """The texts of a piece: ``buf`` holds their UTF-8 bytes, ``off`` their bounds."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        a = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
        _, offsets, data = a.buffers()
        off = np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.buf = LOWER[raw] if lower else raw
        self.off = off - off[0]
        self.n = len(self.off) - 1

    def words(self, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (bytes) and text number of each maximal run of ``inside`` bytes."""
        if not len(self.buf):
            z = np.zeros(0, np.int64)
            return z, z, z
        w = inside[self.buf]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        cut = self.off[1:-1]
        cut = cut[(cut > 0) & (cut < len(w))]
        first[cut] = w[cut]
        last[cut - 1] = w[cut - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(self.off[1:], start, "right")

    def word_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range; equal bytes, equal hash."""
        up, down = _powers(len(self.buf))
        run = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[:len(self.buf)], out=run[1:])
        return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))

    def code_points(self) -> np.ndarray:
        """For each byte position, the code points before it in the piece."""
        return self.running((self.buf & 0xC0) != 0x80)

    def running(self, mask: np.ndarray) -> np.ndarray:
        """For each byte position, how many positions before it are marked."""
        out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Marked positions of each text."""
        return np.diff(np.searchsorted(np.flatnonzero(mask), self.off))


@lru_cache(maxsize=1)
def _powers_for(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, INVERSE):
        p = np.full(size + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_for(max(PIECE, 1 << max(0, n - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mul)
    x ^= x >> np.uint64(31)
    return x


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of ``k`` consecutive words of one text, and the word each starts at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= np.uint64(BASE)
        acc += h[j:n + j]
        acc = mix(acc)
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return acc[at], at


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces whose texts have about ``limit`` bytes; a text is never cut."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def strings(column: pa.Array) -> list[str]:
    """Texts as Python strings, null as empty."""
    return [t or "" for t in column.to_pylist()]
