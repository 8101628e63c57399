"""Elias-Fano sequences and n-gram tries over them, queried in bulk."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np

ONE = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence of integers below 2 ** 63 in about log2(range / n) + 2 bits each.

    The low bytes of each value are stored as they are, the rest in unary as one bit vector.
    """

    HEAD = 24

    def __init__(self, raw: np.ndarray):
        self.n, self.low_bytes, self.top = (int(x) for x in raw[:self.HEAD].view("<u8"))
        at = self.HEAD + self.n * self.low_bytes
        self.lows, self.high = raw[self.HEAD:at], raw[at:]

    @staticmethod
    def encode(values: np.ndarray) -> np.ndarray:
        v = values.astype("<u8")
        n = len(v)
        last = int(v[-1]) if n else 0
        low = min(range(8), key=lambda b: 8 * b + 1 + (last >> 8 * b) / max(n, 1))
        top = (last >> 8 * low) + 1 if n else 0
        bits = np.zeros(n + top, bool)
        bits[(v >> np.uint64(8 * low)).astype(np.int64) + np.arange(n)] = True
        lows = v.view(np.uint8).reshape(n, 8)[:, :low] if n else np.zeros((0, 0), np.uint8)
        head = np.array([n, low, top], "<u8").view(np.uint8)
        return np.concatenate([head, lows.reshape(-1), np.packbits(bits, bitorder="little")])

    def _low(self, at: np.ndarray | slice) -> np.ndarray:
        out = np.zeros((self.n if isinstance(at, slice) else len(at), 8), np.uint8)
        if self.low_bytes:
            out[:, :self.low_bytes] = self.lows.reshape(self.n, self.low_bytes)[at]
        return out.view("<u8").reshape(-1)

    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.high, count=self.n + self.top, bitorder="little")

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(self._bits()) - np.arange(self.n)
        return (ones.astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._low(slice(None))

    def directory(self) -> np.ndarray:
        """For each high part, how many values have a smaller one."""
        zeros = np.flatnonzero(self._bits() == 0)
        return np.concatenate([[0], zeros - np.arange(self.top)])

    def successor(self, q: np.ndarray, directory: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, the place of the first value not below it, and whether it is equal."""
        high = np.minimum(q >> np.uint64(8 * self.low_bytes), np.uint64(self.top)).astype(np.int64)
        low = q & ((ONE << np.uint64(8 * self.low_bytes)) - ONE)
        over = high >= self.top
        lo = directory[np.minimum(high, self.top)]
        end = directory[np.minimum(high + 1, self.top)]
        lo, end = np.where(over, self.n, lo), np.where(over, self.n, end)
        hi = end.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            below = self._low(mid) < low[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        equal = np.zeros(len(q), bool)
        inside = np.flatnonzero(lo < end)
        equal[inside] = self._low(lo[inside]) == low[inside]
        return lo, equal


@dataclass
class Level:
    """One order of a trie: contexts, a pointer per context to its first successor, and the
    successors of all contexts as one monotone sequence, each relative to its context's rank."""

    contexts: EliasFano
    pointers: EliasFano
    successors: EliasFano
    values: np.ndarray


class Trie:
    """N-grams split as (context, word), in memory-mapped levels of one scratch file.

    The file is unlinked as soon as it is mapped, so that nothing stays behind if a task dies.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], word_bits: int):
        """Per level: contexts and words (sorted by both), and a value of each n-gram."""
        self.bits = np.uint64(word_bits)
        parts, shapes = [], []
        for context, word, value in levels:
            distinct, first = np.unique(context, return_index=True)
            rank = np.searchsorted(distinct, context).astype(np.uint64)
            made = [EliasFano.encode(distinct), EliasFano.encode(np.append(first, len(context))), EliasFano.encode((rank << self.bits) | word)]
            value = np.ascontiguousarray(value)
            parts += [*made, value.view(np.uint8)]
            shapes.append(([len(x) for x in made], value.dtype, value.nbytes))
        size = sum(len(p) for p in parts)
        with tempfile.TemporaryFile() as f:
            f.truncate(max(size, 1))
            raw = np.memmap(f, np.uint8, "r+", shape=(max(size, 1),))
        at = 0
        for p in parts:
            raw[at:at + len(p)] = p
            at += len(p)
        self.levels, self.size, at = [], size, 0
        for lengths, kind, nbytes in shapes:
            seqs = []
            for n in lengths:
                seqs.append(EliasFano(np.array(raw[at:at + n]) if n <= EliasFano.HEAD else raw[at:at + n]))
                at += n
            self.levels.append(Level(*seqs, np.frombuffer(raw, kind, nbytes // kind.itemsize, at)))
            at += nbytes
        self._directories = [(lv.contexts.directory(), lv.pointers.decode().astype(np.int64), lv.successors.directory()) for lv in self.levels]

    def lookup(self, level: int, context: np.ndarray, word: np.ndarray, absent: int) -> np.ndarray:
        """Values of n-grams: find the context, then the word's successor within its range."""
        lv, (of_context, pointer, of_successor) = self.levels[level], self._directories[level]
        rank, known = lv.contexts.successor(context, of_context)
        out = np.full(len(context), absent, lv.values.dtype)
        at = np.flatnonzero(known)
        place, equal = lv.successors.successor((rank[at].astype(np.uint64) << self.bits) | word[at], of_successor)
        inside = equal & (place >= pointer[rank[at]]) & (place < pointer[rank[at] + 1])
        out[at[inside]] = lv.values[place[inside]]
        return out

