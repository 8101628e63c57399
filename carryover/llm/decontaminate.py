"""Benchmark decontamination with a CGK random-walk embedding and bit-sampling LSH.

The embedding reads a window of words step by step; a random bit of (step, word) decides
whether the walk moves on. Two windows at a small edit distance give sequences at a small
Hamming distance, as walks that fell apart over an edit soon meet again. A key hashes the
words at a few sampled steps. Items are indexed at all their offsets, texts are read at every
second or fourth word, by the size of the window, so an item copied into a text is met at an aligned place wherever it
begins; several independent walks raise the chance to meet an edited one. Candidates are
verified by their exact edit distance in words.

Words are runs of letters, digits and other non-ASCII characters, in lower case, so that
punctuation and line breaks do not hide a leak.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.llm.frames import DOUBLE, LONG, arrow_map, chosen
from carryover.llm.text import BASE, WORD_BYTES, Texts, mix, windows

#: Window sizes in words, and for each at which words of a text windows begin, how many steps are
#: sampled and how many walks there are: so many that of items with the most edits allowed at
#: least nine in ten are met, at every length (held by a test). An item is read through the
#: largest window that at most two thirds fill it.
STRIDE = {8: 2, 16: 4, 32: 4}
SAMPLES = {8: 5, 16: 6, 32: 6}
REPEATS = {8: 4, 16: 6, 32: 6}
SIZES = tuple(STRIDE)
#: Items below this many words have to occur unchanged.
SHORT = 12
EDITS = 0.2
#: Words of the items that one pass over the texts looks for.
BLOCK_WORDS = 1_000_000


_RND = random.Random(17)
SEEDS = [np.uint64(_RND.getrandbits(64)) for _ in range(max(REPEATS.values()))]
STEPS = {w: [sorted(_RND.sample(range(w), SAMPLES[w])) for _ in range(REPEATS[w])] for w in SIZES}


def folded(column: pa.Array) -> Texts:
    return Texts(pc.utf8_lower(column))


def embed(h: np.ndarray, bits: np.ndarray, start: np.ndarray, steps: list[int]) -> np.ndarray:
    """Keys of the windows at ``start``: the embedding sampled at ``steps``. ``bits`` has a
    random word per word, of which step j uses bit j."""
    at, key = start.copy(), np.zeros(len(start), np.uint64)
    for j in range(steps[-1] + 1):
        if j in steps:
            key = mix(key * np.uint64(BASE) + h[at])
        if j < steps[-1]:
            at += ((bits[at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return key


@dataclass
class Postings:
    """Sorted keys, and the (item, offset) pairs behind each."""

    keys: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    sieve: np.ndarray

    @staticmethod
    def of(key: np.ndarray, item: np.ndarray, offset: np.ndarray) -> Postings:
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        sieve = np.zeros(1 << 20, bool)
        sieve[keys & np.uint64(0xFFFFF)] = True
        return Postings(keys, np.append(first, len(key)), item[order], offset[order], sieve)

    def meet(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``key``, item, offset) of all hits."""
        maybe = np.flatnonzero(self.sieve[key & np.uint64(0xFFFFF)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        real = self.keys[at] == key[maybe]
        at, maybe = at[real], maybe[real]
        size = self.bounds[at + 1] - self.bounds[at]
        slot = np.repeat(self.bounds[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(maybe, size), self.item[slot], self.offset[slot]


@dataclass
class ItemIndex:
    """One block of items; its size is bounded by ``BLOCK_WORDS``."""

    items: list[np.ndarray]
    ids: list[list]
    lookups: list[tuple[int, int, Postings]] = field(default_factory=list)
    words: Postings | None = None

    @staticmethod
    def build(ids: list, texts: list[str | None]) -> ItemIndex:
        t = folded(pa.array(texts, pa.string()))
        start, end, doc = t.words(WORD_BYTES)
        h = t.word_hashes(start, end)
        cut = np.searchsorted(doc, np.arange(t.n + 1))
        same: dict[bytes, int] = {}
        out = ItemIndex([], [])
        for i, key in enumerate(ids):
            words = h[cut[i]:cut[i + 1]]
            if not len(words):
                continue
            at = same.setdefault(words.tobytes(), len(out.items))
            if at == len(out.items):
                out.items.append(words)
                out.ids.append([])
            out.ids[at].append(key)
        size = np.array([len(x) for x in out.items], np.int64)
        own = np.repeat(np.arange(len(size)), size)
        flat = np.concatenate([np.zeros(0, np.uint64), *out.items])
        first = np.cumsum(size) - size
        for w in SIZES:
            mine = (size >= max(SHORT, 3 * w // 2)) & ((size < 3 * w) | (w == SIZES[-1]))
            at = np.flatnonzero(mine[own])
            at = at[at - first[own[at]] + w <= size[own[at]]]
            if len(at):
                for r, seed in enumerate(SEEDS[:REPEATS[w]]):
                    key = embed(flat, mix(flat ^ seed), at, STEPS[w][r])
                    out.lookups.append((w, r, Postings.of(key, own[at], at - first[own[at]])))
        out.words = Postings.of(_in_item(flat, own), own, own)
        for k in sorted(set(size[size < SHORT].tolist())):
            g, at = windows(flat, own, k)
            whole = size[own[at]] == k
            out.lookups.append((k, -1, Postings.of(g[whole], own[at[whole]], np.zeros(whole.sum(), np.int64))))
        return out

    def hits(self, t: Texts) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits) of each item found, the best place of each."""
        start, end, doc = t.words(WORD_BYTES)
        h = t.word_hashes(start, end)
        cut = np.searchsorted(doc, np.arange(t.n + 1))
        found, bits = [], {}
        place = np.arange(len(h)) - cut[doc]
        aligned = {s: np.flatnonzero(place % s == 0) for s in set(STRIDE.values())}
        for k, r, postings in self.lookups:
            if r < 0:
                key, at = windows(h, doc, k)
            else:
                at = aligned[STRIDE[k]]
                at = at[at + k <= cut[doc[at] + 1]]
                if r not in bits:
                    bits[r] = mix(h ^ SEEDS[r])
                key = embed(h, bits[r], at, STEPS[k][r])
            i, item, offset = postings.meet(key)
            if len(i):
                found.append(np.stack([doc[at[i]], item, at[i] - offset], 1))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if found:
            c = np.unique(np.concatenate(found), axis=0)
            # candidates a word or two apart are one place, whose region is verified once; a
            # longer chain of them is cut, so that each is at most two words behind a verified one
            new = np.concatenate([[True], (np.diff(c[:, 0]) != 0) | (np.diff(c[:, 1]) != 0) | (np.diff(c[:, 2]) > 2)])
            part = (c[:, 2] - c[np.flatnonzero(new), 2][np.cumsum(new) - 1]) // 3
            near = new | np.concatenate([[True], np.diff(part) != 0])
            for d, item, at in self._promising(c[near], h, cut).tolist():
                got = _verify(self.items[item], h[cut[d]:cut[d + 1]], at - int(cut[d]))
                if got and (got[2], got[0], got[1]) < best.get((d, item), (1 << 60,)):
                    best[d, item] = (got[2], got[0], got[1])
        return [(d, item, first, n, edits) for (d, item), (edits, first, n) in best.items()]

    def _promising(self, c: np.ndarray, h: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The candidates (text, item, word) around which enough words are the item's: each
        that is not there costs an edit."""
        sizes = np.array([len(x) for x in self.items])
        n = sizes[c[:, 1]]
        most = _allowed(n)
        lo, hi = np.maximum(c[:, 2] - most - 3, cut[c[:, 0]]), np.minimum(c[:, 2] + n + most + 3, cut[c[:, 0] + 1])
        length = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(c)), length)
        at = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + lo[which]
        keys = self.words.keys
        key = _in_item(h[at], c[which, 1])
        maybe = np.flatnonzero(self.words.sieve[key & np.uint64(0xFFFFF)])
        real = keys[np.minimum(np.searchsorted(keys, key[maybe]), len(keys) - 1)] == key[maybe]
        return c[np.bincount(which[maybe[real]], minlength=len(c)) >= n - most]


def _in_item(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mix(words + mix(item.astype(np.uint64)))


def _allowed(n: np.ndarray) -> np.ndarray:
    """Edits that an item of so many words may have."""
    return np.where(n >= SHORT, (EDITS * n).astype(np.int64), 0)


def _verify(item: np.ndarray, words: np.ndarray, at: int) -> tuple[int, int, int] | None:
    """(first word, words, edits) of the closest place near ``at``, if close enough."""
    n = len(item)
    most = int(_allowed(np.array(n)))
    if 0 <= at and np.array_equal(words[at:at + n], item):
        return at, n, 0
    lo, hi = max(0, at - most - 3), min(len(words), at + n + most + 3)
    region = words[lo:hi]
    ends = _distances(item, region, free=True)
    end = int(ends.argmin())
    if ends[end] > most:
        return None
    back = _distances(item[::-1], region[:end][::-1], free=False)
    size = int(np.flatnonzero(back == ends[end])[0])
    return lo + end - size, size, int(ends[end])


def _distances(item: np.ndarray, region: np.ndarray, free: bool) -> np.ndarray:
    """Edit distance of ``item`` to the part of ``region`` that ends at each place; it begins
    anywhere if ``free``, else at 0."""
    step = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64) if free else step.copy()
    for i, w in enumerate(item):
        new = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + (region != w)]))
        row = np.minimum.accumulate(new - step) + step
    return row


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[ItemIndex]:
    """The items, in blocks that fit a task's memory whatever the size of the benchmark."""
    ids, texts, size = [], [], 0
    for r in chosen(benchmark, i=id_col, t=text_col).filter("i is not null and t is not null").toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t.split()) + 1
        if size >= block_words:
            yield ItemIndex.build(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield ItemIndex.build(ids, texts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each text and item it holds: ids, ``first_word``, ``n_words``, ``edits`` and
    ``similarity`` (1 - edits / words of the item) of the closest place, the first of equals.

    An item counts as held if at most a fifth of its words (none, below ``SHORT`` words) were
    inserted, deleted or replaced. Null and empty texts hold nothing and null or wordless items
    are held by nothing; items of the same words are found together. A null document id stays
    null, repeated rows give repeated results, other columns are not looked at. All texts meet
    all items, in blocks of ``block_words`` words of items.
    """
    kind = benchmark.schema[item_col].dataType
    own, out = chosen(docs, _id=id_col, text=text_col), None
    for index in item_blocks(benchmark, item_col, item_text_col, block_words):

        def read(b: pa.RecordBatch, index: ItemIndex = index) -> dict | None:
            rows = [(d, key, first, n, edits, 1 - edits / len(index.items[item]))
                    for d, item, first, n, edits in sorted(index.hits(folded(b.column("text")))) for key in index.ids[item]]
            cols = list(zip(*rows, strict=True)) or [[] for _ in range(6)]
            return dict(zip(("_rows", "_item", "first_word", "n_words", "edits", "similarity"), map(list, cols), strict=True)) if rows else None

        types = {"_item": kind, "first_word": LONG, "n_words": LONG, "edits": LONG, "similarity": DOUBLE}
        part = arrow_map(own, read, types, ["_id"])
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = own.limit(0).select("_id", F.lit(None).cast(kind).alias("_item"), *[F.lit(0).cast("long").alias(c) for c in ("first_word", "n_words", "edits")], F.lit(0.0).alias("similarity"))
    return out.withColumnsRenamed({"_id": id_col, "_item": item_col})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns and nothing else."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    out, text = docs.toDF(*names), names[docs.columns.index(text_col)]
    for index in item_blocks(benchmark, item_col, item_text_col, block_words):

        def clean(b: pa.RecordBatch, index: ItemIndex = index) -> dict:
            held = {h[0] for h in index.hits(folded(b.column(text)))}
            return {"_rows": [i for i in range(b.num_rows) if i not in held]}

        out = arrow_map(out, clean, {}, names, text)
    return out.toDF(*docs.columns)
