"""Hard negatives by exact inner products behind bounds on segment summaries.

A vector is cut into segments; of each its mean and the length of its deviation from the mean
are held. The inner product of two segments is the product of the means (times the length), plus
or minus at most the product of the deviations. So sums over segments bound a score from both
sides: first over long segments, for pairs that these leave open over short ones, and only then
is a score computed. The bar is the score that an anchor's list has reached.

Anchors are a query set, held against all rows in blocks: the pair of an anchor block and a row
block is a cell, a task streams the rows of a cell past its anchors, and emits short lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import ceil
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.llm.frames import BINARY, LONG
from carryover.llm.vectors import float_type, names, packed, runs, unpacked, whole_vectors
from carryover.session import settle, settle_counted

#: Anchors and rows of a cell, scores of a step, and the segments of both levels.
ANCHORS, ROWS, STEP = 8192, 65536, 1 << 21
#: Rows of the first step of a cell.
FIRST = 16
SEGMENTS = (16, 4)
FIXED_POINT, WIDEST = 256, 1 << 31
#: One score of a whole step costs as much as bounding so small a share of its pairs one by one; and
#: for so many steps the bounds are not tried again once they have left most of the pairs open.
DENSE, AGAIN = 1 / 32, 15
INT = np.dtype(np.int32)
NONE = np.iinfo(np.int64).min


class Summaries:
    """Vectors of a block with the means and deviations of their segments, a pair of matrices a
    level whose products are the upper and the lower bounds."""

    def __init__(self, whole: np.ndarray):
        self.x = whole.astype(np.float64)
        self.top = float(np.abs(self.x).max(initial=0))
        # the last column outweighs what rounding can add to a bound
        slack = 1e-6 * np.sqrt(np.einsum("ij,ij->i", self.x, self.x))[:, None]
        self.levels = []
        for n in SEGMENTS:
            seg = self.x.reshape(len(self.x), -1, n)
            mean = seg.mean(axis=2)
            dev = np.sqrt(((seg - mean[:, :, None]) ** 2).sum(axis=2))
            self.levels.append((mean * n**0.5, np.concatenate([dev, slack], axis=1)))


def dense_bounds(a: Summaries, b: Summaries) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of all scores by the long segments."""
    (m, d), (n, e) = a.levels[0], b.levels[0]
    mid, off = m @ n.T, d @ e.T
    return mid - off, mid + off


def pair_bounds(a: Summaries, b: Summaries, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of some pairs by the short segments."""
    (m, d), (n, e) = a.levels[1], b.levels[1]
    mid, off = np.einsum("ij,ij->i", m[i], n[j]), np.einsum("ij,ij->i", d[i], e[j])
    return mid - off, mid + off


def exact(a: Summaries, b: Summaries, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer scores of pairs, held at the ends of a long if they are beyond."""
    if a.top * b.top * a.x.shape[1] >= 2.0**53:
        pairs = zip(a.x[i].tolist(), b.x[j].tolist(), strict=True)
        return np.array([max(NONE + 1, min(2**63 - 1, sum(int(u) * int(v) for u, v in zip(p, q, strict=True)))) for p, q in pairs], np.int64)
    if len(i) * 4 > len(a.x) * len(b.x):
        return (a.x @ b.x.T)[i, j].astype(np.int64)
    return np.einsum("ij,ij->i", a.x[i], b.x[j]).astype(np.int64)


def products(a: Summaries, b: Summaries) -> np.ndarray | None:
    """All scores, in floats that hold them exactly; none if there are no such floats."""
    most = a.top * b.top * a.x.shape[1]
    if most < 2.0**24:
        return a.x.astype(np.float32) @ b.x.astype(np.float32).T
    return a.x @ b.x.T if most < 2.0**53 else None


def _within(score: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which scores lie between the integers of their rows. Beyond all scores, one end is as good as another."""
    top = 1 << (24 if score.dtype == np.float32 else 53)
    least, most = (np.clip(x, -top, top).astype(score.dtype)[:, None] for x in (least, most))
    return (score >= least) & (score <= most)


class Lists:
    """The best ``size`` rows of each slot: higher scores first, ties by smaller id. What is added
    waits until it is as much as the lists hold; till then their bars are lower than they could be."""

    def __init__(self, slots: int, size: int):
        self.size, self.waiting, self.room = size, [], 0
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.bar = np.full(slots, NONE)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((slot, score, ids))
        self.room -= len(slot)
        if self.room < 0:
            self.settle()

    def settle(self) -> None:
        slot, score, ids = (np.concatenate(x) for x in zip((self.slot, self.score, self.id), *self.waiting, strict=True))
        self.waiting = []
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.size
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        last = place == self.size - 1
        self.bar[slot[last]] = score[last]
        self.room = len(self.slot)


def _step(anchors: int) -> int:
    return max(1, STEP // max(1, anchors))


class Cell:
    """The anchors of a cell. ``offer`` takes rows, ``found`` are the lists."""

    def __init__(self, t: pa.Table):
        self.t, self.ids, self.labels = t, t.column("_id").to_numpy(), t.column("label").to_numpy()
        vec = unpacked(t.column("vec"), INT)
        self.width = -(-max(1, vec.shape[1]) // SEGMENTS[0]) * SEGMENTS[0]
        self.all = Summaries(np.pad(vec, ((0, 0), (0, self.width - vec.shape[1]))))
        bands = t.column("bands").to_pylist()
        self.bands = max((len(x or ()) for x in bands), default=0)
        self.seen = self.skip = 0
        self.low, self.high = (np.array([[b[k] for b in x or ()] + [(1, 0)[k]] * (self.bands - len(x or ())) for x in bands], np.int64).reshape(len(bands), self.bands) for k in (0, 1))

    def offer(self, b: pa.RecordBatch, lists: list[Lists]) -> None:
        ids, labels = b.column("_id").to_numpy(), b.column("label").to_numpy()
        vec = unpacked(b.column("vec"), INT, self.width)[:, :self.width]
        step, at = _step(len(self.ids)), 0
        while at < len(ids):
            # the first steps are short: the bars they raise keep the next ones' lists short
            s = slice(at, at + min(step, max(FIRST, self.seen)))
            at, self.seen = s.stop, self.seen + s.stop - s.start
            rows = Summaries(vec[s])
            if self.bands:
                floor = np.stack([np.maximum(x.bar, self.low[:, k]) for k, x in enumerate(lists)], axis=1)
                open_ = self.low <= self.high
                least, most = np.where(open_, floor, 2**63 - 1).min(axis=1), np.where(open_, self.high, NONE).max(axis=1)
                wanted = self.labels[:, None] != labels[s]
            else:
                least, most = lists[0].bar, np.full(len(self.ids), 2**63 - 1)
                wanted = (self.labels[:, None] == labels[s]) & (self.ids[:, None] != ids[s])
            for p, q, score in self.scores(rows, wanted, least, most):
                for k, x in enumerate(lists):
                    fits = (score >= np.maximum(x.bar, self.low[:, k])[p]) & (score <= self.high[p, k]) if self.bands else score >= x.bar[p]
                    if fits.any():
                        x.add(p[fits], score[fits], ids[s][q[fits]])

    def scores(self, rows: Summaries, wanted: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row, score) of the wanted pairs, without those that the bounds put below the
        least or above the most score of interest. Where the bounds leave many pairs open, all
        scores at once cost less than to go on bounding."""
        if self.skip:
            self.skip -= 1
            left = wanted
        else:
            low, high = dense_bounds(self.all, rows)
            left = wanted & (high >= least[:, None]) & (low <= most[:, None])
            self.skip = AGAIN * (2 * np.count_nonzero(left) > np.count_nonzero(wanted))
        every = products(self.all, rows) if self.skip or np.count_nonzero(left) > DENSE * left.size else None
        if every is not None:
            i, j = np.nonzero(left & _within(every, least, most))
            yield i, j, every[i, j].astype(np.int64)
            return
        self.skip = 0
        i, j = np.nonzero(left)
        for a in range(0, len(i), n := _step(2 * self.width)):
            p, q = i[a:a + n], j[a:a + n]
            low, high = pair_bounds(self.all, rows, p, q)
            near = (high >= least[p]) & (low <= most[p])
            p, q = p[near], q[near]
            yield p, q, exact(self.all, rows, p, q)

    def found(self, lists: list[Lists]) -> Iterator[pa.RecordBatch]:
        for k, x in enumerate(lists):
            x.settle()
            if len(x.slot):
                at = pa.array(x.slot)
                band = self.t.column("scores").combine_chunks().take(at)
                yield pa.RecordBatch.from_arrays([self.t.column(c).combine_chunks().take(at) for c in ("_id", "cls")] + [
                    pa.array([s[k] for s in band.to_pylist()] if self.bands else [None] * len(x.slot), pa.int64()), pa.array(x.id), pa.array(x.score)], names=["anchor_id", "cls", "of", "_id", "score"])


def read_rows(rows: DataFrame, id_col: str, label: Column, vec_col: str) -> DataFrame:
    """(_id, label, cls, vec) of the rows that take part: fixed-point components, and a name
    that tells two rows of one id apart."""
    dtype = float_type(rows.schema[vec_col].dataType)
    own = rows.select(rows[id_col].cast("long").alias("_id"), label.alias("label"), rows[vec_col].alias("vec")).filter("_id is not null and label is not null and vec is not null")
    own = own.withColumn("label", F.col("label").cast("long") if isinstance(own.schema["label"].dataType, T.IntegralType) else F.xxhash64("label"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, cls, there = [], np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
            for at, m in whole_vectors(b.column("vec"), dtype):
                whole = np.clip(np.floor(FIXED_POINT * m.astype(np.float64)), -WIDEST, WIDEST - 1).astype(INT)
                parts.append((at, whole))
                cls[at], there[at] = names(whole), True
            at = pa.array(np.flatnonzero(there))
            yield pa.RecordBatch.from_arrays([b.column("_id").take(at), b.column("label").take(at), pa.array(cls).take(at), packed(parts, b.num_rows).take(at)], names=["_id", "label", "cls", "vec"])

    return own.mapInArrow(read, T.StructType([*(T.StructField(c, LONG) for c in ("_id", "label", "cls")), T.StructField("vec", BINARY)]))


def search(items: DataFrame, anchors: DataFrame, rows: int, queries: int, size: int) -> DataFrame:
    """(anchor_id, cls, of, _id, score): the best ``size`` rows of each anchor. Without bands
    these are others of its label; with them, of other labels, for each score in ``scores``."""
    spark = items.sparkSession
    across = max(1, ceil(queries / ANCHORS))
    down = max(ceil(4 * spark.sparkContext.defaultParallelism / across), ceil(rows / ROWS))
    block = lambda n: F.pmod(F.xxhash64("_id", "cls"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    cols = ["a", "r", "kind", "_id", "label", "cls", "vec", "scores", "bands"]
    empty = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in ("scores", "bands")]
    both = (anchors.select("*", block(across).alias("a"), F.lit(0).alias("kind"), every(down).alias("r")).select(cols)
            .unionByName(items.select("*", *empty, block(down).alias("r"), F.lit(1).alias("kind"), every(across).alias("a")).select(cols)))
    cells = both.repartition(max(1, min(across * down, 1 << 15)), "a", "r").sortWithinPartitions("a", "r", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in groupby(runs(batches, ["a", "r", "kind"]), key=lambda x: x[0][:2]):
            now = lists = None
            for (_, _, kind), part in groupby(cell, key=itemgetter(0)):
                if not kind:
                    now = Cell(pa.Table.from_batches([b for _, b in part]))
                    lists = [Lists(len(now.ids), size) for _ in range(max(1, now.bands))]
                elif now:
                    for _, b in part:
                        now.offer(b, lists)
            if now:
                yield from now.found(lists)

    found = cells.mapInArrow(run, "anchor_id long, cls long, of long, _id long, score long")
    best = Window.partitionBy("anchor_id", "cls", "of").orderBy(F.desc("score"), "_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)


def mine_negatives(rows: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of each row where ``anchors`` holds, the first ``positives`` other rows of its label, and
    for each of these the first ``negatives`` rows of other labels that score at least ``low``
    and at most ``high`` per cent of it. A score is the inner product of the components as
    fixed-point integers; higher ones come first, ties by smaller id.

    Rows with a null id or label, and vectors that are null, empty or hold a null or non-finite
    component, take no part. Rows with the anchor's id are none of its positives; anchors that
    are equal in all are one. Other repeated rows count each. A vector shorter than another reads
    as ended by zeros. Fixed-point components are held within 32 bits, scores within 64. An
    anchor without positives, or whose bands are empty, has no rows; other columns are not
    looked at.
    """
    picked = F.coalesce(anchors, F.lit(False))
    items, got = settle_counted(read_rows(rows, id_col, label, vec_col), "items", rows=F.count("*"))
    # the condition is on the given columns, so the anchors are read from the input once more
    chosen, asked = settle_counted(read_rows(rows.filter(picked), id_col, label, vec_col).dropDuplicates(["_id", "label", "cls"]), "anchors", rows=F.count("*"))
    bare = chosen.select("*", F.lit(None).cast("array<long>").alias("scores"), F.lit(None).cast("array<array<long>>").alias("bands"))
    pos = settle(search(items, bare, got["rows"], asked["rows"], positives).select("anchor_id", "cls", F.col("_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wide = F.col("s").cast("decimal(38,0)")
    cut = lambda p, up: (F.ceil if up else F.floor)(wide * p / F.lit(100).cast("decimal(3,0)"))
    scores = (pos.select("anchor_id", "cls", F.col("positive_score").alias("s")).distinct().withColumn("lo", cut(low, True).cast("long")).withColumn("hi", cut(high, False).cast("long"))
              .filter("lo <= hi").groupBy("anchor_id", "cls").agg(F.array_sort(F.collect_list(F.struct("s", "lo", "hi"))).alias("l")))
    banded = (chosen.join(scores.withColumnRenamed("anchor_id", "_id"), ["_id", "cls"])
              .select("_id", "label", "cls", "vec", F.col("l.s").alias("scores"), F.transform("l", lambda b: F.array(b["lo"], b["hi"])).alias("bands")))
    neg = search(items, banded, got["rows"], asked["rows"], negatives)
    found = neg.select("anchor_id", "cls", F.col("of").alias("positive_score"), "rank", F.col("_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pos.join(found, ["anchor_id", "cls", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
