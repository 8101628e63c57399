"""Near copies among vectors by counting collisions on one-dimensional projections.

Every vector is projected on random lines. A linked pair is close on each line: the difference
is normal with a deviation that the cosine sets. So a pair collides on a line if one value lies
in a window around the other, and a pair that collides on as many lines as linked pairs do
(but for a calibrated share) is verified on the full vectors.

Which pairs are counted at all is decided by other lines in the same way. Each of them is sorted
and cut at its median, as the histogram of all rows has it; a vector goes to its side of the cut
and, if the cut is inside its window, may visit the other one. So ``depth`` lines deal the rows
out to ``2 ** depth`` leaves. At each cut only one of the sides takes visitors, and a pair is
counted in the one leaf where not both visit at the same cut. Windows follow from the recall
and from how dense the rows are at the cut.

Large leaves are cut into blocks, and each pair of blocks is a cell of its own. A cell returns
sums of links and a tree of its links, never the pairs; copies are one vector with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, erfc, exp, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.llm.frames import BINARY, LONG, chosen
from carryover.llm.jaccard import components
from carryover.llm.text import mix
from carryover.llm.vectors import float_type, groups, names, packed, units, unpacked, whole_vectors
from carryover.session import settle, settle_counted

#: Rows per leaf (before visits) and per block of a leaf, lines that are counted, levels at most.
LEAF, BLOCK, LINES, DEEPEST = 1024, 8192, 32, 48
#: Steps of a projection value per standard deviation of a random pair's, and the half window.
SCALE, HALF = 16, 9
SEED = 20_011
CHUNK = 256


def _tail(t: float) -> float:
    return erfc(t / sqrt(2)) / 2


@dataclass(frozen=True)
class Lines:
    """How rows are dealt out and what a pair needs to be verified."""

    least: float
    cuts: tuple[int, ...]
    windows: tuple[int, ...]
    need: int


def needed(least: float, recall: float) -> int:
    """Collisions that a pair of this cosine reaches with the given chance. A difference within
    ``HALF - 1`` steps collides however the two values are rounded."""
    p = 1 - 2 * _tail((HALF - 1) / SCALE / sqrt(2 - 2 * least))
    chance, n = 0.0, LINES + 1
    while n and chance < recall:
        n -= 1
        chance += comb(LINES, n) * p**n * (1 - p) ** (LINES - n)
    return n


def fit_lines(least: float, recall: float, rows: int, counts: np.ndarray) -> Lines:
    """From the histogram of every projection over all rows (lines x 256 steps): medians, and
    the narrowest windows that part a linked pair seldom enough. Cuts and counting may lose
    half of ``1 - recall`` each."""
    depth = min(DEEPEST, max(0, ceil(log2(max(1, rows) / LEAF))))
    spread, cuts, windows = sqrt(2 - 2 * least), [], []
    for c in counts[:depth]:
        cut = int(np.searchsorted(np.cumsum(c), c.sum() / 2))
        near = slice(max(0, cut - 3), cut + 5)
        density = c[near].sum() / max(1, c.sum()) / (near.stop - near.start) * SCALE
        t = 0.0
        # chance that a cut falls between the two, and farther from both than the window
        while density * spread * 2 * (exp(-t * t / 2) / sqrt(2 * pi) - t * _tail(t)) > (1 - recall) / 2 / depth:
            t += 0.05
        cuts.append(cut - 128)
        windows.append(ceil(t * spread * SCALE) + 1)
    return Lines(least, tuple(cuts), tuple(windows), needed(least, 1 - (1 - recall) / 2))


def project(unit: np.ndarray) -> np.ndarray:
    """Values on all lines, in steps from -128 to 127; the first ``DEEPEST`` lines are for cuts."""
    lines = np.random.default_rng(SEED).standard_normal((unit.shape[1], DEEPEST + LINES))
    return np.clip(np.rint(unit @ lines * SCALE), -128, 127).astype(np.int16)


def visits(p: np.ndarray, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, levels where it is a visitor) of all rows."""
    row, leaf, foreign = np.arange(len(p)), np.ones(len(p), np.int64), np.zeros(len(p), np.int64)
    for k, (cut, window) in enumerate(zip(lines.cuts, lines.windows, strict=True)):
        v = p[row, k]
        side = (v > cut).astype(np.int64)
        taking = (mix(leaf.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) & 1
        goes = np.flatnonzero((side != taking) & (np.abs(v - cut) <= window))
        row = np.concatenate([row, row[goes]])
        foreign = np.concatenate([foreign, foreign[goes] | 1 << k])
        leaf = np.concatenate([leaf * 2 + side, leaf[goes] * 2 + taking[goes]])
    return row, leaf, foreign


def read_vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.dtype]:
    """(_id, cls, vec): the class is null for a vector that links with nothing."""
    dtype = float_type(rows.schema[vec_col].dataType)
    own = chosen(rows, _id=id_col, vec=vec_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, cls = [], np.zeros(b.num_rows, np.int64)
            known = np.zeros(b.num_rows, bool)
            for at, m in whole_vectors(b.column(1), dtype):
                some = m.any(axis=1)
                if not some.any():
                    continue
                parts.append((at[some], m[some]))
                cls[at[some]] = names(m[some])
                known[at[some]] = True
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, mask=~known), packed(parts, b.num_rows)], names=["_id", "cls", "vec"])

    return own.mapInArrow(read, T.StructType([own.schema["_id"], T.StructField("cls", LONG), T.StructField("vec", BINARY)])), dtype


def histogram(vectors: DataFrame, dtype: np.dtype) -> np.ndarray:
    """Rows per line and step: a table of fixed size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DEEPEST * 256, np.int64)
        for b in batches:
            if b.num_rows:
                p = project(units(unpacked(b.column(0), dtype)))[:, :DEEPEST] + 128
                total += np.bincount((p.astype(np.int64) + np.arange(DEEPEST) * 256).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(DEEPEST * 256, np.int64)
    for r in vectors.select("vec").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r.at] = r.n
    return out.reshape(DEEPEST, 256)


def deal(vectors: DataFrame, dtype: np.dtype, lines: Lines, whole: bool) -> DataFrame:
    """A row per visit: leaf, and if ``whole`` all that a cell needs."""
    kinds = {"leaf": pa.int64(), "foreign": pa.int64(), "marks": pa.binary(LINES)}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = project(units(unpacked(b.column("vec"), dtype)))
            row, leaf, foreign = visits(p, lines)
            out = {"leaf": pa.array(leaf)}
            if whole:
                marks = pa.FixedSizeBinaryArray.from_buffers(kinds["marks"], len(p), [None, pa.py_buffer(np.ascontiguousarray(p[:, DEEPEST:].astype(np.int8)))])
                at = pa.array(row)
                out |= {"foreign": pa.array(foreign), "marks": marks.cast(pa.binary()).take(at), **{c: b.column(c).take(at) for c in ("cls", "n", "vec")}}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return vectors.mapInArrow(go, "leaf long, foreign long, marks binary, cls long, n long, vec binary" if whole else "leaf long")


def cell_links(cls: np.ndarray, weight: np.ndarray, side: np.ndarray, foreign: np.ndarray, marks: np.ndarray, unit: np.ndarray,
               least: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(links, smallest class of the component) of each vector of a cell. With two sides only
    pairs across them are looked at."""
    n, two = len(cls), side.any() and not side.all()
    links, label = np.zeros(n, np.int64), np.arange(n)
    order = np.argsort(side, kind="stable")
    first = int((side == 0).sum()) if two else n
    for a in range(0, first, CHUNK):
        x = order[a:min(a + CHUNK, first)]
        y = order[first if two else a:]
        count = np.zeros((len(x), len(y)), np.uint8)
        for k in range(marks.shape[1]):
            count += np.abs(marks[x, k][:, None] - marks[y, k]) <= HALF
        cand = (count >= need) & ((foreign[x][:, None] & foreign[y]) == 0) & (cls[x][:, None] != cls[y])
        if not two:
            cand &= np.arange(len(y)) > np.arange(len(x))[:, None]
        r, c = np.flatnonzero(cand.any(axis=1)), np.flatnonzero(cand.any(axis=0))
        if not len(r):
            continue
        x, y = x[r], y[c]
        linked = cand[np.ix_(r, c)] & (unit[x] @ unit[y].T >= least)
        links[x] += linked @ weight[y]
        links[y] += linked.T @ weight[x]
        i, j = np.nonzero(linked)
        while True:
            u, v = label[x[i]], label[y[j]]
            if not (apart := u != v).any():
                break
            low, high = np.minimum(u, v)[apart], np.maximum(u, v)[apart]
            to = np.arange(n)
            np.minimum.at(to, high, low)
            label = to[label]
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, cls)
    return links, smallest[label]


def near_links(vectors: DataFrame, rows: int, dtype: np.dtype, least: float, recall: float) -> DataFrame:
    """(cls, to, n): the links that a class has in one cell, counted with the weights of the
    others, and the smallest class that they tie it to there."""
    lines = fit_lines(least, recall, rows, histogram(vectors, dtype))
    sizes, got = settle_counted(deal(vectors, dtype, lines, False).groupBy("leaf").agg(F.count("*").alias("size")), "leaves", visits=F.sum("size"))
    large = sizes.filter(F.col("size") > BLOCK).select("leaf", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))
    placed = (deal(vectors, dtype, lines, True).join(large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
              .withColumn("own", F.pmod(F.xxhash64("cls"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
              .select("leaf", "i", "j", (F.col("own") != F.col("i")).alias("side"), "foreign", "marks", "cls", "n", "vec"))
    tasks = max(4 * vectors.sparkSession.sparkContext.defaultParallelism, ceil(got["visits"] / 4 / LEAF / 8))
    cells = placed.repartition(tasks, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    need, floor = lines.need, lines.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["leaf", "i", "j"]):
            col = {c: t.column(c).to_numpy() for c in ("cls", "n", "side", "foreign")}
            marks = unpacked(t.column("marks"), np.dtype(np.int8)).astype(np.int16)
            links, to = cell_links(col["cls"], col["n"], col["side"].astype(bool), col["foreign"], marks, units(unpacked(t.column("vec"), dtype)), floor, need)
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(col["cls"][at]), pa.array(to[at]), pa.array(links[at])], names=["cls", "to", "n"])

    return settle(cells.mapInArrow(run, "cls long, to long, n long"), "links")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, recall: float = 0.99) -> DataFrame:
    """One row per input row: the id, ``n_links`` (other rows with a cosine of at least
    ``least``), ``component_id`` (smallest id that links lead to), ``kept`` (it is its own).

    Of the links at exactly ``least`` about ``recall`` are found, of closer pairs more; none is
    below. Vectors that are null, empty, all zero or hold a null or non-finite component, and
    rows with a null id, link with nothing (a null id has a null component and ``kept``). A
    vector shorter than another reads as ended by zeros. Repeated rows are copies of each other,
    each returned. Other columns are not looked at.
    """
    if not 0 < least < 1 or not 0 < recall < 1:
        raise ValueError("least and recall are between 0 and 1")
    read, dtype = read_vectors(rows, id_col, vec_col)
    named = settle(read.select("_id", F.when(F.col("_id").isNotNull(), F.col("cls")).alias("cls")), "classes")
    copies = settle(named.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1"), "copies")
    own = read.filter("_id is not null and cls is not null").select("cls", "vec")
    one = own.join(copies, "cls", "left_anti").select("cls", F.lit(1).cast("long").alias("n"), "vec")
    many = own.join(copies, "cls").groupBy("cls").agg(F.first("n").alias("n"), F.first("vec").alias("vec"))
    vectors, got = settle_counted(one.unionByName(many), "vectors", rows=F.count("*"))
    found = near_links(vectors, got["rows"], dtype, least, recall)
    labels = components(found.filter(F.col("cls") != F.col("to")).select(F.col("cls").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("cls").agg(F.sum("n").alias("links"))
    known = settle(links.join(labels, "cls").join(copies, "cls", "full")
                   .select("cls", (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"), F.coalesce("label", "cls").alias("label")), "known")
    smallest = named.join(known.select("cls", "label"), "cls").groupBy("label").agg(F.min("_id").alias("smallest"))
    info = known.join(smallest, "label").select("cls", "n_links", "smallest")
    out = named.join(info, "cls", "left").select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                                 F.when(F.col("_id").isNotNull(), F.coalesce("smallest", "_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
