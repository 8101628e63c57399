"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.llm.frames import DOUBLE, STRING, arrow_map, chosen
from carryover.llm.text import Texts, mix, pieces

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LANGS = 512
UND = "und"


def _folding() -> np.ndarray:
    """For all code points: a letter's lower case, else a space."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD: list[np.ndarray] = []


def fold(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a piece and the bounds of its texts among them."""
    if not _FOLD:
        _FOLD.append(_folding())
    text = t.buf.tobytes().decode("utf-8", "replace")
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _FOLD[0][cp], t.code_points()[t.off].astype(np.int64)


def grams(cp: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, buckets of the n-grams that have a letter, and the bounds of the texts."""
    letter, n = cp != 0x20, len(cp)
    for k in ORDERS:
        m = max(n - k + 1, 0)
        key, has = np.full(m, k, np.uint64), np.zeros(m, bool)
        for j in range(k):
            key = key * np.uint64(0x110001) + cp[j:m + j]
            has |= letter[j:m + j]
        for j in range(1, k):  # no n-gram spans two texts
            edge = off[1:-1] - j
            has[edge[(edge >= 0) & (edge < m)]] = False
        at = np.flatnonzero(has)
        bounds = np.searchsorted(at, off)
        yield (mix(key[at]) & np.uint64(BUCKETS - 1)).astype(np.int64), bounds


@dataclass(frozen=True)
class LanguageModel:
    """``weights[l, b]`` is log P(bucket b | language l); at most ``MAX_LANGS`` rows of a
    fixed width, which is what bounds the size of the matrix that tasks get."""

    langs: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray

    def predict(self, t: Texts) -> tuple[list[str], np.ndarray]:
        cp, off = fold(t)
        logs, seen = np.zeros((len(self.langs), t.n)), np.zeros(t.n, np.int64)
        for bucket, bounds in grams(cp, off):
            seen += np.diff(bounds)
            # each text is summed by itself, in double precision: no score depends on neighbours
            text = np.repeat(np.arange(t.n), np.diff(bounds))
            for i, w in enumerate(self.weights):
                logs[i] += np.bincount(text, w[bucket], t.n)
        if not self.langs:
            return [UND] * t.n, np.zeros(t.n)
        logs += self.prior[:, None]
        best = logs.argmax(0)
        top = logs[best, np.arange(t.n)]
        score = np.where(seen > 0, 1 / np.exp(logs - top).sum(0), 0.0)
        return [self.langs[b] if s else UND for b, s in zip(best, seen, strict=True)], score


def fit_languages(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from all rows with a language. Counts are summed in Spark; per language one row
    of ``BUCKETS`` counts reaches the driver, and more than ``MAX_LANGS`` languages are an error."""
    own = chosen(rows, text=text_col, lang=lang_col).filter("lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in pieces(batches, "text"):
            cp, off = fold(Texts(b.column("text")))
            langs, which = np.unique(np.array(b.column("lang").to_pylist(), object), return_inverse=True)
            size = BUCKETS + 1
            total = np.bincount(which * size + BUCKETS, minlength=len(langs) * size)
            for bucket, bounds in grams(cp, off):
                total += np.bincount(np.repeat(which, np.diff(bounds)) * size + bucket, minlength=len(langs) * size)
            for i, x in enumerate(langs):
                held[x] = held.get(x, 0) + total[i * size:(i + 1) * size]
            if len(held) > 64:
                yield from flush(held)
        yield from flush(held)

    def flush(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, v in held.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(v[at], pa.int64())], names=["lang", "bucket", "n"])
        held.clear()

    def pack(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(groups))
        v = np.zeros(BUCKETS + 1, np.int64)
        v[t.column("bucket").to_numpy()] = t.column("n").to_numpy()
        yield pa.RecordBatch.from_arrays([t.column("lang").combine_chunks().slice(0, 1), pa.array([v.tobytes()], pa.binary())], names=["lang", "v"])

    counts = own.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").applyInArrow(pack, "lang string, v binary").limit(MAX_LANGS + 1).collect()
    if len(packed) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    got = sorted((r.lang, np.frombuffer(bytes(r.v), np.int64)) for r in packed)
    v = np.array([x for _, x in got], float).reshape(len(got), BUCKETS + 1)
    docs, n = v[:, -1], v[:, :-1] + 0.5
    return LanguageModel(tuple(k for k, _ in got), np.log(docs / max(docs.sum(), 1)),
                         np.log(n / n.sum(1, keepdims=True)).astype(np.float32))


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """The fold of a row by the checksum of its id as text; a null id is in no fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``lang_pred`` and ``score``, the posterior of the
    predicted language (0 for ``und``).

    Null texts and texts without a letter are ``und``, as is everything if nothing was
    learnt. Of equally likely languages the first by name is taken. A null id stays null,
    repeated rows give repeated results, columns other than the two named are not looked at.
    """
    def read(b: pa.RecordBatch) -> dict:
        lang, score = model.predict(Texts(b.column("text")))
        return {"lang_pred": lang, "score": score}

    df = arrow_map(chosen(docs, _id=id_col, text=text_col), read, {"lang_pred": STRING, "score": DOUBLE}, ["_id"])
    return df.withColumnRenamed("_id", id_col)
