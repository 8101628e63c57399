"""Aggregates of one's own: partial states per task, merged in a tree.

An aggregate is three functions: ``partial`` makes the states of the groups of an Arrow batch,
``merge`` joins two states, ``finish`` turns one into the result. A task folds its batches to
one state a key; partial states of a key are merged in salted parts first and then together,
streamed in key order. So a group is never held as rows, and a hot one is as many states as
there are tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Keys that a task holds before it hands their states on, and salted parts of a key.
HELD, PARTS = 100_000, 16


@dataclass(frozen=True)
class Aggregate:
    """``partial(columns, group, n)`` gets arrays, the group number of each row and how many
    groups there are, and returns a state each."""

    partial: Callable[[dict[str, np.ndarray], np.ndarray, int], list]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    returns: T.DataType


def aggregate(df: DataFrame, keys: list[str], inputs: dict[str, str], **outputs: Aggregate) -> DataFrame:
    """One row per key with a column per aggregate. ``inputs`` names the columns they read."""
    own = df.select(*[df[k].alias(f"k{i}") for i, k in enumerate(keys)], *[df[c].alias(f"x{i}") for i, c in enumerate(inputs.values())])
    names = [f"k{i}" for i in range(len(keys))]
    key_fields = [own.schema[k] for k in names]
    key_types = [to_arrow_type(f.dataType) for f in key_fields]
    state = T.StructType([*key_fields, T.StructField("state", T.BinaryType())])
    aggs = list(outputs.values())

    def packed(states: dict) -> pa.RecordBatch:
        columns = list(zip(*states, strict=True)) if states else [[] for _ in names]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, key_types, strict=True)),
                                           pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=[*names, "state"])

    def joined(a: list, b: list) -> list:
        return [g.merge(x, y) for g, x, y in zip(aggs, a, b, strict=True)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            group, firsts = _grouped([b.column(i) for i in range(len(names))], b.num_rows)
            values = {n: b.column(len(names) + i).to_numpy(zero_copy_only=False) for i, n in enumerate(inputs)}
            states = zip(*(g.partial(values, group, len(firsts)) for g in aggs), strict=True)
            found = list(zip(*(b.column(i).take(pa.array(firsts)).to_pylist() for i in range(len(names))), strict=True)) if names else [()]
            for k, s in zip(found, states, strict=True):
                held[k] = joined(held[k], s) if k in held else list(s)
            if len(held) >= HELD:
                yield packed(held)
                held = {}
        yield packed(held)

    def merged(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state_, done = None, None, {}

            def out() -> pa.RecordBatch:
                if not last:
                    return packed(done)
                columns = list(zip(*done, strict=True)) if done else [[] for _ in names]
                results = [pa.array([g.finish(s[i]) for s in done.values()], to_arrow_type(g.returns)) for i, g in enumerate(aggs)]
                return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, key_types, strict=True)), *results], names=[*names, *outputs])

            for b in batches:
                for *k, s in zip(*(b.column(n).to_pylist() for n in [*names, "state"]), strict=True):
                    k, s = tuple(k), pickle.loads(s)
                    if k == now:
                        state_ = joined(state_, s)
                        continue
                    if now is not None:
                        done[now] = state_
                        if len(done) >= HELD:
                            yield out()
                            done.clear()
                    now, state_ = k, s
            if now is not None:
                done[now] = state_
            yield out()
        return run

    deal = lambda d, *by: (d.repartition(*by) if by else d.coalesce(1)).sortWithinPartitions(*names) if names else d.coalesce(1)
    first = own.mapInArrow(fold, state).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    half = deal(first, *names, "part").select(*names, "state").mapInArrow(merged(False), state)
    result = T.StructType([*key_fields, *(T.StructField(n, g.returns) for n, g in outputs.items())])
    return deal(half, *names).mapInArrow(merged(True), result).toDF(*keys, *outputs)


def _grouped(columns: list[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The group number of each row, and a row of each group."""
    code = np.zeros(n, np.int64)
    for c in columns:
        part, values = pd.factorize(c.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.float64), use_na_sentinel=False)
        code = pd.factorize(code * (len(values) + 1) + part)[0]
    firsts = np.unique(code, return_index=True)[1]
    return code, firsts


# A sum of doubles without any rounding: every double is a whole number of units of two to
# the power of -1074, so sums are integers. The order of rows and tasks cannot change them.
UNIT = 1074


def exact_sums(values: np.ndarray, group: np.ndarray, n: int) -> list[int]:
    """Per group, the sum of finite doubles in units of ``2 ** -UNIT``."""
    mantissa, exponent = np.frexp(values)
    whole = (mantissa * 2.0**53).astype(np.int64)
    place = exponent.astype(np.int64) - 53 + UNIT
    slot, at = np.unique(np.stack([group, place]), axis=1, return_inverse=True)
    high, low = np.zeros(slot.shape[1], np.int64), np.zeros(slot.shape[1], np.int64)
    at = at.ravel()
    np.add.at(high, at, whole >> 26)
    np.add.at(low, at, whole & ((1 << 26) - 1))
    out = [0] * n
    for (g, p), h, x in zip(slot.T.tolist(), high.tolist(), low.tolist(), strict=True):
        s = (h << 26) + x
        out[g] += s << p if p >= 0 else s >> -p
    return out


def exact_products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two doubles whose sum is the product, without rounding while nothing over- or underflows."""
    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = v * 134_217_729.0
        high = c - (c - v)
        return high, v - high

    p = x * y
    (a, b), (c, d) = halves(x), halves(y)
    return p, ((a * c - p) + a * d + b * c) + b * d


def exact_weighted_mean(value: str, weight: str) -> Aggregate:
    """Mean weighted by ``weight``, rounded once, at the end. Rows in which one of the two is
    null or not finite are left out; weights that add up to zero give null."""
    def partial(columns: dict[str, np.ndarray], group: np.ndarray, n: int) -> list:
        v, w = columns[value].astype(np.float64), columns[weight].astype(np.float64)
        both = np.isfinite(v) & np.isfinite(w)
        v, w, g = v[both], w[both], group[both]
        p, rest = exact_products(v, w)
        over, under = exact_sums(np.concatenate([p, rest]), np.concatenate([g, g]), n), exact_sums(w, g, n)
        return list(zip(over, under, strict=True))

    return Aggregate(partial, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: float(Fraction(s[0], s[1])) if s[1] else None, T.DoubleType())


def exact_concentration(value: str) -> Aggregate:
    """Sum of squared shares of a group: 1 if one row has it all, 1 / n if n rows share evenly;
    null if the values add up to zero. Null and infinite values are left out."""
    def partial(columns: dict[str, np.ndarray], group: np.ndarray, n: int) -> list:
        v = columns[value].astype(np.float64)
        fine = np.isfinite(v)
        v, g = v[fine], group[fine]
        p, rest = exact_products(v, v)
        return list(zip(exact_sums(np.concatenate([p, rest]), np.concatenate([g, g]), n), exact_sums(v, g, n), strict=True))

    return Aggregate(partial, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: float(Fraction(s[0] << UNIT, s[1] ** 2)) if s[1] else None, T.DoubleType())
