"""Vector columns as numpy matrices inside Arrow tasks, and groups streamed from sorted batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from carryover.llm.text import mix


def float_type(kind: T.DataType) -> np.dtype:
    """How components are packed: floats stay floats, everything else becomes a double."""
    return np.dtype(np.float32 if isinstance(kind.elementType, T.FloatType) else np.float64)


def whole_vectors(column: pa.Array, dtype: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) per length, of the vectors that are not null or empty and whose
    components are all there and finite. Negative zero becomes zero."""
    a = pc.cast(column, pa.list_(pa.from_numpy_dtype(dtype)))
    size = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(a.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(dtype) + dtype.type(0)
    start = np.cumsum(size) - size
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        m = flat[start[rows][:, None] + np.arange(n)]
        fine = np.isfinite(m).all(axis=1)
        if fine.any():
            yield rows[fine], m[fine]


def packed(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """The matrices as one binary value a row, null where a row is in none of them."""
    out = [None] * n
    for rows, m in parts:
        raw, width = m.tobytes(), m.shape[1] * m.itemsize
        for at, r in enumerate(rows.tolist()):
            out[r] = raw[at * width:(at + 1) * width]
    return pa.array(out, pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, dtype: np.dtype, width: int = 0) -> np.ndarray:
    """One row a binary value, shorter ones (than the longest, or ``width``) ended by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // dtype.itemsize
    n, d = len(column), max(width, int(size.max(initial=0)))
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int32)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[off[0]:off[-1]].view(dtype) if data is not None else np.zeros(0, dtype)
    if n and (size == d).all():
        return flat.reshape(n, d)
    out = np.zeros((n, d), dtype)
    out[np.arange(d) < size[:, None]] = flat
    return out


def names(m: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row; equal rows, equal name."""
    raw = np.ascontiguousarray(m).view(np.uint32).reshape(len(m), -1)
    place = mix(np.arange(1, raw.shape[1] + 1).astype(np.uint64))
    return mix(mix(raw.astype(np.uint64) + place).sum(axis=1, dtype=np.uint64) + np.uint64(m.shape[1])).view(np.int64)


def units(m: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length one; scaled first, so that no square overflows."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True, initial=0)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches that are sorted by the keys, cut where a key changes."""
    for b in batches:
        if not b.num_rows:
            continue
        k = [b.column(c).to_numpy(zero_copy_only=False) for c in keys]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
        for a, e in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            yield tuple(x[a] for x in k), b.slice(a, e - a)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it."""
    for _, parts in groupby(runs(batches, keys), key=itemgetter(0)):
        yield pa.Table.from_batches([b for _, b in parts])
