"""Small helpers shared by the operators: typed Arrow maps over chosen columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from carryover.llm.text import pieces

LONG, DOUBLE, BOOL, STRING, BINARY = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.BinaryType()
ARROW = {LONG: pa.int64(), DOUBLE: pa.float64(), BOOL: pa.bool_(), STRING: pa.string(), BINARY: pa.binary(),
         T.ArrayType(LONG): pa.list_(pa.int64())}


def chosen(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under names of our own, so that nothing else can clash."""
    return df.select(*[df[c].alias(k) for k, c in cols.items()])


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], out: dict[str, T.DataType],
              keep: Iterable[str] = (), text: str = "text") -> DataFrame:
    """Run ``fn`` over pieces of ``df``. It returns a column per name of ``out`` and, under
    ``_rows``, the rows of the piece they belong to (left out: one each, in order); the
    columns of ``keep`` are copied from there. Returning None emits nothing."""
    keep = list(keep)
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(k, t) for k, t in out.items()])
    kinds = [ARROW[t] if t in ARROW else to_arrow_type(t) for t in out.values()]
    names = keep + list(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            got = fn(piece)
            if got is None:
                continue
            rows = got.get("_rows")
            kept = [piece.column(k) if rows is None else piece.column(k).take(pa.array(rows, pa.int64())) for k in keep]
            made = [v if isinstance(v := got[k], (pa.Array, pa.ChunkedArray)) else pa.array(v, kind) for k, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(kept + made, names=names)

    return df.mapInArrow(run, schema)
