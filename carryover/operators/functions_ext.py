"""User functions: SQL functions, ported script functions, batched remote calls, table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.operators.sqlscan import split_text


def sql_function(spark: SparkSession, name: str, args: str, returns: str, body: str) -> None:
    """A temporary SQL function; Catalyst inlines its body into the plan."""
    spark.sql(f"create or replace temporary function {name}({args}) returns {returns} return {body}")


# what small script functions of the source do, as columns: no interpreter per row
SCRIPT_PORTS: dict[str, Callable[[Column], Column]] = {
    "trim": F.trim,
    "reverse": F.reverse,
    "hash_id": lambda c: F.substring(F.sha2(c, 256), 1, 16),
}


def port_check(cases: DataFrame, port: str) -> DataFrame:
    """Ported function against recorded cases (input, expected)."""
    got = SCRIPT_PORTS[port](F.col("input"))
    return cases.select("input", "expected", got.alias("actual"), got.eqNullSafe(F.col("expected")).alias("matches"))


def remote_function(df: DataFrame, column: str, out: str, out_type: str, call: Callable[[list], list], batch: int = 500) -> DataFrame:
    """A remote function called once per ``batch`` rows of a partition.

    ``call`` must be repeatable: a lost task sends its batches again.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` {out_type}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got: list = []
            for at in range(0, len(pdf), batch):
                chunk = pdf[column].iloc[at:at + batch].tolist()
                answer = call(chunk)
                if len(answer) != len(chunk):
                    raise RuntimeError("the remote function must answer every row")
                got.extend(answer)
            yield pdf.assign(**{out: got})

    return df.mapInPandas(run, schema)


def sequence_mean(c: Column) -> Column:
    """Mean of a number sequence inside its row; null for an empty one."""
    total = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(c))


def register_splitter(spark: SparkSession, name: str = "split_statements") -> None:
    """The statement splitter as a table function over a table of (id, text): it takes Arrow
    batches, and returns (id, position, statement)."""
    @F.arrow_udtf(returnType="id bigint, position int, statement string")
    class Splitter:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            found = [split_text(x or "") for x in batch.column(1).to_pylist()]
            size = np.array([len(f) for f in found], np.int64)
            at = np.repeat(np.arange(len(found)), size)
            place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.table({"id": batch.column(0).take(pa.array(at)).cast(pa.int64()), "position": pa.array(place.astype(np.int32)),
                            "statement": pa.array([s for f in found for s in f], pa.string())})

    spark.udtf.register(name, Splitter)
