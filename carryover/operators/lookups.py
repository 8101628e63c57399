"""Joins with small sides whose size is known or checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the estimate is below ``limit``; else Spark shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def rule_frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table written in code: its size is fixed, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def map_literal(pairs: list[tuple[str, object]]) -> Column:
    flat = [F.lit(v) for kv in pairs for v in kv]
    return F.create_map(*flat)


def lookup_join(df: DataFrame, key: str, pairs: list[tuple[str, object]], out: str, default=None) -> DataFrame:
    """Code table applied as a map literal inside the projection: no join, no shuffle."""
    hit = F.try_element_at(map_literal(pairs), F.col(key))
    return df.withColumn(out, F.coalesce(hit, F.lit(default)) if default is not None else hit)
