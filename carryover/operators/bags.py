"""Multiset operations by counting, so copies are never generated to be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bag_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each distinct row with its number of copies on either side (``_a``, ``_b``).

    Both sides are pre-counted before the shuffle, so a row that makes up a third of a
    table travels once per map task. Nulls group together, as set operations require.
    """
    cols = a.columns
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = a.select(*cols, one.alias("_a"), zero.alias("_b")).unionByName(
        b.select(*cols, zero.alias("_a"), one.alias("_b")))
    return both.groupBy(*cols).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))


def _copies(counted: DataFrame, n, cols) -> DataFrame:
    # Long sequences are cut into blocks of 10000 so that no single row grows huge.
    block = 10_000
    d = counted.withColumn("_n", n).where("_n > 0")
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {block}"))))
    size = F.least(F.lit(block).cast("long"), F.col("_n") - F.col("_k") * block)
    return d.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), size))).select(*cols)


def bag_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _copies(bag_counts(a, b), F.least("_a", "_b"), a.columns)


def bag_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _copies(bag_counts(a, b), F.col("_a") - F.col("_b"), a.columns)


def bag_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs: ``side`` says where the surplus is."""
    return (
        bag_counts(a, b).where("_a <> _b")
        .withColumn("side", F.when(F.expr("_a > _b"), "source").otherwise("target"))
        .withColumn("copies", F.abs(F.expr("_a - _b"))).drop("_a", "_b"))
