"""Projections that change the shape of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.functions.canonical import md5_slice


def star_replace(df: DataFrame, **columns: Column) -> DataFrame:
    """``SELECT * REPLACE``: same columns, same order, some expressions swapped."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in df.columns])


def unpivot_long(df: DataFrame, ids: list[str], values: list[str], metric="metric", value="value") -> DataFrame:
    return df.unpivot(ids, values, metric, value)


def item_arrays(df: DataFrame, keys: list[str], fields: dict[str, str], unit: Column, limit: int) -> DataFrame:
    """Nest child rows into arrays per key, about ``limit`` items each.

    A key with more rows gets as many arrays as it needs, spread by the hash of ``unit``,
    so no array grows with the data. Every child row is kept.
    """
    s = F.struct(*[F.col(c).alias(n) for n, c in fields.items()])
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    large = large.select(*keys, F.ceil(F.col("_n") / limit).alias("_chunks"))
    d = df.join(large, keys, "left")  # the right side is unique per key: skew splits freely
    chunk = F.when(F.col("_chunks").isNull(), 0).otherwise(F.pmod(md5_slice(unit, 7).cast("long"), F.col("_chunks")))
    return d.groupBy(*keys, chunk.alias("chunk")).agg(F.collect_list(s).alias("items"))


def date_hierarchy(df: DataFrame, date: str, measures: dict[str, Column]) -> DataFrame:
    """Year > quarter > month > day totals in one rollup; ``n`` counts, others sum.

    Days are summed first, so the rollup expands one row per day and not the fact table.
    """
    d = df.withColumn("_day", F.to_date(date))
    daily = d.groupBy("_day").agg(
        *[(F.count(c) if k == "n" else F.sum(c)).alias(k) for k, c in measures.items()])
    parts = daily.select(
        F.year("_day").alias("y"), F.quarter("_day").alias("q"), F.month("_day").alias("m"),
        F.dayofmonth("_day").alias("d"), *measures)
    return parts.rollup("y", "q", "m", "d").agg(
        F.grouping_id().cast("long").alias("level"),
        *[F.sum(k).cast("long" if k == "n" else "double").alias(k) for k in measures],
    ).select(*[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in "yqmd"], "level", *measures)


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Every struct becomes flat columns named after their path."""

    def walk(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            p = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, p)
            else:
                yield p

    paths = list(walk(df.schema, ()))
    return df.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(sep.join(p)) for p in paths])


def array_to_child(df: DataFrame, parent: list[str], column: str) -> DataFrame:
    """Repeated field as a child table; a parent without items keeps one empty row."""
    return df.select(*parent, F.posexplode_outer(column).alias("ordinal", "item"))
