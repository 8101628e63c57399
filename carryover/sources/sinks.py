"""Load patterns. Each survives a retry: a run that is repeated does not add rows twice."""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.operators.dml import upsert_latest


def read_back(df: DataFrame, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return df.sparkSession.read.format(fmt).schema(df.schema).options(**options).load(path)


def overwrite(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return read_back(df, path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append one run. The run id is a partition that a retry overwrites, so a run that is
    sent twice is stored once."""
    overwrite_partitions(df.withColumn("run_id", F.lit(run_id)), path, ["run_id"])


def load_timestamped(df: DataFrame, run_ts: str) -> DataFrame:
    return df.withColumn("_load_timestamp", F.lit(run_ts).cast("timestamp"))


def read_watermark(spark: SparkSession, state: str, table: str, dtype: T.DataType) -> str | None:
    """Last committed watermark of a table as text that casts back to the same value; None
    when it was never loaded. Watermarks compare as values of ``dtype``, not as text."""
    try:
        marks = spark.read.schema("table string, watermark string").parquet(state)
        top = marks.where(F.col("table") == table).agg(F.max(F.col("watermark").cast(dtype)).cast("string")).first()[0]
    except Exception as e:  # noqa: BLE001  the state folder appears with the first commit
        if "PATH_NOT_FOUND" not in str(e):
            raise
        top = None
    return top


def incremental_load(source: DataFrame, column: str, path: str, state: str, table: str, until: str | None = None) -> str | None:
    """Copy rows newer than the watermark, then record the new watermark, exactly as it is.

    ``column`` may have any type whose text casts back to the same value: times, dates, numbers,
    text. The batch is stored under its starting watermark, so a run that died before the
    record was written is replaced by its retry. Returns the new watermark. Rows with a null
    in ``column`` have no place in the order and are not copied.
    """
    spark, dtype = source.sparkSession, source.schema[column].dataType
    low = read_watermark(spark, state, table, dtype)
    batch = source.where(F.col(column).isNotNull() if low is None else F.col(column) > F.lit(low).cast(dtype))
    if until is not None:
        batch = batch.where(F.col(column) <= F.lit(until).cast(dtype))
    after = batch_name(low)
    tagged = batch.withColumn("_after", F.lit(after))
    overwrite_partitions(tagged, path, ["_after"])
    high = spark.read.schema(tagged.schema).parquet(path).where(F.col("_after") == after).agg(F.max(column).cast("string")).first()[0]
    if high is None:
        return low
    spark.createDataFrame([(table, high)], "table string, watermark string").write.mode("append").parquet(state)
    return high


def batch_name(low: str | None) -> str:
    """Folder name of the batch that starts behind a watermark; not a number or a date, so that
    reading the folder back never turns it into one."""
    return "first" if low is None else "after " + low


class Model:
    """One model of a transformation project."""

    def __init__(self, name, sql, kind="table", refs=(), unique_key=(), order=()):
        self.name, self.sql, self.kind = name, sql, kind
        self.refs, self.unique_key, self.order = tuple(refs), list(unique_key), list(order)


def materialize_models(spark: SparkSession, models: list[Model], base: str, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Run models after the ones they reference.

    ``view`` and ``ephemeral`` models stay lazy plans (Catalyst inlines them); ``table``
    models are written; ``incremental`` ones upsert into what an earlier run stored.
    """
    by_name = {m.name: m for m in models}
    order = TopologicalSorter({m.name: [r for r in m.refs if r in by_name] for m in models}).static_order()
    frames = dict(inputs)
    for name in order:
        m = by_name[name]
        df = spark.sql(m.sql, **{k: v for k, v in frames.items() if "{" + k + "}" in m.sql})
        if m.kind == "table":
            df = overwrite(df, f"{base}/{name}")
        elif m.kind == "incremental":
            versions = f"{base}/{name}"
            prior = inputs.get(f"{name}__stored")
            df = overwrite(upsert_latest(prior, df, m.unique_key, m.order) if prior is not None else df, versions)
        frames[name] = df
    return frames


def refresh_rollup(fact: DataFrame, path: str, bucket: Column, keys: list[str], aggs: list[Column], changed=None) -> DataFrame:
    """Gold rollup partitioned by ``bucket``; a refresh recomputes only changed buckets."""
    d = fact.withColumn("bucket", bucket)
    if changed is not None:
        d = d.where(F.col("bucket").isin(changed))
    roll = d.groupBy("bucket", *keys).agg(*aggs)
    overwrite_partitions(roll, path, ["bucket"])
    return fact.sparkSession.read.schema(roll.schema).parquet(path)


def write_report(df: DataFrame, path: str, keys: list[str], fmt: str = "csv", single_file: bool = False) -> DataFrame:
    """Stable report: rows in key order, so equal input gives equal rows in equal order.

    Parts are range-sorted and named in that order. ``single_file`` asks for one part, which
    one task then writes; only for reports known to be small.
    """
    ordered = df.orderBy(*keys)
    if single_file:
        ordered = ordered.coalesce(1)
    writer = ordered.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
    return read_back(df, path, fmt, **({"header": "true"} if fmt == "csv" else {}))


def wildcard_scan(spark: SparkSession, pattern: str, schema: T.StructType, suffix_regex: str, low: str, high: str) -> DataFrame:
    """Many same-shaped files as one table, filtered by a suffix taken from the path.

    The filter reads only file metadata, so Spark drops the other files at planning.
    """
    d = spark.read.schema(schema).parquet(pattern)
    suffix = F.regexp_extract(F.col("_metadata.file_path"), suffix_regex, 1)
    return d.where(suffix.between(low, high)).select("*", suffix.alias("table_suffix"))


def parse_json_events(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Typed columns from a JSON text column plus ``_ingestion_time``; rows that do not
    parse keep their text in ``_bad`` for quarantine."""
    parsed = F.from_json(column, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    names = [p.split()[0] for p in schema.split(",")]
    d = df.withColumn("_j", parsed)
    return d.select(*df.columns, *[F.col(f"_j.{n}").alias(n) for n in names],
                    F.col("_j._corrupt").alias("_bad"), F.current_timestamp().alias("_ingestion_time"))
