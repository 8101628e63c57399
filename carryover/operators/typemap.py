"""Type mapping, casting to the target schema, and profiles taken before a cast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.operators.lookups import map_literal, rule_frame

LEVELS = ["direct", "transform", "redesign", "unsupported"]

# source type, lakehouse type, compatibility (fixed values)
TYPE_RULES = [
    ("BOOL", "boolean", "direct"),
    ("INT64", "long", "direct"),
    ("FLOAT64", "double", "direct"),
    ("NUMERIC", "decimal(38,9)", "direct"),
    ("BIGNUMERIC", "decimal(38,18)", "transform"),
    ("STRING", "string", "transform"),
    ("BYTES", "binary", "direct"),
    ("DATE", "date", "direct"),
    ("DATETIME", "timestamp", "transform"),
    ("TIME", "string", "transform"),
    ("TIMESTAMP", "timestamp", "transform"),
    ("INTERVAL", "string", "redesign"),
    ("RANGE", "struct", "redesign"),
    ("JSON", "string", "transform"),
    ("GEOGRAPHY", "string", "redesign"),
    ("ARRAY", "array", "redesign"),
    ("STRUCT", "struct", "redesign"),
]
# type of a warehouse column; types without one have no portable form there (fixed values)
WAREHOUSE_TYPES = [
    ("BOOL", "bit"), ("INT64", "bigint"), ("FLOAT64", "float"), ("NUMERIC", "decimal(38,9)"), ("BIGNUMERIC", "decimal(38,18)"),
    ("STRING", "varchar(max)"), ("BYTES", "varbinary(max)"), ("DATE", "date"), ("DATETIME", "datetime2"), ("TIME", "time"),
    ("TIMESTAMP", "datetime2"), ("JSON", "varchar(max)"),
]
TYPE_NOTES = [
    ("BIGNUMERIC", "values may need more digits than the target has; profile them first"),
    ("STRING", "profile the lengths before settling on varchar(max)"),
    ("DATETIME", "civil time without a zone; choose timestamp_ntz or another civil form on purpose"),
    ("TIMESTAMP", "an instant in UTC; say so when it is written"),
    ("INTERVAL", "no portable form; store the parts"),
    ("RANGE", "store start and end as columns"),
    ("JSON", "keep the raw text and project typed fields later"),
    ("GEOGRAPHY", "store WKT or GeoJSON and test the functions that are needed"),
    ("ARRAY", "keep it nested in the lakehouse or make a child table"),
    ("STRUCT", "keep it nested in the lakehouse or flatten it with lineage"),
]
UNKNOWN_TYPE_NOTE = "not a known type; find out whether it was misread or has no target"
# legacy name, current name (fixed values)
TYPE_ALIASES = [
    ("INTEGER", "INT64"),
    ("FLOAT", "FLOAT64"),
    ("BOOLEAN", "BOOL"),
    ("RECORD", "STRUCT"),
    ("DECIMAL", "NUMERIC"),
    ("BIGDECIMAL", "BIGNUMERIC"),
]
# lakehouse type -> Spark type used for the cast; civil times stay zone-free
SPARK_TYPES = {
    "long": "bigint", "DATETIME": "timestamp_ntz",
}


def level_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c) - 1


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (rank + 1).cast("int"))


def normal_type(c: Column) -> Column:
    base = F.trim(F.split_part(F.split_part(F.upper(F.trim(c)), F.lit("<"), F.lit(1)), F.lit("("), F.lit(1)))
    return F.coalesce(F.try_element_at(map_literal(TYPE_ALIASES), base), base)


def map_types(columns: DataFrame, type_col: str = "data_type") -> DataFrame:
    """Adds source_type, target_type, compatibility, warehouse_type and note; unknown types are
    unsupported."""
    rules = rule_frame(columns.sparkSession, TYPE_RULES, "source_type string, target_type string, compatibility string")
    d = columns.withColumn("source_type", normal_type(F.col(type_col)))
    note = F.when(F.col("compatibility") == "unsupported", UNKNOWN_TYPE_NOTE).otherwise(F.coalesce(F.try_element_at(map_literal(TYPE_NOTES), "source_type"), F.lit("")))
    return (d.join(rules, "source_type", "left").na.fill({"target_type": "none", "compatibility": "unsupported"})
            .withColumn("warehouse_type", F.coalesce(F.try_element_at(map_literal(WAREHOUSE_TYPES), "source_type"), F.lit("none"))).withColumn("note", note))


def type_findings(mapped: DataFrame, source: str = "source_id", path: str = "path") -> DataFrame:
    """One finding per (object, type). A catalog object has a bounded number of columns."""
    d = mapped.where(F.col("compatibility").isin("redesign", "unsupported"))
    g = d.groupBy(source, "source_type", "compatibility").agg(F.sort_array(F.collect_list(path)).alias("paths"))
    redesign = F.col("compatibility") == "redesign"
    return g.select(
        source, "source_type", F.array_join("paths", ", ").alias("paths"),
        F.when(redesign, "WARN").otherwise("FAIL").alias("severity"),
        F.when(redesign, "TYPE_REDESIGN").otherwise("TYPE_UNSUPPORTED").alias("code"))


def cast_to_target(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast a frame to the mapped schema; ``types`` maps column to source type."""
    rules = {r[0]: r[1] for r in TYPE_RULES}
    alias = dict(TYPE_ALIASES)
    out = []
    for c in df.columns:
        src = types[c].upper().split("<")[0].split("(")[0].strip()
        src = alias.get(src, src)
        if src not in rules:
            raise ValueError(f"column {c}: type {types[c]} has no target")
        target = SPARK_TYPES.get(src) or SPARK_TYPES.get(rules[src], rules[src])
        out.append(F.col(c) if target in ("array", "struct") else F.col(c).cast(target).alias(c))
    return df.select(*out)


def decimal_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that would be lost by a cast to decimal(38,18) or decimal(38,9), in one pass."""
    aggs = []
    for c in columns:
        for p in ("38,18", "38,9"):
            lost = F.col(c).isNotNull() & F.col(c).try_cast(f"decimal({p})").isNull()
            aggs.append(F.count_if(lost).alias(f"{c}:{p}"))
        aggs.append(F.count(c).alias(f"{c}:n"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}:n").alias("n"), F.col(f"{c}:38,18").alias("no_fit_38_18"),
                     F.col(f"{c}:38,9").alias("no_fit_38_9")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def string_lengths(df: DataFrame, columns: list[str], q: float = 0.95) -> DataFrame:
    """Max, mean and exact percentile of text length per column.

    Lengths are counted first; the percentile then reads one row per distinct length.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.length(c).cast("long").alias("len")) for c in columns])).alias("x")).select("x.*")
    hist = long.where("len is not null").groupBy("column", "len").agg(F.count("*").alias("n"))
    return hist.groupBy("column").agg(
        F.max("len").alias("max_len"), F.sum(F.expr("len * n")).alias("_s"), F.sum("n").alias("n"),
        F.percentile("len", F.lit(q), F.col("n")).alias("p"),
    ).select("column", "max_len", (F.col("_s").cast("double") / F.col("n")).alias("avg_len"), "n", F.col("p").alias("p_len"))


def range_split(c: Column) -> tuple[Column, Column]:
    """``[start, end)`` text to two columns; UNBOUNDED becomes null."""
    part = lambda i: F.nullif(F.trim(F.split_part(F.translate(c, "[)", ""), F.lit(","), F.lit(i))), F.lit("UNBOUNDED"))
    return part(1), part(2)


def interval_parts(c: Column) -> tuple[Column, Column, Column]:
    """``Y-M D H:M:S`` text to months, days and microseconds."""
    rx = r"^(-?)(\d+)-(\d+) (-?\d+) (-?)(\d+):(\d+):(\d+)(?:\.(\d+))?$"
    g = lambda i: F.regexp_extract(c, rx, i)
    num = lambda i: F.coalesce(g(i).try_cast("long"), F.lit(0))
    sign = lambda i: F.when(g(i) == "-", -1).otherwise(1)
    months = sign(1) * (num(2) * 12 + num(3))
    micros = F.rpad(F.coalesce(g(9), F.lit("")), 6, "0").try_cast("long")
    return months, num(4), sign(5) * ((num(6) * 3600 + num(7) * 60 + num(8)) * 1_000_000 + micros)


def schema_rows(df: DataFrame) -> list[tuple[str, str, bool, str]]:
    """(dotted path, type, nullable, mode) of every column, nested ones included."""

    def walk(schema: T.StructType, prefix: str):
        for f in schema.fields:
            path, dt, mode = f"{prefix}{f.name}", f.dataType, "NULLABLE" if f.nullable else "REQUIRED"
            if isinstance(dt, T.ArrayType):
                mode, dt = "REPEATED", dt.elementType
            yield path, dt.simpleString().split("<")[0], f.nullable, mode
            if isinstance(dt, T.StructType):
                yield from walk(dt, path + ".")

    return list(walk(df.schema, ""))
