"""Canonical text forms, so that values from two engines compare as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "-"


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def decimal_text(c: Column) -> Column:
    """Number as plain decimal text without trailing zeros; ``100.50`` equals ``100.5``."""
    text = c.cast("string")
    cut = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.contains("."), cut).otherwise(text)


def canonical_number(text: Column) -> Column:
    """Text that holds a number becomes canonical decimal text; other text passes through."""
    num = text.try_cast("decimal(38,9)")
    return F.when(num.isNotNull(), decimal_text(num)).otherwise(text)


# The generated forms below are SQL text: a wide table needs hundreds of expressions, and
# one parsed text is built far faster than as many nested column objects.


def decimal_text_sql(x: str) -> str:
    cut = rf"regexp_replace(regexp_replace(cast({x} as string), r'(\.\d*?)0+$', r'$1'), r'\.$', '')"
    return f"if(contains(cast({x} as string), '.'), {cut}, cast({x} as string))"


def canonical_sql(x: str, dtype: T.DataType, depth: int = 0) -> str:
    """A value as text that no other value of its type has, equal for equal values.

    A null is ``-``. A plain value is its text behind the text's length and a colon: decimals of
    one value are one text whatever their scale, floats have the digits that tell them from every
    other float (negative zero is zero), times are civil, to the microsecond. What holds values
    is built from their forms at every depth: arrays in order behind their size, structs by field
    name, maps by the form of their entries. Forms tell where they end, so none needs quoting.
    """
    if isinstance(dtype, T.StructType):
        fields = "".join(f", {canonical_sql(f'{x}.`{f.name}`', f.dataType, depth)}" for f in sorted(dtype.fields, key=lambda f: f.name))
        return f"if({x} is null, '{NULL_MARK}', concat('('{fields}, ')'))"
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        v = f"v{depth}"
        if isinstance(dtype, T.ArrayType):
            forms = f"transform({x}, {v} -> {canonical_sql(v, dtype.elementType, depth + 1)})"
        else:
            entry = f"concat({canonical_sql(f'{v}.key', dtype.keyType, depth + 1)}, {canonical_sql(f'{v}.value', dtype.valueType, depth + 1)})"
            forms = f"array_sort(transform(map_entries({x}), {v} -> {entry}))"
        return f"coalesce(concat('[', cast(size({x}) as string), ':', array_join({forms}, ''), ']'), '{NULL_MARK}')"
    if isinstance(dtype, T.DecimalType):
        out = decimal_text_sql(x)
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        out = f"cast({x} + cast(0 as {dtype.simpleString()}) as string)"
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        out = f"date_format({x}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    elif isinstance(dtype, T.VariantType):
        out = f"to_json({x})"
    elif isinstance(dtype, T.BinaryType):
        out = f"hex({x})"
    else:
        out = f"cast({x} as string)"
    return f"coalesce(concat(cast(length({out}) as string), ':', {out}), '{NULL_MARK}')"


def canonical_value_sql(name: str, dtype: T.DataType) -> str:
    """The canonical form of a column."""
    return canonical_sql(f"`{name}`", dtype)


def canonical_row_sql(schema: T.StructType, columns: list[str] | None = None) -> str:
    """The whole row as one text, columns in name order. Lengths tell where a value ends, so
    rows that differ have different texts."""
    types = {f.name: f.dataType for f in schema.fields}
    return "concat(" + ", ".join(canonical_value_sql(n, types[n]) for n in sorted(columns or types)) + ")"


def row_digest_sql(schema: T.StructType) -> str:
    """Sum over the rows of 60 bits of their md5: equal for equal bags, in any order."""
    return f"sum(cast(conv(substr(md5({canonical_row_sql(schema)}), 1, 15), 16, 10) as decimal(28,0)))"


def row_hash_sql(schema: T.StructType, columns: list[str]) -> list[str]:
    """Two integers of 60 bits, disjoint parts of the md5 of some columns of a row."""
    md5 = f"md5({canonical_row_sql(schema, columns)})"
    return [f"cast(conv(substr({md5}, {at}, 15), 16, 10) as decimal(28,0))" for at in (1, 16)]


def md5_slice(c: Column, digits: int = 15) -> Column:
    """First ``digits`` hex digits of the md5 as an exact integer."""
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("decimal(20,0)")


def md5_bucket(c: Column, buckets: int = 100) -> Column:
    """Repeatable bucket of a key, the same in every engine that has md5."""
    return F.pmod(md5_slice(c, 7).cast("long"), F.lit(buckets))


def sha256_short(c: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, digits)


def pseudonym(c: Column) -> Column:
    """Stable stand-in for a principal: the same person, however written, gets one name."""
    return F.concat(F.lit("principal:"), sha256_short(F.lower(F.trim(c))))
