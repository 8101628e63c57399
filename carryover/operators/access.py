"""Access rules applied to data: row filters, column grants, masks, views, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions.canonical import sha256_short

PSEUDONYM = r"^principal:[0-9a-f]{12}$"


def row_filter(df: DataFrame, column: str, policies: dict[str, list], principal: str) -> DataFrame:
    """Rows a principal may see. Without a policy nothing is visible."""
    allowed = policies.get(principal)
    return df.where(F.col(column).isin(allowed) if allowed else F.lit(False))


def row_filter_by_grants(df: DataFrame, column: str, grants: DataFrame, principal: str) -> DataFrame:
    """The same with the policy in a table (principal, value): a semi join."""
    mine = grants.where(F.col("principal") == principal).select(F.col("value").alias(column))
    return df.join(mine, column, "left_semi")


def column_access(df: DataFrame, tags: dict[str, str], granted: set[str], mode: str = "null") -> DataFrame:
    """Columns whose policy tag is not granted are nulled or removed."""
    out = []
    for f in df.schema.fields:
        hidden = f.name in tags and tags[f.name] not in granted
        if hidden and mode == "drop":
            continue
        out.append(F.lit(None).cast(f.dataType).alias(f.name) if hidden else F.col(f.name))
    return df.select(*out)


def mask(c: Column, rule: str) -> Column:
    text = c.cast("string")
    if rule == "hash":
        return sha256_short(text)
    if rule == "last4":
        n = F.greatest(F.length(text) - 4, F.lit(0))
        return F.concat(F.repeat(F.lit("*"), n), F.right(text, F.lit(4)))
    if rule == "null":
        return F.lit(None).cast("string")
    if rule == "shape":
        return F.mask(text)
    raise ValueError(f"unknown mask {rule}")


def masked(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    return df.select(*[mask(F.col(c), rules[c]).alias(c) if c in rules else F.col(c) for c in df.columns])


def authorized_view(df: DataFrame, columns: list[str], predicate: Column, name: str) -> DataFrame:
    """Only the view is registered; the base stays a private plan."""
    view = df.where(predicate).select(*columns)
    view.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def audit_grantees(policies: DataFrame) -> DataFrame:
    """Grantees that are not pseudonyms, per policy (policy_id, grantees array)."""
    return policies.select("policy_id", F.explode("grantees").alias("grantee")).where(~F.col("grantee").rlike(PSEUDONYM))


def attribute_grant(df: DataFrame, column: str, attribute: Column, allowed: list[str]) -> DataFrame:
    """A column is visible only where the user attribute is one of the allowed values."""
    ok = F.array_contains(F.array(*[F.lit(a) for a in allowed]), attribute)
    return df.withColumn(column, F.when(ok, F.col(column)))
