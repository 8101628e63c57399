"""Data-quality rules as aggregates and anti-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.sources.estate import KINDS, PROVENANCE


def failing_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("failures")) for c in columns])))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def assertions(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every rule must hold for every row; all rules are counted in one pass. A rule that
    is unknown for a row counts as broken."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    d = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("assertion"), F.col(n).alias("failures")) for n in rules])))
    return d.withColumn("passed", F.col("failures") == 0)


def observed(df: DataFrame, name: str, rules: dict[str, Column]):
    """The same counts taken while another job runs: returns (frame, Observation)."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]), obs


def duplicate_identity(df: DataFrame, key: str, name: str) -> DataFrame:
    """Ids that occur more than once, in one partial aggregate: number of copies, whether
    the copies carry different names, and whether they differ by more than letter case."""
    g = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("copies"), F.min(name).alias("_lo"), F.max(name).alias("_hi"),
        F.min(F.lower(name)).alias("_ll"), F.max(F.lower(name)).alias("_lh"))
    return g.where("copies > 1").select(key, "copies", (F.col("_lo") != F.col("_hi")).alias("conflicting"),
                                        (F.col("_ll") == F.col("_lh")).alias("same_ignoring_case"))


def dedupe_keep_conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact copies collapse to one row; keys that still repeat are flagged for review."""
    d = df.distinct()
    still = duplicate_keys(d, keys).select(*keys, F.lit(True).alias("conflict"))
    return d.join(still, keys, "left").na.fill(False, ["conflict"])


def repair_until_stable(df: DataFrame, rules: list[tuple[str, dict[str, Column]]], valid: Column, max_passes: int = 5,
                        settle: Callable[[DataFrame], DataFrame] | None = None):
    """Apply column rules in order until a pass changes nothing.

    Each pass is one projection; the number of changed rows per rule comes from one
    aggregate. Returns (frame, status, applied rules, passes): ``repaired`` or ``passed``
    when every row is valid, ``manual_review`` when the loop did not settle or a row is not.
    """
    if max_passes < 1:
        raise ValueError("max_passes must be at least 1")
    settle = settle or (lambda d: d)
    applied: list[str] = []
    for done in range(1, max_passes + 1):
        cur, marks = df, []
        for i, (_, assign) in enumerate(rules):
            before = F.struct(*[F.col(c) for c in assign])
            cur = cur.withColumn(f"_b{i}", before)
            cur = cur.withColumns(assign)
            marks.append(f"_m{i}")
            cur = cur.withColumn(f"_m{i}", ~F.col(f"_b{i}").eqNullSafe(F.struct(*[F.col(c) for c in assign]))).drop(f"_b{i}")
        cur = settle(cur)
        hits = cur.agg(*[F.count_if(F.col(m)).alias(m) for m in marks]).first()
        df = cur.drop(*marks)
        changed = [rules[i][0] for i, m in enumerate(marks) if hits[m]]
        applied += changed
        if not changed:
            break
    if changed:
        return df, "manual_review", applied, done
    broken = df.where(~F.coalesce(valid, F.lit(False))).agg(F.count(F.lit(1))).first()[0]
    return df, "manual_review" if broken else ("repaired" if applied else "passed"), applied, done


def orphan_count(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose foreign key has no parent. Keys are counted first, so the join carries
    one row per distinct key and a hot key costs nothing extra."""
    c = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    p = parent.select(F.col(pk).alias("_k")).distinct()
    return c.join(p, "_k", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans"), F.count(F.lit(1)).alias("orphan_keys"))


def over_limit(df: DataFrame, parent: str, limit: int, code: str) -> DataFrame:
    g = df.groupBy(parent).agg(F.count(F.lit(1)).alias("n"))
    return g.select(parent, "n", F.when(F.col("n") > limit, code).otherwise("ok").alias("code"))


def validate_estate(objects: DataFrame) -> DataFrame:
    """All contract violations of catalog rows (source_id, rule), not just the first.

    Row rules are a filtered array inside one projection; only uniqueness needs a shuffle.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    rules = {
        "empty source_id": blank("source_id"), "empty name": blank("name"),
        "unknown kind": ~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)),
        "unknown provenance": ~F.coalesce(F.col("discovered_from").isin(PROVENANCE), F.lit(False)),
        "negative size": F.coalesce(F.col("size_bytes") < 0, F.lit(False)),
        "empty dependency": F.coalesce(F.exists("dependencies", lambda d: F.coalesce(d == "", F.lit(True))), F.lit(False)),
        "bad column": F.coalesce(F.exists("columns", lambda c: F.coalesce(c["name"] == "", F.lit(True))
                                          | F.coalesce(c["data_type"] == "", F.lit(True))), F.lit(False)),
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    rows = objects.select("source_id", F.explode(hits).alias("rule"))
    dup = objects.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("source_id", F.lit("duplicate source_id").alias("rule"))
    return rows.unionByName(dup)
