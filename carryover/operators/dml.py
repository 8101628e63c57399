"""INSERT, UPDATE, DELETE, MERGE and change logs as rewrites that return the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.operators.windows import latest_per_key


def insert_rows(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows.select(*target.columns))


def update_where(target: DataFrame, predicate: Column, **assign: Column) -> DataFrame:
    return target.select(*[
        F.when(predicate, assign[c]).otherwise(F.col(c)).alias(c) if c in assign else F.col(c)
        for c in target.columns])


def delete_where(target: DataFrame, predicate: Column) -> DataFrame:
    """A row is deleted only where the predicate is true; unknown keeps it."""
    return target.where(~F.coalesce(predicate, F.lit(False)))


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    *,
    update: list[str] | None = None,
    delete: Column | None = None,
    insert: bool = True,
) -> DataFrame:
    """MERGE as one full outer join.

    ``update`` lists the columns taken from the source on a match (default: all but the
    keys). ``delete`` is a predicate over the source columns that removes the matched
    row. A target row that meets two source rows raises, as the statement does; source
    copies that match nothing are all inserted.
    """
    cols = target.columns
    update = [c for c in cols if c not in keys] if update is None else update
    # Copies are only an error when the key exists in the target, so the count travels along.
    n = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    dup = n.where("_copies > 1").select(*keys, F.lit(True).alias("_dup"))
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in cols if c not in keys],
                      (delete if delete is not None else F.lit(False)).alias("_del"), F.lit(True).alias("_src"))
    t = target.withColumn("_tgt", F.lit(True)).join(dup, keys, "left")
    t = t.withColumn("_tgt", F.when(F.col("_dup"), F.raise_error(F.lit(
        "MERGE: a target row matches more than one source row")).cast("boolean")).otherwise(F.col("_tgt"))).drop("_dup")
    j = t.join(s, keys, "full")
    matched = F.col("_tgt").isNotNull() & F.col("_src").isNotNull()
    only_source = F.col("_tgt").isNull()
    keep = ~(matched & F.coalesce(F.col("_del"), F.lit(False)))
    keep = keep & (~only_source | (F.lit(insert) & ~F.coalesce(F.col("_del"), F.lit(False))))
    out = []
    for c in cols:
        if c in keys:
            out.append(F.col(c))
            continue
        from_source = only_source | (matched if c in update else F.lit(False))
        out.append(F.when(from_source, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
    return j.where(keep).select(*out)


def upsert_latest(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incremental model: newest source row per key replaces or joins the target.

    Copies of a key in the source are reduced by a partial aggregate before the join.
    """
    if not keys:
        raise ValueError("an incremental model needs a unique key")
    fresh = latest_per_key(source, keys, order).select(*target.columns)
    return target.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def upsert_by_priority(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Later frames replace whole rows of earlier ones; property maps are not merged."""
    tagged = [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    both = tagged[0]
    for f in tagged[1:]:
        both = both.unionByName(f)
    return latest_per_key(both, keys, ["_p"]).drop("_p")


def change_set(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Insert/update/delete set that turns ``before`` into ``after``; carries the new values."""
    vals = [c for c in after.columns if c not in keys]
    b = before.select(*keys, F.struct(*vals).alias("_b"))
    a = after.select(*keys, F.struct(*vals).alias("_a"))
    j = b.join(a, keys, "full")
    op = (F.when(F.col("_b").isNull(), "insert").when(F.col("_a").isNull(), "delete")
          .when(~F.col("_a").eqNullSafe(F.col("_b")), "update"))
    new = F.coalesce("_a", "_b")
    return j.withColumn("op", op).where("op is not null").select(
        *keys, "op", *[new.getField(v).alias(v) for v in vals])


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Apply a change log (``op`` column): newest change per key wins."""
    last = latest_per_key(changes, keys, order)
    live = last.where("op <> 'delete'").select(*target.columns)
    return target.join(last.select(*keys), keys, "left_anti").unionByName(live)


def state_as_of(log: DataFrame, keys: list[str], order: list[str], as_of: str, deleted: Column) -> DataFrame:
    """Table state at a moment: newest change per key up to it, without deleted keys."""
    seen = log.where(F.col(order[0]) <= F.lit(as_of).cast(log.schema[order[0]].dataType))
    return latest_per_key(seen, keys, order).where(~F.coalesce(deleted, F.lit(False)))
