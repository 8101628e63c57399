"""Data parity: run both sides, compare the evidence, name the rows that differ.

Every side of a table is read once: all counts, null counts, exact aggregates and the
order-free digest come from a single aggregate, so the only shuffle is one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.functions.canonical import canonical_value_sql, decimal_text_sql, md5_bucket, md5_slice, row_digest_sql, row_hash_sql
from carryover.operators.bags import bag_diff
from carryover.operators.typemap import schema_rows
from carryover.session import settle

ALGORITHM = "sum-md5-60-netstring-2"
ORDERING = "order-free"
MAX_EXPRESSIONS = 300
SAFE_IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"
DATA_BEARING = ["table", "external_table", "materialized_view", "view"]
EVIDENCE = "table string, check string, item string, value string, row_count bigint"


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def exact_columns(schema: T.StructType) -> list[str]:
    """Integers and decimals; floats are left out because their sums are not exact."""
    return [f.name for f in schema if isinstance(f.dataType, (T.IntegralType, T.DecimalType))]


def flat_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))]


ONE_PASS = ("row_count", "null_distribution", "aggregate", "checksum", "schema", "sample")


def table_evidence(df: DataFrame, table: str, checks=ONE_PASS[:4], sample: tuple[str, int] | None = None, queries: dict[str, str] | None = None) -> DataFrame:
    """Evidence rows of one side of a table.

    ``checks`` come from one pass over it (a table of over ``MAX_EXPRESSIONS`` items takes one
    per so many). ``sample`` (key column, per cent) says which rows the check of that name takes:
    the same keys on both sides. ``queries`` are named SQL texts over ``{d}``; each is the check
    ``sql_result`` of its name and reads the table once more.
    """
    schema = df.schema
    named: list[tuple[str, str, str]] = []
    if "schema" in checks:
        named += [("schema", f"{path}.{what}", _text(value)) for path, dt, nullable, mode in schema_rows(df)
                  for what, value in (("data_type", dt), ("nullable", str(nullable).lower()), ("mode", mode))]
    if "sample" in checks:
        if sample is None:
            raise ValueError("the check 'sample' needs a key column and a percentage")
        key, percent = sample
        taken = f"pmod(cast(conv(substr(md5(cast(`{key}` as string)), 1, 7), 16, 10) as bigint), 100) < {int(percent)}"
        named += [("sample", f"{key}.{percent}.rows", f"cast(count_if({taken}) as string)"),
                  ("sample", f"{key}.{percent}.digest", f"cast(coalesce({row_digest_sql(schema)} filter (where {taken}), 0) as string)")]
    if "null_distribution" in checks:
        named += [("null_distribution", c, f"cast(count_if(`{c}` is null) as string)") for c in flat_columns(schema)]
    if "aggregate" in checks:
        for c in exact_columns(schema):
            # Integers are summed as decimals, so a sum over any number of rows cannot overflow.
            x = f"`{c}`" if isinstance(schema[c].dataType, T.DecimalType) else f"cast(`{c}` as decimal(20,0))"
            named += [("aggregate", f"{c}.{fn}", decimal_text_sql(f"{fn}({x})")) for fn in ("sum", "min", "max")]
    if "checksum" in checks:
        named += [("checksum", "algorithm", f"'{ALGORITHM}'"), ("checksum", "ordering", f"'{ORDERING}'"),
                  ("checksum", "value", f"cast(coalesce({row_digest_sql(schema)}, 0) as string)")]
    if "row_count" in checks:
        named.append(("row_count", "rows", "cast(count(1) as string)"))
    out = []
    for at in range(0, len(named), MAX_EXPRESSIONS):
        part = named[at:at + MAX_EXPRESSIONS]
        one = df.selectExpr("count(1) as _n", *[f"{e} as _m{i}" for i, (_, _, e) in enumerate(part)])
        rows = ", ".join(f"{_text(table)}, '{k}', {_text(i)}, _m{j}, _n" for j, (k, i, _) in enumerate(part))
        out.append(one.selectExpr(f"stack({len(part)}, {rows}) as (table, check, item, value, row_count)"))
    for name, text in (queries or {}).items():
        result = df.sparkSession.sql(text, d=df)
        one = result.selectExpr("count(1) as _n", f"cast(coalesce({row_digest_sql(result.schema)}, 0) as string) as _d")
        out.append(one.selectExpr(f"stack(2, {_text(table)}, 'sql_result', {_text(name + '.rows')}, cast(_n as string), _n, "
                                  f"{_text(table)}, 'sql_result', {_text(name + '.digest')}, _d, _n) as (table, check, item, value, row_count)"))
    return union(out)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def valid_count(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d+$"), F.lit(False))


def compare_evidence(source: DataFrame, target: DataFrame) -> DataFrame:
    """Evidence rows of both sides with a status each.

    Missing or invalid input is ``not_run``, never a pass. An item that exists on one side
    only is a difference, even when its value there is null.
    """
    s = source.select("table", "check", "item", F.col("value").alias("source"), F.col("row_count").alias("_sr"), F.lit(True).alias("_s"))
    t = target.select("table", "check", "item", F.col("value").alias("target"), F.col("row_count").alias("_tr"), F.lit(True).alias("_t"))
    j = s.join(t, ["table", "check", "item"], "full").na.fill(False, ["_s", "_t"])
    # Whether a side reported the check at all. Evidence has one row per column, so the
    # window is small, and unlike a join it does not read the tables a second time.
    w = W.partitionBy("table", "check")
    j = j.withColumns({"_hs": F.bool_or("_s").over(w), "_ht": F.bool_or("_t").over(w)})
    count_like = F.col("check").isin("row_count", "null_distribution")
    bad_count = count_like & ((F.col("_s") & ~valid_count(F.col("source"))) | (F.col("_t") & ~valid_count(F.col("target"))))
    over = (F.col("check") == "null_distribution") & (
        F.coalesce(F.col("source").try_cast("long") > F.col("_sr"), F.lit(False))
        | F.coalesce(F.col("target").try_cast("long") > F.col("_tr"), F.lit(False)))
    no_digest = (F.col("check") == "checksum") & (
        F.coalesce(F.col("source") == "", F.lit(True)) | F.coalesce(F.col("target") == "", F.lit(True)))
    status = (F.when(~(F.col("_hs") & F.col("_ht")), "not_run").when(bad_count | over | no_digest, "not_run")
              .when(~(F.col("_s") & F.col("_t")), "failed")
              .when(F.col("source").eqNullSafe(F.col("target")), "passed").otherwise("failed"))
    return j.select("table", "check", "item", "source", "target", status.alias("status"))


def worst_status(status: Column) -> Column:
    """failed beats not_run beats passed; only when nothing applies: not_applicable."""
    return (F.when(F.bool_or(status == "failed"), "failed").when(F.bool_or(status == "not_run"), "not_run")
            .when(F.bool_and(status == "not_applicable"), "not_applicable").otherwise("passed"))


def check_status(rows: DataFrame) -> DataFrame:
    """One status per (table, check). An invalid item makes the whole check not_run."""
    s = F.col("status")
    # Labels decide first for a digest; for the others an invalid item outranks a difference.
    status = F.when(F.bool_or(s == "not_run"), "not_run").when(F.bool_or(s == "failed"), "failed").otherwise("passed")
    return rows.groupBy("table", "check").agg(status.alias("status"), F.count_if(s == "failed").alias("differences"))


def table_status(checks: DataFrame, objects: DataFrame) -> DataFrame:
    """Computed status per object. ``objects``: table, kind, declared (may be null).

    A declared status is never trusted; when it contradicts the evidence it is kept aside.
    """
    per = checks.groupBy("table").agg(worst_status(F.col("status")).alias("_computed"))
    status = (F.when(~F.col("kind").isin(DATA_BEARING), "not_applicable")
              .otherwise(F.coalesce("_computed", F.lit("not_run"))))
    d = objects.join(per, "table", "left").withColumn("status", status)
    return d.select("table", "kind", "status",
                    F.when(F.col("declared") != F.col("status"), F.col("declared")).alias("declared_status"))


def parity_report(source: DataFrame, target: DataFrame, table: str, **kw) -> DataFrame:
    return compare_evidence(table_evidence(source, table, **kw), table_evidence(target, table, **kw))


def parity_sample(source: DataFrame, target: DataFrame, key: str, percent: int) -> DataFrame:
    """Bag difference of the same repeatable sample of keys on both sides."""
    pick = lambda d: d.where(md5_bucket(F.col(key).cast("string")) < percent)
    return bag_diff(pick(source), pick(target))


def row_diff(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that differ: ``missing`` in the target, ``extra`` there, ``changed`` with the names
    of the changed columns, or ``bag``.

    A key that occurs more than once on a side has no row to be compared with; its copies are
    compared as a bag. Values are compared in canonical form, which keeps nulls and positions.
    First counts and digests of both sides meet, one small row a key and task; whole rows are
    read only of keys whose only rows differ.
    """
    vals = [c for c in source.columns if c not in keys]

    def side(d: DataFrame, name: str) -> DataFrame:
        return d.selectExpr(*[f"`{k}`" for k in keys], *[f"{h} as _h{i}" for i, h in enumerate(row_hash_sql(d.schema, vals) if vals else ["0", "0"])], f"'{name}' as _side")

    on = {n: F.col("_side") == n for n in "st"}
    zero = F.lit(0).cast("decimal(38,0)")
    met = side(source, "s").unionByName(side(target, "t")).groupBy(*keys).agg(
        *[F.count_if(on[n]).alias(f"_n{n}") for n in "st"],
        *[F.coalesce(F.sum(F.when(on[n], F.col(f"_h{i}"))).cast("decimal(38,0)"), zero).alias(f"_{n}{i}") for n in "st" for i in (0, 1)])
    apart = (F.col("_ns") != F.col("_nt")) | (F.col("_s0") != F.col("_t0")) | (F.col("_s1") != F.col("_t1"))
    op = (F.when(F.col("_nt") == 0, "missing").when(F.col("_ns") == 0, "extra")
          .when((F.col("_ns") == 1) & (F.col("_nt") == 1), "changed").otherwise("bag"))
    found = settle(met.where(apart).select(*keys, op.alias("op")), "differing")

    def rows(d: DataFrame, name: str) -> DataFrame:
        """The only rows of changed keys, each value in canonical form."""
        want = found.where("op = 'changed'").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        same = [d[k].eqNullSafe(want[f"_k{i}"]) for i, k in enumerate(keys)]
        types = {f.name: f.dataType for f in d.schema}
        return d.join(want, same, "left_semi").selectExpr(*[f"`{k}` as {name}k{i}" for i, k in enumerate(keys)],
                                                          *[f"{canonical_value_sql(c, types[c])} as {name}v{i}" for i, c in enumerate(vals)])

    other = found.where("op <> 'changed'").withColumn("changed", F.lit(""))
    if not vals:
        return other
    pairs = rows(source, "s").join(rows(target, "t"), [F.col(f"sk{i}").eqNullSafe(F.col(f"tk{i}")) for i in range(len(keys))])
    changed = F.array_compact(F.array(*[F.when(F.col(f"sv{i}") != F.col(f"tv{i}"), F.lit(c)) for i, c in enumerate(vals)]))
    named = pairs.select(*[F.col(f"sk{i}").alias(k) for i, k in enumerate(keys)], F.lit("changed").alias("op"), F.array_join(changed, ",").alias("changed"))
    return other.unionByName(named)


def build_pack(tables: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Parity of many tables; unsafe names are skipped and reported, not repaired.

    One aggregate per table side; Spark runs the sides of the union side by side.
    """
    import re

    good, skipped = [], []
    for name, (s, t) in sorted(tables.items()):
        if all(re.match(SAFE_IDENTIFIER, x) for x in [name, *s.columns]):
            good.append((name, s, t))
        else:
            skipped.append((name, "unsafe_identifier"))
    checks = ("row_count", "null_distribution", "aggregate")
    src = union([table_evidence(s, n, checks) for n, s, _ in good])
    tgt = union([table_evidence(t, n, checks) for n, _, t in good])
    return compare_evidence(src, tgt), skipped


def pack_checks(objects: DataFrame, columns: DataFrame) -> DataFrame:
    """The checks a catalog asks for: query id, check, expected items; plus skipped objects.

    ``objects``: source_id, name, kind; ``columns``: source_id, path, source_type, mode.
    """
    exact = F.col("source_type").isin("INT64", "NUMERIC", "BIGNUMERIC")
    flat = (F.col("mode") != "REPEATED") & ~F.col("source_type").isin("STRUCT", "ARRAY", "JSON", "GEOGRAPHY")
    cols = columns.groupBy("source_id").agg(
        F.sort_array(F.collect_list(F.when(flat, F.col("path")))).alias("flat"),
        F.sort_array(F.collect_list(F.when(flat & exact, F.col("path")))).alias("exact"))
    d = objects.where(F.col("kind").isin(DATA_BEARING)).join(cols, "source_id", "left")
    parts = F.split("source_id", r"\.")
    safe = ((F.size(parts) == 3) & F.element_at(parts, 2).rlike(SAFE_IDENTIFIER) & F.element_at(parts, 3).rlike(SAFE_IDENTIFIER)
            & parts[0].rlike(r"^[a-z][a-z0-9\-]{4,28}[a-z0-9]$") & F.col("name").rlike(SAFE_IDENTIFIER))
    empty = F.array().cast("array<string>")
    spec = F.array(
        F.struct(F.lit("row_count").alias("check"), F.array(F.lit("rows")).alias("items")),
        F.struct(F.lit("null_distribution").alias("check"), F.coalesce("flat", empty).alias("items")),
        F.struct(F.lit("aggregate").alias("check"), F.flatten(F.transform(
            F.coalesce("exact", empty), lambda c: F.array(F.concat(c, F.lit(".sum")), F.concat(c, F.lit(".min")), F.concat(c, F.lit(".max"))))).alias("items")))
    d = d.select("source_id", F.when(safe, "").otherwise("unsafe_identifier").alias("skipped"), F.explode(spec).alias("c"))
    return d.where(F.size("c.items") > 0).select(
        "source_id", F.concat_ws(":", "source_id", "c.check").alias("query_id"), F.col("c.check").alias("check"), "c.items", "skipped")


def pack_id(checks: DataFrame, digits: int = 16) -> DataFrame:
    """Identity of a pack: sha256 over per-check digests combined order-free, one pass."""
    line = F.concat_ws("|", "query_id", F.array_join("items", ","))
    return checks.agg(F.count(F.lit(1)).alias("_n"), F.sum(md5_slice(line).cast("decimal(28,0)")).alias("_d")).select(
        F.substring(F.sha2(F.concat_ws("|", F.col("_n").cast("string"), F.col("_d").cast("string")), 256), 1, digits).alias("pack_id"))


def ingest_results(checks: DataFrame, results: DataFrame, expected_pack: str, actual_pack: str) -> tuple[DataFrame, DataFrame]:
    """Attach collected results to a pack. ``results``: pack_id, query_id, item, source, target.

    A tampered pack, or results of another pack, reject everything. Unknown query ids
    become error rows; a one-sided result leaves its check not_run.
    """
    asked = checks.where("skipped = ''").select("source_id", "query_id", "check", F.explode("items").alias("item"))
    known = checks.where("skipped = ''").select("query_id").distinct()
    if expected_pack != actual_pack:
        errors = results.select(F.lit("pack was changed after it was built").alias("error"), "query_id").distinct()
        results = results.limit(0)
    else:
        foreign = results.where(F.col("pack_id") != expected_pack).select(F.lit("results belong to another pack").alias("error"), "query_id")
        unknown = results.join(known, "query_id", "left_anti").select(F.lit("unknown query id").alias("error"), "query_id")
        errors = foreign.unionByName(unknown).distinct()
        # All or nothing: a single foreign row rejects the batch.
        any_foreign = foreign.agg(F.count(F.lit(1))).scalar()
        results = results.where(any_foreign == 0)
    j = asked.join(results.select("query_id", "item", "source", "target"), ["query_id", "item"], "left")
    status = (F.when(F.col("source").isNull() | F.col("target").isNull(), "not_run")
              .when(F.col("source") == F.col("target"), "passed").otherwise("failed"))
    per = j.withColumn("status", status).groupBy("source_id", "check").agg(
        F.when(F.bool_or(F.col("status") == "not_run"), "not_run").when(F.bool_or(F.col("status") == "failed"), "failed")
        .otherwise("passed").alias("status"))
    return per, errors


DRIFT_FIELDS = ["kind", "discovered_from", "columns", "sql", "dependencies", "partition_field", "clustering_fields", "size_bytes", "labels"]


def estate_drift(before: DataFrame, after: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Added, removed and changed components with the names of the changed fields.

    ``properties`` maps are compared key by key inside the row, so nothing is exploded.
    """
    fields = fields or [f for f in DRIFT_FIELDS if f in before.columns]
    b = before.select("source_id", F.struct(*fields, "properties").alias("_b"))
    a = after.select("source_id", F.struct(*fields, "properties").alias("_a"))
    j = b.join(a, "source_id", "full")
    plain = F.array_compact(F.array(*[F.when(~F.col(f"_b.{f}").eqNullSafe(F.col(f"_a.{f}")), F.lit(f)) for f in fields]))
    keys = F.array_sort(F.array_union(F.map_keys("_b.properties"), F.map_keys("_a.properties")))
    props = F.filter(keys, lambda k: ~F.try_element_at(F.col("_b.properties"), k).eqNullSafe(F.try_element_at(F.col("_a.properties"), k)))
    changed = F.concat(plain, F.transform(props, lambda k: F.concat(F.lit("properties."), k)))
    op = (F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.size(changed) > 0, "changed"))
    return j.withColumn("op", op).where("op is not null").select(
        "source_id", "op", F.when(F.col("op") == "changed", F.array_join(changed, ",")).otherwise("").alias("fields"))
