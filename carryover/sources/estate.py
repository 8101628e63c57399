"""The catalog of an estate: objects, columns, edges and properties as DataFrames.

``estate_*`` derive a catalog from the ``part`` table (one component per part), so that
the catalog rules run over as many components as there are parts. The ``*_SQL`` texts
say the same in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.operators.typemap import TYPE_ALIASES, TYPE_RULES
from carryover.session import spread

# component kinds (fixed values)
KINDS = [
    "table", "view", "materialized_view", "external_table", "routine", "procedure", "scheduled_query",
    "bigquery_job", "stream", "sql_script", "spark_job", "dataflow_job", "dataproc_job",
    "dataform_workflow", "composer_dag", "workflow", "pubsub_topic", "gcs_source", "looker_asset",
    "bqml_model", "security_policy", "connection", "dataplex_asset", "vertex_ai_pipeline",
    "cloud_sql_database", "spanner_database", "dbt_project",
]
# where evidence came from (fixed values)
PROVENANCE = [
    "inventory", "bigquery_api", "dataflow_api", "composer_api", "dataproc_api", "dataform_api",
    "external_payload", "assisted",
]
# types used by the derived columns: every rule, two legacy names, one unknown
COLUMN_TYPES = [r[0] for r in TYPE_RULES] + ["RECORD", "numeric(10, 2)", "HLLSKETCH"]

SQL_KINDS = ["view", "materialized_view", "routine", "procedure", "scheduled_query", "bigquery_job", "sql_script"]
SQL_TEXTS = [
    "SELECT a, b FROM proj.ds.orders WHERE a > 1",
    "SELECT * EXCEPT (secret) FROM ds.orders",
    "SELECT SAFE_CAST(a AS INT64) AS a FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY b ORDER BY c) = 1",
    "SELECT NET.HOST(url) FROM ds.pages",
    "SELECT x FROM ds.t, UNNEST(items) AS x WHERE x NOT IN (SELECT y FROM ds.u)",
    "MERGE INTO ds.t USING ds.s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.v",
    "EXECUTE IMMEDIATE 'SELECT 1'",
]
CONNECTION_TYPES = ["CLOUD_SQL", "CLOUD_SPANNER", "AWS", "AZURE", "CLOUD_RESOURCE", "SPARK", "OTHER"]
ENGINES = ["POSTGRES", "MYSQL", "SQLSERVER"]
LANGUAGES = ["SQL", "JAVASCRIPT", "python", "scala"]
FLAGS = [
    "streaming", "portable", "connector_compatible", "assertions", "incremental", "uses_gcs",
    "uses_bigquery_connector", "custom_plugins", "discovery_incomplete", "requires_multi_table_transactions",
]

# kind, required evidence fields (fixed values)
REQUIRED_EVIDENCE = {
    "table": ["columns", "size_bytes"],
    "external_table": ["columns"],
    "view": ["sql"],
    "materialized_view": ["sql", "columns"],
    "routine": ["language", "sql"],
    "procedure": ["language", "sql"],
    "sql_script": ["sql"],
    "spark_job": ["language", "runtime_version", "code"],
    "dataproc_job": ["language", "runtime_version", "code"],
    "dataflow_job": ["streaming", "portable", "connector_compatible"],
    "composer_dag": ["operators", "runtime_version", "connections"],
    "dataform_workflow": ["models", "assertions", "incremental"],
    "looker_asset": ["explores", "measures", "joins"],
    "bqml_model": ["model_type", "features", "evaluation_metrics"],
    "vertex_ai_pipeline": ["pipeline_steps", "models", "endpoints"],
    "security_policy": ["policy_type"],
    "connection": ["connection_type", "location"],
    "cloud_sql_database": ["engine", "version", "replication"],
    "spanner_database": ["dialect", "replication", "change_streams"],
    "workflow": ["source_contents", "triggers"],
    "pubsub_topic": ["message_retention", "subscriptions"],
    "gcs_source": ["location", "storage_class", "data_format"],
    "dataplex_asset": ["resource_type", "zone"],
    "dbt_project": ["adapter", "models"],
}
MODEL_FIELDS = ["columns", "sql", "size_bytes", "partition_field", "clustering_fields"]
PROPERTY_NAMES = sorted(
    ({f for fs in REQUIRED_EVIDENCE.values() for f in fs} | set(FLAGS) | {"evidence_scope", "unsupported_operators"})
    - set(MODEL_FIELDS) - {"connection_type"})


def _pick(items: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))


def _property(k: Column, no: int, name: str) -> Column:
    """Absent, unknown (or an empty list), false, or a real value, by turns."""
    if name in FLAGS:
        real = F.lit("true")
    elif name == "language":
        real = _pick(LANGUAGES, F.floor(k / 27) % 4)
    elif name == "evidence_scope":
        real = F.lit("dataset_access_entry")
    else:
        real = F.concat(F.lit("v"), k.cast("string"))
    turn = (k + no) % 4
    return (F.when(turn == 1, F.when(k % 2 == 1, "[]").otherwise("unknown")).when(turn == 2, "false")
            .when(turn == 3, real))


def estate_objects(t) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = _pick(KINDS, k % 27)
    sql = F.when(kind.isin(SQL_KINDS) & (k % 7 != 0), _pick(SQL_TEXTS, F.floor(k / 27) % len(SQL_TEXTS)))
    size_bytes = F.when(k % 13 != 0, F.floor(F.col("p_retailprice") * 11800000).cast("long"))
    n_columns = (size % 6).cast("long")
    props = [F.lit("connection_type"), _pick(CONNECTION_TYPES, F.floor(k / 27) % 7),
             F.lit("database_engine"), _pick(ENGINES, F.floor(k / 27) % 3)]
    for no, name in enumerate(PROPERTY_NAMES):
        props += [F.lit(name), _property(k, no, name)]
    d = spread(t.part, "p_partkey").select(
        k.alias("k"), F.concat(F.lit("proj-est.d"), k % 20, F.lit(".t"), k).alias("source_id"),
        F.concat(F.lit("t"), k).alias("name"), F.concat(F.lit("d"), k % 20).alias("dataset"), kind.alias("kind"),
        _pick(PROVENANCE, k % 8).alias("discovered_from"), size_bytes.alias("size_bytes"),
        F.when(size % 3 != 0, "ts").alias("partition_field"), F.when(size % 4 != 0, "id").alias("clustering_fields"),
        sql.alias("sql"), n_columns.alias("n_columns"),
        F.map_filter(F.create_map(*props), lambda _, v: v.isNotNull()).alias("properties"))
    bearing = F.col("kind").isin("table", "view", "materialized_view", "external_table")
    status = _pick(["passed", "failed", "not_run"], F.floor(F.col("k") / 27) % 3)
    return d.withColumn("parity_status", F.when(bearing, status).otherwise("not_applicable"))


def estate_columns(t) -> DataFrame:
    k = F.col("p_partkey")
    d = spread(t.part.where("p_size % 6 > 0"), "p_partkey").select(
        F.concat(F.lit("proj-est.d"), k % 20, F.lit(".t"), k).alias("source_id"), k.alias("k"),
        F.explode(F.sequence(F.lit(0), F.expr("p_size % 6 - 1"))).alias("j"))
    n = F.col("k") + F.col("j")
    return d.select("source_id", "k", F.concat(F.lit("c"), "j").alias("path"), _pick(COLUMN_TYPES, n % len(COLUMN_TYPES)).alias("data_type"),
                    F.when(n % 7 == 0, "REPEATED").otherwise("NULLABLE").alias("mode"))


def estate_edges(t, cyclic: bool = False) -> DataFrame:
    """Child and parent keys. Acyclic unless asked otherwise; ``ext.*`` parents are unknown."""
    sid = lambda c: F.concat(F.lit("proj-est.d"), c % 20, F.lit(".t"), c)
    k = F.col("p_partkey")
    half, third = F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long")
    parents = [F.when(k >= 2, sid(half)), F.when((k >= 3) & (k % 5 == 0), sid(third)),
               F.when(k % 97 == 0, F.concat(F.lit("ext."), k))]
    if cyclic:
        parents += [F.when((k % 211 == 0) & (k > 0), sid(k + 1)), F.when((k % 211 == 1) & (k > 1), sid(k - 1))]
    d = t.part.select(sid(k).alias("child"), F.explode(F.array_distinct(F.array_compact(F.array(*parents)))).alias("parent"))
    if cyclic:
        last = t.part.agg(F.max("p_partkey")).scalar()
        return d.where(F.regexp_extract("parent", r"t(\d+)$", 1).try_cast("long").isNull()
                       | (F.regexp_extract("parent", r"t(\d+)$", 1).try_cast("long") <= last))
    return d


# ------------------------------------------------------------------ the same in SQL


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _sid(k: str) -> str:
    return f"'proj-est.d' || ({k}) % 20 || '.t' || ({k})"


OBJECTS_SQL = f"""
    with recursive estate_base as (
        select p_partkey as k, p_size, p_retailprice, {_sid('p_partkey')} as source_id, {_sql_list(KINDS)}[1 + p_partkey % 27] as kind,
            {_sql_list(PROVENANCE)}[1 + p_partkey % 8] as discovered_from from part),
    estate_objects as (
        select k, source_id, 't' || k as name, kind, discovered_from,
            case when k % 13 <> 0 then floor(p_retailprice * 11800000)::bigint end as size_bytes,
            case when p_size % 3 <> 0 then 'ts' end as partition_field, case when p_size % 4 <> 0 then 'id' end as clustering_fields,
            case when kind in {tuple(SQL_KINDS)} and k % 7 <> 0 then {_sql_list(SQL_TEXTS)}[1 + (k // 27) % {len(SQL_TEXTS)}] end as sql,
            p_size % 6 as n_columns, {_sql_list(CONNECTION_TYPES)}[1 + (k // 27) % 7] as connection_type,
            {_sql_list(ENGINES)}[1 + (k // 27) % 3] as database_engine,
            case when kind in ('table', 'view', 'materialized_view', 'external_table')
                then ['passed', 'failed', 'not_run'][1 + (k // 27) % 3] else 'not_applicable' end as parity_status
        from estate_base),
    prop_names(name, no) as (values {", ".join(f"('{n}', {i})" for i, n in enumerate(PROPERTY_NAMES))}),
    estate_properties as (
        select source_id, k, prop_names.name, case (k + no) % 4 when 1 then case when k % 2 = 1 then '[]' else 'unknown' end
            when 2 then 'false' when 3 then case when prop_names.name in {tuple(FLAGS)} then 'true'
                when prop_names.name = 'language' then {_sql_list(LANGUAGES)}[1 + (k // 27) % 4]
                when prop_names.name = 'evidence_scope' then 'dataset_access_entry' else 'v' || k end end as value
        from estate_objects, prop_names)"""

EDGES_SQL = OBJECTS_SQL + f""",
    estate_edges as (select distinct child, parent from (
        select source_id as child, unnest([case when k >= 2 then {_sid('k // 2')} end,
            case when k >= 3 and k % 5 = 0 then {_sid('k // 3')} end, case when k % 97 = 0 then 'ext.' || k end]) as parent
        from estate_objects) where parent is not null)"""

CYCLIC_SQL = EDGES_SQL + f""",
    cyclic_edges as (select child, parent from estate_edges union select source_id, {_sid('k + 1')} from estate_objects
            where k % 211 = 0 and k > 0 and k + 1 in (select k from estate_objects)
        union select source_id, {_sid('k - 1')} from estate_objects where k % 211 = 1 and k > 1)"""

COLUMNS_SQL = f"""
    with estate_columns as (
        select {_sid('p_partkey')} as source_id, p_partkey as k, 'c' || j as path, {_sql_list(COLUMN_TYPES)}[1 + (p_partkey + j) % {len(COLUMN_TYPES)}] as data_type,
            case when (p_partkey + j) % 7 = 0 then 'REPEATED' else 'NULLABLE' end as mode
        from (select p_partkey, unnest(range(p_size % 6)) as j from part))"""

_NORM = "trim(split_part(split_part(upper(trim(data_type)), '<', 1), '(', 1))"
_NORM = f"case {_NORM} " + " ".join(f"when '{a}' then '{b}'" for a, b in TYPE_ALIASES) + f" else {_NORM} end"
TYPE_CASE_SQL = {
    "norm": f"({_NORM})",
    "target": f"(case ({_NORM}) " + " ".join(f"when '{s}' then '{x}'" for s, x, _ in TYPE_RULES) + " else 'none' end)",
    "compat": f"(case ({_NORM}) " + " ".join(f"when '{s}' then '{c}'" for s, _, c in TYPE_RULES) + " else 'unsupported' end)",
}
