"""Rule evaluation over catalog rows.

A rule is a column expression over one row; a rule table is a map literal or an ordered
``when`` chain. Nothing is shuffled until rows of one component have to meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.operators.lookups import map_literal
from carryover.operators.typemap import LEVELS, level_name, level_rank
from carryover.sources.estate import MODEL_FIELDS, REQUIRED_EVIDENCE

READINESS = [100, 80, 50, 0]
GIB = 1024 ** 3
LARGE_TABLE = 10 * GIB

# ------------------------------------------------------------------ component mapping

# kinds, target, supporting targets, compatibility, action codes (fixed values)
PLAIN_RULES = [
    (["stream", "pubsub_topic"], "eventhouse", ["eventstream", "lakehouse"], "transform", ["define_event_source"]),
    (["scheduled_query"], "data_pipeline", ["notebook"], "transform", ["translate_schedule"]),
    (["bigquery_job"], "data_pipeline", ["notebook", "warehouse"], "transform", ["preserve_job_settings"]),
    (["external_table", "gcs_source"], "lakehouse", ["onelake_shortcut", "data_pipeline"], "transform", ["validate_source_format"]),
    (["workflow"], "data_pipeline", ["notebook"], "transform", ["translate_branching"]),
    (["dbt_project"], "dbt_job", ["warehouse", "data_pipeline"], "transform", ["switch_adapter", "review_macros"]),
    (["looker_asset"], "semantic_model", ["power_bi_report"], "redesign", ["map_measures"]),
    (["bqml_model"], "data_science", ["lakehouse", "notebook"], "redesign", ["capture_model"]),
    (["vertex_ai_pipeline"], "data_science", ["lakehouse", "notebook", "data_pipeline"], "redesign", ["map_features"]),
    (["dataplex_asset"], "purview", ["lakehouse"], "transform", ["map_glossary"]),
    (["cloud_sql_database"], "sql_database", ["lakehouse", "data_pipeline"], "transform", ["assess_transactions"]),
    (["spanner_database"], "sql_database", ["lakehouse", "data_pipeline"], "redesign", ["assess_transactions"]),
    (["security_policy"], "manual", ["purview", "semantic_model"], "unsupported", ["recreate_policies"]),
    (["materialized_view"], "warehouse", ["data_pipeline"], "redesign", ["define_refresh"]),
]

# backend, target, supporting target, compatibility (fixed values)
CONNECTION_RULES = [
    ("CLOUD_SQL", "data_pipeline", "sql_database", "transform"),
    ("CLOUD_SPANNER", "manual", "data_pipeline", "redesign"),
    ("AWS", "onelake_shortcut", "data_pipeline", "transform"),
    ("AZURE", "data_pipeline", "onelake_shortcut", "transform"),
    ("CLOUD_RESOURCE", "onelake_shortcut", "data_pipeline", "transform"),
    ("SPARK", "lakehouse", "notebook", "transform"),
]
CONNECTOR_TYPES = [
    ("CLOUD_SQL/POSTGRES", "PostgreSQL"), ("CLOUD_SQL/MYSQL", "MySQL"), ("AWS", "Amazon S3"), ("AZURE", "Azure resource"),
    ("CLOUD_RESOURCE", "Google Cloud Storage"), ("SPARK", "Lakehouse"), ("CLOUD_SPANNER", "manual"),
]
CLOUD_SQL_ENGINES = ["POSTGRES", "MYSQL"]


def prop(name: str) -> Column:
    return F.try_element_at("properties", F.lit(name))


def truthy(c: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(c)).isin("", "false", "0", "null", "[]", "{}"), F.lit(False))


def is_true(c: Column) -> Column:
    return F.coalesce(c == "true", F.lit(False))


def _strings(items: list) -> Column:
    return F.array(*[F.lit(i) if isinstance(i, str) else i for i in items]) if items else F.array().cast("array<string>")


def _decision(target, compat, supporting, actions) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    sup = supporting if isinstance(supporting, Column) else _strings(supporting)
    act = actions if isinstance(actions, Column) else _strings(actions)
    return F.struct(lit(target).alias("target"), lit(compat).alias("compatibility"), sup.alias("supporting"), F.array_compact(act).alias("actions"))


def connection_target() -> tuple[Column, Column, Column]:
    """Target, compatibility and supporting target by backend and engine; unknown stays manual."""
    kind = F.upper(F.coalesce(prop("connection_type"), F.lit("")))
    engine = F.upper(F.coalesce(prop("database_engine"), F.lit("")))
    key = F.when((kind != "CLOUD_SQL") | engine.isin(CLOUD_SQL_ENGINES), kind)
    pick = lambda i, default: F.coalesce(F.try_element_at(map_literal([(r[0], r[i]) for r in CONNECTION_RULES]), key), F.lit(default))
    return pick(1, "manual"), pick(3, "redesign"), pick(2, "")


def map_connections(connections: DataFrame) -> DataFrame:
    """Connection candidates without secret values: any credential in the properties blocks."""
    from carryover.operators.secrets import credential_counts
    tg, compat, _ = connection_target()
    kind, engine = F.upper(F.coalesce(prop("connection_type"), F.lit("UNKNOWN"))), F.upper(F.coalesce(prop("database_engine"), F.lit("")))
    types = map_literal(CONNECTOR_TYPES)
    kind_name = F.coalesce(F.try_element_at(types, F.concat_ws("/", kind, engine)), F.try_element_at(types, kind), F.lower(kind))
    hits = credential_counts(F.to_json("properties"))
    d = connections.select("source_id", F.concat(F.lit("connection-"), F.substring(F.sha2("source_id", 256), 1, 12)).alias("reference_name"),
                           kind_name.alias("target_type"), tg.alias("target"), compat.alias("compatibility"), (F.size(hits) > 0).alias("_leak"))
    return d.select("source_id", "reference_name", "target_type", "target", "compatibility",
                    F.when(F.col("_leak") | (F.col("compatibility") == "redesign"), "manual_review").otherwise("ready_for_review").alias("status"),
                    F.when(F.col("_leak"), "blocked").otherwise("clear").alias("redaction_status"))


def map_component(objects: DataFrame, preferences: dict | None = None) -> DataFrame:
    """Target, compatibility, supporting targets and action codes per component; the first
    rule that fits decides. Needs kind, properties, nested, partition_field and
    clustering_fields."""
    p = preferences or {}
    lake, book = p.get("data_target") == "lakehouse", p.get("compute_target") == "notebook"
    sql_home = "lakehouse" if lake else "warehouse"
    kind = F.col("kind")
    out = None

    def rule(cond, decision):
        nonlocal out
        out = F.when(cond, decision) if out is None else out.when(cond, decision)

    for kinds, target, sup, compat, actions in PLAIN_RULES:
        rule(kind.isin(kinds), _decision(target, compat, sup, actions))
    opt = lambda name, action: F.when(truthy(prop(name)), action)
    rule(kind.isin("spark_job", "dataproc_job"), _decision("lakehouse", "transform", ["notebook"], [
        "replace_paths", opt("language", "port_code"), opt("runtime_version", "validate_libraries"), opt("uses_gcs", "replace_storage"),
        opt("uses_bigquery_connector", "validate_connector"), opt("streaming", "preserve_checkpoints")]))
    flow = kind == "dataflow_job"
    portable = truthy(prop("portable")) & truthy(prop("connector_compatible"))
    rule(flow & ~truthy(prop("streaming")) & portable, _decision("dataflow_gen2", "transform", ["data_pipeline", "lakehouse"], ["validate_transforms"]))
    rule(flow & truthy(prop("streaming")), _decision("eventhouse", "redesign", ["eventstream"], ["recreate_windowing"]))
    rule(flow, _decision("lakehouse", "redesign", ["notebook", "data_pipeline"], ["recreate_windowing"]))
    dag = kind == "composer_dag"
    rule(dag & (truthy(prop("unsupported_operators")) | truthy(prop("custom_plugins"))),
         _decision("data_pipeline", "redesign", ["notebook", "lakehouse"], ["replace_operators"]))
    rule(dag, _decision("airflow_job" if p.get("preserve_airflow", True) else "data_pipeline", "transform", ["lakehouse", "notebook"], ["inventory_operators"]))
    if p.get("transformation_framework") == "dbt":
        rule(kind == "dataform_workflow", _decision("dbt_job", "transform", ["warehouse", "data_pipeline"], ["translate_assertions", "keep_fallback"]))
    rule(kind == "dataform_workflow", _decision(sql_home, "transform", ["notebook", "data_pipeline"], [
        "preserve_graph", opt("assertions", "translate_assertions"), opt("incremental", "validate_incremental")]))
    tg, compat, backup = connection_target()
    rule(kind == "connection", _decision(tg, compat, F.filter(F.array(backup), lambda x: x != ""), [
        F.when(tg != "manual", "create_connection").otherwise("record_backend"), F.when(tg != "manual", "reissue_identity"), F.lit("never_copy_secrets")]))
    routine, js = kind.isin("routine", "procedure"), F.upper(F.coalesce(prop("language"), F.lit("SQL"))) == "JAVASCRIPT"
    rule(routine & js, _decision("lakehouse", "redesign", ["notebook"], ["review_side_effects"]))
    rule(routine, _decision("warehouse", "transform", [], ["review_side_effects"]))
    rule(kind.isin("view", "sql_script"), _decision(sql_home, "transform", ["notebook", "data_pipeline"] if book else [], []))
    nested = F.coalesce(F.col("nested"), F.lit(False))
    to_lake = nested | F.lit(lake)
    layout = F.when(F.col("partition_field").isNotNull() | F.col("clustering_fields").isNotNull(), "reassess_layout")
    decision = out.otherwise(_decision(
        F.when(to_lake, "lakehouse").otherwise("warehouse"), F.when(nested, "transform").otherwise("direct"),
        F.when(to_lake & F.lit(book), F.array(F.lit("notebook"))).otherwise(_strings([])), [layout]))
    return objects.withColumn("_d", decision).select(*objects.columns, "_d.target", "_d.compatibility", "_d.supporting", "_d.actions")


# ------------------------------------------------------------------ evidence

ALLOW_EMPTY = ["connections", "models"]


def has_evidence(value: Column, field: Column) -> Column:
    """False is evidence; blank, unknown and empty collections are not, except that two
    fields may be an empty list."""
    word = F.lower(F.trim(value))
    empty = word.isin("[]", "{}") & ~field.isin(ALLOW_EMPTY)
    return value.isNotNull() & ~word.isin("", "unknown", "not specified") & ~empty


def with_evidence(objects: DataFrame) -> DataFrame:
    """Adds required, missing and coverage: the kind's field list is a map literal and the
    values come from the row's own property map, so no join is needed."""
    required = F.coalesce(F.try_element_at(F.create_map(*[x for k, fs in REQUIRED_EVIDENCE.items() for x in (F.lit(k), _strings(fs))]), F.col("kind")), _strings([]))
    own = {"columns": F.when(F.col("n_columns") > 0, "yes"), "sql": F.col("sql"), "size_bytes": F.col("size_bytes").cast("string"),
           "partition_field": F.col("partition_field"), "clustering_fields": F.col("clustering_fields")}
    values = F.map_concat(F.map_filter("properties", lambda k, _: ~k.isin(MODEL_FIELDS)),
                          F.create_map(*[x for f, c in own.items() for x in (F.lit(f), c)]))
    d = objects.withColumns({"required": required, "_v": values})
    d = d.withColumn("missing", F.filter("required", lambda f: ~F.coalesce(has_evidence(F.try_element_at(F.col("_v"), f), f), F.lit(False))))
    n = F.size("required")
    cover = F.when(n == 0, 100).otherwise(F.bround(100.0 * (n - F.size("missing")) / n, 0)).cast("long")
    return d.withColumn("coverage", cover).drop("_v")


# ------------------------------------------------------------------ findings

# code, severity, category (fixed values)
FINDING_CODES = [
    ("MAPPING_REDESIGN", "WARN", "mapping"),
    ("MAPPING_UNSUPPORTED", "FAIL", "mapping"),
    ("ACTION_REQUIRED", "WARN", "mapping"),
    ("DBT_JOB_PREVIEW", "WARN", "mapping"),
    ("STREAMING_DOWNSTREAM_REVIEW", "WARN", "processing"),
    ("PERFORMANCE_PARTITION_REVIEW", "WARN", "performance"),
    ("PERFORMANCE_CLUSTERING_REVIEW", "WARN", "performance"),
    ("PARITY_FAILED", "FAIL", "parity"),
    ("PARITY_NOT_RUN", "WARN", "parity"),
    ("SECURITY_EFFECTIVE_ACCESS_REVIEW", "FAIL", "security"),
    ("DATAFORM_COMPILATION_DETAILS_UNAVAILABLE", "FAIL", "adapter"),
    ("EXTERNAL_PAYLOAD_INCOMPLETE_ADAPTER", "FAIL", "adapter"),
    ("ASSISTED_EVIDENCE_UNVERIFIED", "WARN", "provenance"),
    ("ASSISTED_EVIDENCE_INCOMPLETE", "FAIL", "provenance"),
    ("SECURITY_EVIDENCE_MISSING", "FAIL", "security"),
    ("EVIDENCE_MISSING", "WARN", "evidence"),
    ("TYPE_REDESIGN", "WARN", "schema"),
    ("TYPE_UNSUPPORTED", "FAIL", "schema"),
    ("SQL_REDESIGN", "WARN", "sql"),
]


def layout_codes() -> Column:
    big = F.col("kind").isin("table", "external_table", "materialized_view") & F.coalesce(F.col("size_bytes") >= LARGE_TABLE, F.lit(False))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    return F.array_compact(F.array(F.when(big & blank("partition_field"), "PERFORMANCE_PARTITION_REVIEW"),
                                   F.when(big & blank("clustering_fields"), "PERFORMANCE_CLUSTERING_REVIEW")))


def row_findings(d: DataFrame) -> DataFrame:
    """Findings that one assessed row decides by itself, as (source_id, code, detail).

    ``d`` carries the mapping, the evidence columns, parity_status, sql_level and the
    ``streaming_downstream`` flag. One array per row is exploded; the rules never multiply
    the catalog.
    """
    one = lambda cond, code, detail="": F.when(cond, F.struct(F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))
    gaps = F.size("missing") > 0
    gap_text = F.array_join("missing", ", ")
    policy = F.col("kind") == "security_policy"
    singles = F.array_compact(F.array(
        one(F.col("compatibility") == "redesign", "MAPPING_REDESIGN"), one(F.col("compatibility") == "unsupported", "MAPPING_UNSUPPORTED"),
        one(F.col("target") == "dbt_job", "DBT_JOB_PREVIEW"), one(F.col("streaming_downstream"), "STREAMING_DOWNSTREAM_REVIEW"),
        one(F.col("parity_status") == "failed", "PARITY_FAILED"), one(F.col("parity_status") == "not_run", "PARITY_NOT_RUN"),
        one(policy & F.coalesce(prop("evidence_scope") == "dataset_access_entry", F.lit(False)), "SECURITY_EFFECTIVE_ACCESS_REVIEW"),
        one(is_true(prop("discovery_incomplete")), "DATAFORM_COMPILATION_DETAILS_UNAVAILABLE"),
        one((F.col("discovered_from") == "external_payload") & gaps, "EXTERNAL_PAYLOAD_INCOMPLETE_ADAPTER", gap_text),
        one(F.col("discovered_from") == "assisted", "ASSISTED_EVIDENCE_UNVERIFIED"),
        one((F.col("discovered_from") == "assisted") & gaps, "ASSISTED_EVIDENCE_INCOMPLETE", gap_text),
        one(F.coalesce(F.col("sql_level") == "redesign", F.lit(False)), "SQL_REDESIGN")))
    per = lambda arr, code: F.transform(arr, lambda x: F.struct(code.alias("code"), x.alias("detail")))
    layout = F.transform(layout_codes(), lambda c: F.struct(c.alias("code"), F.lit("").alias("detail")))
    everything = F.concat(singles, per(F.col("actions"), F.lit("ACTION_REQUIRED")), layout,
                          per(F.col("missing"), F.when(policy, "SECURITY_EVIDENCE_MISSING").otherwise("EVIDENCE_MISSING")))
    return d.select("source_id", F.explode(everything).alias("f")).select("source_id", "f.code", "f.detail")


def with_severity(findings: DataFrame) -> DataFrame:
    sev = map_literal([(c, s) for c, s, _ in FINDING_CODES])
    cat = map_literal([(c, k) for c, _, k in FINDING_CODES])
    return findings.withColumns({"severity": sev[F.col("code")], "category": cat[F.col("code")]})


def component_scores(assessed: DataFrame, findings: DataFrame) -> DataFrame:
    """Readiness of the worst level times evidence coverage; zero when a FAIL stands.

    ``rank`` is the worst type level of the component. Failing components are reduced
    map-side before they meet the catalog.
    """
    fails = findings.where("severity = 'FAIL'").select("source_id").distinct().withColumn("blocked", F.lit(True))
    d = assessed.join(fails, "source_id", "left")
    worst = F.greatest(level_rank(F.col("compatibility")), F.coalesce("rank", F.lit(0)),
                       F.coalesce(level_rank(F.col("sql_level")), F.lit(0)))
    base = F.element_at(F.array(*[F.lit(x) for x in READINESS]), (worst + 1).cast("int"))
    score = F.when(F.col("blocked"), 0).otherwise(F.bround(base * F.col("coverage") / 100.0, 0)).cast("long")
    return d.select("source_id", level_name(worst).alias("worst"), "coverage", F.coalesce("blocked", F.lit(False)).alias("blocked"), score.alias("score"))


# ------------------------------------------------------------------ strategy

CANDIDATES = ["warehouse", "lakehouse", "eventhouse"]
WEIGHTS = [("direct", 3), ("transform", 2), ("redesign", 1), ("unsupported", 0)]


def strategy(decisions: DataFrame, data_target: str = "", team_skill: str = "") -> DataFrame:
    """Scores of the candidate targets, the primary one and the architecture.

    One aggregate over the decisions; preferences are added to its single row.
    """
    w = map_literal(WEIGHTS)[F.col("compatibility")]
    one = decisions.agg(
        *[F.coalesce(F.sum(F.when(F.col("target") == c, w)), F.lit(0)).alias(c) for c in CANDIDATES],
        *[F.coalesce(F.bool_or(F.col("target") == c), F.lit(False)).alias(f"_{c}") for c in CANDIDATES],
        F.coalesce(F.bool_or(truthy(prop("requires_multi_table_transactions"))), F.lit(False)).alias("pinned"))
    bonus = {"lakehouse": 3 * (data_target == "lakehouse") + 4 * (team_skill == "spark"),
             "warehouse": 3 * (data_target == "warehouse") + 4 * (team_skill == "sql"), "eventhouse": 0}
    one = one.withColumns({c: (F.col(c) + bonus[c]).cast("long") for c in CANDIDATES})
    top = F.greatest(*CANDIDATES)
    first = F.when(F.col("warehouse") == top, "warehouse").when(F.col("lakehouse") == top, "lakehouse").otherwise("eventhouse")
    primary = F.when(F.col("pinned"), "warehouse").otherwise(first)
    used = sum((F.col(f"_{c}").cast("int") for c in CANDIDATES), F.lit(0))
    return one.select(*CANDIDATES, "pinned", primary.alias("primary"), F.when(used > 1, "hybrid").otherwise(primary).alias("architecture"))


# ------------------------------------------------------------------ review reasons, stages, gates

# stage of every kind (fixed values)
STAGES = [
    ("gcs_source", "ingestion"), ("pubsub_topic", "ingestion"), ("stream", "ingestion"), ("external_table", "ingestion"),
    ("dataflow_job", "ingestion"), ("table", "storage"), ("view", "transformation"), ("materialized_view", "transformation"),
    ("sql_script", "transformation"), ("spark_job", "transformation"), ("dataproc_job", "transformation"),
    ("dataform_workflow", "transformation"), ("dbt_project", "transformation"), ("routine", "transformation"),
    ("procedure", "transformation"), ("scheduled_query", "orchestration"), ("bigquery_job", "orchestration"),
    ("composer_dag", "orchestration"), ("workflow", "orchestration"), ("looker_asset", "consumption"), ("bqml_model", "consumption"),
    ("vertex_ai_pipeline", "consumption"), ("dataplex_asset", "governance"), ("security_policy", "governance"),
    ("connection", "integration"), ("cloud_sql_database", "operational"), ("spanner_database", "operational"),
]

# finding code behind each review reason (fixed values)
REASON_BY_CODE = [
    ("STREAMING_DOWNSTREAM_REVIEW", "streaming_downstream_review"),
    ("EXTERNAL_PAYLOAD_INCOMPLETE_ADAPTER", "incomplete_external_adapter"),
    ("DATAFORM_COMPILATION_DETAILS_UNAVAILABLE", "incomplete_dataform_compilation"),
    ("PARITY_FAILED", "parity_failed"),
    ("SECURITY_EFFECTIVE_ACCESS_REVIEW", "security_review"),
    ("SECURITY_EVIDENCE_MISSING", "security_review"),
    ("EVIDENCE_MISSING", "missing_required_evidence"),
    ("ASSISTED_EVIDENCE_UNVERIFIED", "assisted_evidence"),
    ("ASSISTED_EVIDENCE_INCOMPLETE", "assisted_evidence"),
]
# order of the reasons within an item (fixed values)
REASON_ORDER = [
    "external_dependency", "incompatible_mapping", "streaming_downstream_review", "incomplete_external_adapter",
    "incomplete_dataform_compilation", "depends_on_incomplete_external_adapter", "depends_on_incomplete_dataform_compilation",
    "parity_failed", "security_review", "missing_required_evidence", "assisted_evidence", "sql_incompatibility",
]


def review_reasons(assessed: DataFrame, findings: DataFrame, external: DataFrame, taints: DataFrame, waves: DataFrame) -> DataFrame:
    """``id, wave, target, reasons``. At most one row per reason and component is shuffled;
    a component left on a cycle keeps only that reason."""
    reason = map_literal(REASON_BY_CODE)
    hits = findings.where(F.col("code").isin([c for c, _ in REASON_BY_CODE])).select(F.col("source_id").alias("id"), reason[F.col("code")].alias("reason"))
    hits = hits.unionByName(external.select(F.col("child").alias("id"), F.lit("external_dependency").alias("reason")))
    hits = hits.unionByName(taints.where(F.col("reason").startswith("depends_on")).select("id", "reason"))
    flags = F.array_compact(F.array(F.when(F.col("compatibility").isin("redesign", "unsupported"), "incompatible_mapping"),
                                    F.when(F.col("sql_level").isin("redesign", "unsupported"), "sql_incompatibility")))
    hits = hits.unionByName(assessed.select(F.col("source_id").alias("id"), F.explode(flags).alias("reason")))
    per = hits.groupBy("id").agg(F.collect_set("reason").alias("_r"))  # at most twelve values
    d = waves.join(assessed.select(F.col("source_id").alias("id"), "target"), "id").join(per, "id", "left")
    ordered = F.filter(F.array(*[F.lit(r) for r in REASON_ORDER]), lambda r: F.array_contains(F.coalesce("_r", _strings([])), r))
    return d.select("id", "wave", "target", F.when(F.col("stuck"), _strings(["cycle_or_unresolved_dependency"])).otherwise(ordered).alias("reasons"))


def stage_readiness(items: DataFrame) -> DataFrame:
    """Counts and weighted readiness per processing stage. ``items``: kind, compatibility, manual_review."""
    stage = F.coalesce(F.try_element_at(map_literal(STAGES), F.col("kind")), F.lit("other"))
    g = items.groupBy(stage.alias("stage")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("compatibility") == c).alias(c) for c in LEVELS],
        F.count_if(F.col("manual_review")).alias("manual_review"))
    points = sum((F.col(c) * w for c, w in zip(LEVELS, READINESS)), F.lit(0))
    return g.withColumn("readiness", F.bround(points / F.col("total"), 0).cast("long"))


def readiness_gate(counts: DataFrame) -> DataFrame:
    """One row of counters to status and messages, every broken condition named."""
    rules = [
        ("invalid_manifest", "deployment manifest integrity verification failed"), ("failed_validation", "generated artifact validation did not pass"),
        ("unresolved", "plan contains unresolved dependencies"), ("unsupported", "plan contains unsupported components"),
        ("fail_findings", "assessment reports FAIL findings"), ("parity_failed", "parity checks failed"),
        ("redesign", "plan contains components requiring redesign"), ("manual", "plan contains components awaiting manual review"),
    ]
    have = [r for r in rules if r[0] in counts.columns]
    errors = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(m + ": "), F.col(c))) for c, m in have]))
    return counts.select(F.when(F.size(errors) > 0, "blocked").otherwise("ready_for_review").alias("status"), F.array_join(errors, "; ").alias("errors"))


def workload_route(objects: DataFrame, preferences: dict | None = None) -> DataFrame:
    """Engine for each object with its alternatives. Needs kind, complexity, workload, language."""
    p = preferences or {}
    k = F.col("kind")
    heavy = (F.col("complexity") > 70) | F.col("workload").isin("analytical", "etl")
    js = F.lower(F.coalesce(F.col("language"), F.lit(""))).contains("javascript")
    rules = [
        (k.isin("table", "external_table", "materialized_view"), "tsql", "spark_sql"),
        ((k == "view") & heavy, "spark_sql", "pyspark,tsql"), (k == "view", "tsql", "spark_sql"),
        ((k == "routine") & js, "pyspark", ""), (k == "routine", "spark_sql", "pyspark,tsql"),
        (k == "scheduled_query", "pyspark", "spark_sql,tsql"), (k.isin("spark_job", "dataproc_job"), "pyspark", "spark_sql"),
        (k.isin("stream", "pubsub_topic"), "pyspark", "spark_sql"),
    ]
    engine, alt = F.lit("tsql"), F.lit("")
    for cond, e, a in reversed(rules):
        engine, alt = F.when(cond, e).otherwise(engine), F.when(cond, a).otherwise(alt)
    if p.get("force_warehouse"):
        engine = F.lit("tsql")
    elif p.get("force_lakehouse"):
        engine = F.when(engine == "pyspark", engine).otherwise("spark_sql")
    return objects.withColumns({"engine": engine, "alternatives": alt})


# policy type, control, compatibility (fixed values)
POLICY_CONTROLS = [
    ("row_access_policy", "warehouse_row_level_security", "redesign"),
    ("policy_tag", "column_level_security", "redesign"),
    ("data_masking", "dynamic_data_masking", "redesign"),
    ("authorized_view", "view_grant", "transform"),
    ("dataset_access_entry", "workspace_or_onelake_role", "redesign"),
]


def security_proposals(policies: DataFrame) -> DataFrame:
    """Control per policy and its pseudonymous principals. Needs policy_id, policy_type, grantees."""
    from carryover.operators.access import PSEUDONYM
    control = F.try_element_at(map_literal([(t, c) for t, c, _ in POLICY_CONTROLS]), F.col("policy_type"))
    compat = F.try_element_at(map_literal([(t, c) for t, _, c in POLICY_CONTROLS]), F.col("policy_type"))
    who = F.array_sort(F.array_distinct(F.filter("grantees", lambda g: g.rlike(PSEUDONYM))))
    return policies.select(
        "policy_id", F.coalesce("policy_type", F.lit("not_recorded")).alias("policy_type"), F.coalesce(control, F.lit("manual")).alias("control"),
        F.coalesce(compat, F.lit("unsupported")).alias("compatibility"), F.array_join(who, ",").alias("principals"),
        (F.size("grantees") - F.size(who)).cast("long").alias("unpseudonymized"))


def dag_compatibility(dags: DataFrame) -> DataFrame:
    """Reuse or redesign of an orchestration DAG with its follow-up action codes. Needs arrays
    unsupported_operators, sensors, pools, and custom_plugins, sla."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    bad, plug = some("unsupported_operators"), F.coalesce(F.col("custom_plugins"), F.lit(False))
    actions = F.array_compact(F.array(
        F.lit("validate_providers"), F.when(bad, "replace_operators"), F.when(plug, "port_plugins"), F.when(some("sensors"), "review_sensors"),
        F.when(some("pools"), "map_pools"), F.when(F.col("sla").isNotNull(), "recreate_sla")))
    return dags.select("dag_id", F.when(bad | plug, "redesign_required").otherwise("review_required").alias("status"), F.array_join(actions, ",").alias("actions"))


USABLE_TYPES = ["count", "sum", "average", "min", "max", "count_distinct"]


def measure_usability(fields: DataFrame) -> DataFrame:
    """Which semantic fields can be used, and a code for those that cannot. Needs name,
    agg, data_type, sql, has_filter."""
    numeric = F.col("data_type").isin("number", "int64", "double", "decimal")
    date = F.col("data_type").isin("date", "time", "timestamp")
    simple = F.coalesce(F.col("sql").rlike(r"^\$\{TABLE\}\.[A-Za-z_]\w*$"), F.lit(False)) | (F.col("agg") == "count")
    code = (F.when(~F.col("agg").isin(USABLE_TYPES), "unsupported_measure").when(F.coalesce(F.col("has_filter"), F.lit(False)), "filtered_measure_not_migrated")
            .when(~simple, "unsupported_measure").when(F.col("agg").isin("sum", "average") & ~numeric, "unsupported_measure_data_type")
            .when(F.col("agg").isin("min", "max") & ~(numeric | date), "unsupported_measure_data_type").otherwise("usable"))
    return fields.withColumn("code", code)


PER_PAGE = 6


def dashboard_gate(tiles: DataFrame) -> DataFrame:
    """Code per dashboard tile. Needs dashboard, tile (ordinal), type, n_dimensions,
    n_measures, has_filters, has_pivots, resolved. Only the first six usable tiles of a
    page are kept; the page count uses a rank that Spark trims before the shuffle."""
    from carryover.operators.windows import top_per_key
    own = (F.when(~F.col("resolved"), "unresolved_model_context").when(F.col("has_filters"), "visual_filters_not_migrated")
           .when(F.col("has_pivots"), "unsupported_element_property")
           .when((F.col("type") == "card") & ((F.col("n_measures") != 1) | (F.col("n_dimensions") != 0)), "unsupported_visual")
           .when((F.col("type") != "card") & ((F.col("n_measures") < 1) | (F.col("n_dimensions") != 1)), "unsupported_visual")
           .otherwise("ok"))
    d = tiles.withColumn("own", own)
    fits = top_per_key(d.where("own = 'ok'").select("dashboard", "tile"), ["dashboard"], [F.asc("tile")], PER_PAGE).withColumn("_fits", F.lit(True))
    j = d.join(fits, ["dashboard", "tile"], "left")
    return j.select("dashboard", "tile", F.when((F.col("own") == "ok") & F.col("_fits").isNull(), "layout_capacity_exceeded").otherwise(F.col("own")).alias("code"))


def manifest_consistency(planned: DataFrame, produced: DataFrame) -> DataFrame:
    """Planned entries against produced files. ``planned``: id, path, status;
    ``produced``: path, valid. One row per problem."""
    escaping = planned.where(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:")).select("id", "path", F.lit("escaping_path").alias("problem"))
    # Two ids on one path: min and max tell, so a path shared by many ids is one row per task.
    shared = planned.groupBy("path").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a <> _b").select(
        F.col("_a").alias("id"), "path", F.lit("duplicate_path").alias("problem"))
    j = planned.join(produced, "path", "left")
    missing = j.where("valid is null").select("id", "path", F.lit("missing_file").alias("problem"))
    invalid = j.where("valid = false and status <> 'manual_review'").select("id", "path", F.lit("invalid_file").alias("problem"))
    return escaping.unionByName(shared).unionByName(missing).unionByName(invalid)
