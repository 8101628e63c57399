"""Rule queries over the derived estate: mapping, evidence, findings, scores, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators import graph as G
from carryover.operators import rules as R
from carryover.operators import sqlscan, typemap
from carryover.operators.lookups import map_literal
from carryover.plans.estate_graph import CONSUMERS_SQL, WAVES_SQL, nodes, stream_seeds
from carryover.plans.registry import query
from carryover.session import settle
from carryover.sources.estate import (
    COLUMNS_SQL, EDGES_SQL, REQUIRED_EVIDENCE, TYPE_CASE_SQL, estate_columns, estate_edges, estate_objects,
)

# ------------------------------------------------------------------ the estate, assessed


def type_facts(t):
    """Per component: nested or not, and its worst type level."""
    d = typemap.map_types(estate_columns(t))
    nested = (F.col("mode") == "REPEATED") | F.col("source_type").isin("ARRAY", "STRUCT", "JSON")
    return d.groupBy("source_id").agg(F.bool_or(nested).alias("nested"), F.max(typemap.level_rank(F.col("compatibility"))).alias("rank"))


def mapped(t, preferences=None, objects=None):
    objects = estate_objects(t) if objects is None else objects
    return R.map_component(objects.join(type_facts(t), "source_id", "left"), preferences)


def assessed(t, streaming=True):
    o = settle(estate_objects(t), "objects") if streaming else estate_objects(t)  # read twice
    d = R.with_evidence(mapped(t, objects=o))
    d = sqlscan.verdict(d.withColumn("_lang", R.prop("language")), "sql", "_lang").drop("features", "risks", "notes")
    worst = F.greatest(typemap.level_rank(F.col("verdict")), typemap.level_rank(F.col("compatibility")))
    d = d.withColumn("sql_level", F.when(F.col("sql").isNotNull(), typemap.level_name(worst))).drop("verdict", "_lang")
    if not streaming:
        return d.withColumn("streaming_downstream", F.lit(False))
    down = G.downstream(stream_seeds(o), estate_edges(t)).select(F.col("id").alias("source_id"), F.lit(True).alias("streaming_downstream"))
    return d.join(down, "source_id", "left").na.fill(False, ["streaming_downstream"])


def all_findings(t, d):
    types = typemap.type_findings(typemap.map_types(estate_columns(t))).select(
        "source_id", "code", F.concat_ws(" at ", "source_type", "paths").alias("detail"))
    return R.with_severity(R.row_findings(d).unionByName(types))


# ------------------------------------------------------------------ the same in SQL

_T = "coalesce(lower(trim(m['{p}'])) not in ('', 'false', '0', 'null', '[]', '{{}}'), false)"


def _truthy(p):
    return _T.format(p=p)


_RANK = "case {c} when 'direct' then 0 when 'transform' then 1 when 'redesign' then 2 when 'unsupported' then 3 end"
_SQL_LEVEL = "case (k // 27) % 7 when 0 then 0 when 1 then 2 when 2 then 1 when 3 then 2 when 4 then 1 when 5 then 1 else 2 end"
_MAPPED = EDGES_SQL + COLUMNS_SQL.replace("with estate_columns", ", estate_columns") + f""",
    props as (select source_id, map_from_entries(list((name, value))) as m from estate_properties where value is not null group by 1),
    facts as (select source_id, bool_or(mode = 'REPEATED' or {TYPE_CASE_SQL['norm']} in ('ARRAY', 'STRUCT', 'JSON')) as nested,
        max({_RANK.format(c=TYPE_CASE_SQL['compat'])}) as type_rank from estate_columns group by 1),
    ob as (select o.*, coalesce(m, map {{}}) as m, coalesce(nested, false) as nested, coalesce(type_rank, 0) as type_rank,
        connection_type = 'CLOUD_SQL' and database_engine in ('POSTGRES', 'MYSQL') as sql_ok
        from estate_objects o left join props using (source_id) left join facts using (source_id)),
    mapped as (select *,
        case when kind in ('stream', 'pubsub_topic') then 'eventhouse' when kind in ('scheduled_query', 'bigquery_job', 'workflow') then 'data_pipeline'
          when kind in ('external_table', 'gcs_source', 'spark_job', 'dataproc_job') then 'lakehouse'
          when kind = 'dataflow_job' then case when {_truthy('streaming')} then 'eventhouse' when {_truthy('portable')} and {_truthy('connector_compatible')} then 'dataflow_gen2' else 'lakehouse' end
          when kind = 'composer_dag' then case when {_truthy('unsupported_operators')} or {_truthy('custom_plugins')} then 'data_pipeline' else 'airflow_job' end
          when kind = 'dbt_project' then 'dbt_job' when kind = 'dataform_workflow' then 'warehouse' when kind = 'looker_asset' then 'semantic_model'
          when kind in ('bqml_model', 'vertex_ai_pipeline') then 'data_science' when kind = 'dataplex_asset' then 'purview'
          when kind in ('cloud_sql_database', 'spanner_database') then 'sql_database' when kind = 'security_policy' then 'manual'
          when kind = 'connection' then case when sql_ok or connection_type = 'AZURE' then 'data_pipeline' when connection_type in ('AWS', 'CLOUD_RESOURCE') then 'onelake_shortcut'
            when connection_type = 'SPARK' then 'lakehouse' else 'manual' end
          when kind = 'materialized_view' then 'warehouse' when kind in ('routine', 'procedure') then case when upper(m['language']) = 'JAVASCRIPT' then 'lakehouse' else 'warehouse' end
          when kind in ('view', 'sql_script') then 'warehouse' when nested then 'lakehouse' else 'warehouse' end as target,
        case when kind in ('looker_asset', 'bqml_model', 'vertex_ai_pipeline', 'spanner_database', 'materialized_view') then 'redesign'
          when kind = 'security_policy' then 'unsupported'
          when kind = 'dataflow_job' then case when not {_truthy('streaming')} and {_truthy('portable')} and {_truthy('connector_compatible')} then 'transform' else 'redesign' end
          when kind = 'composer_dag' then case when {_truthy('unsupported_operators')} or {_truthy('custom_plugins')} then 'redesign' else 'transform' end
          when kind = 'connection' then case when sql_ok or connection_type in ('AWS', 'AZURE', 'CLOUD_RESOURCE', 'SPARK') then 'transform' else 'redesign' end
          when kind in ('routine', 'procedure') then case when upper(m['language']) = 'JAVASCRIPT' then 'redesign' else 'transform' end
          when kind = 'table' then case when nested then 'transform' else 'direct' end else 'transform' end as compatibility,
        case when kind in ('spark_job', 'dataproc_job') then 1 + {_truthy('language')}::int + {_truthy('runtime_version')}::int + {_truthy('uses_gcs')}::int
            + {_truthy('uses_bigquery_connector')}::int + {_truthy('streaming')}::int
          when kind = 'dataform_workflow' then 1 + {_truthy('assertions')}::int + {_truthy('incremental')}::int when kind = 'dbt_project' then 2
          when kind = 'connection' then case when sql_ok or connection_type in ('AWS', 'AZURE', 'CLOUD_RESOURCE', 'SPARK') then 3 else 2 end
          when kind in ('view', 'sql_script') then 0 when kind = 'table' then (partition_field is not null or clustering_fields is not null)::int else 1 end as n_actions
        from ob)"""

_REQ = ", ".join(f"('{k}', '{f}')" for k, fs in REQUIRED_EVIDENCE.items() for f in fs)
_EVID = _MAPPED + f""",
    req(rkind, field) as (values {_REQ}),
    vals as (select source_id, field, case field when 'columns' then case when n_columns > 0 then 'yes' end when 'sql' then sql when 'size_bytes' then size_bytes::varchar
        when 'connection_type' then connection_type else m[field] end as value from mapped join req on rkind = kind),
    ev as (select source_id, field, value is not null and lower(trim(value)) not in ('', 'unknown', 'not specified')
        and not (value = '[]' and field not in ('connections', 'models')) as present from vals),
    cov as (select source_id, coalesce(n, 0) as n, coalesce(p, 0) as p, case when n is null then 100 else round_even(100.0 * p / n, 0)::bigint end as coverage
        from mapped left join (select source_id, count(*) as n, count_if(coalesce(present, false)) as p from ev group by 1) using (source_id))"""

_ASSESSED = _EVID + CONSUMERS_SQL + f""",
    ass as (select mp.*, n, p, coverage, n - p as gaps, source_id in (select id from consumers) as streaming_downstream,
        case when sql is not null then greatest({_SQL_LEVEL}, {_RANK.format(c='compatibility')},
            case when coalesce(upper(trim(m['language'])), '') not in ('', 'SQL') then 2 else 0 end) end as sql_rank
        from mapped mp join cov using (source_id)),
    big as (select *, kind in ('table', 'external_table', 'materialized_view') and coalesce(size_bytes >= 10737418240, false) as large from ass),
    tf as (select source_id, {TYPE_CASE_SQL['norm']} as ty, {TYPE_CASE_SQL['compat']} as c from estate_columns group by all),
    fi as (
      select source_id, 'MAPPING_REDESIGN' as code from big where compatibility = 'redesign' union all select source_id, 'MAPPING_UNSUPPORTED' from big where compatibility = 'unsupported'
      union all select source_id, 'ACTION_REQUIRED' from (select source_id, unnest(range(n_actions)) from big)
      union all select source_id, 'DBT_JOB_PREVIEW' from big where target = 'dbt_job' union all select source_id, 'STREAMING_DOWNSTREAM_REVIEW' from big where streaming_downstream
      union all select source_id, 'PERFORMANCE_PARTITION_REVIEW' from big where large and partition_field is null
      union all select source_id, 'PERFORMANCE_CLUSTERING_REVIEW' from big where large and clustering_fields is null
      union all select source_id, 'PARITY_FAILED' from big where parity_status = 'failed' union all select source_id, 'PARITY_NOT_RUN' from big where parity_status = 'not_run'
      union all select source_id, 'SECURITY_EFFECTIVE_ACCESS_REVIEW' from big where kind = 'security_policy' and m['evidence_scope'] = 'dataset_access_entry'
      union all select source_id, 'DATAFORM_COMPILATION_DETAILS_UNAVAILABLE' from big where m['discovery_incomplete'] = 'true'
      union all select source_id, 'EXTERNAL_PAYLOAD_INCOMPLETE_ADAPTER' from big where discovered_from = 'external_payload' and gaps > 0
      union all select source_id, 'ASSISTED_EVIDENCE_UNVERIFIED' from big where discovered_from = 'assisted'
      union all select source_id, 'ASSISTED_EVIDENCE_INCOMPLETE' from big where discovered_from = 'assisted' and gaps > 0
      union all select ev.source_id, case when kind = 'security_policy' then 'SECURITY_EVIDENCE_MISSING' else 'EVIDENCE_MISSING' end from ev join big using (source_id) where not coalesce(present, false)
      union all select source_id, case c when 'redesign' then 'TYPE_REDESIGN' else 'TYPE_UNSUPPORTED' end from tf where c in ('redesign', 'unsupported')
      union all select source_id, 'SQL_REDESIGN' from big where sql_rank = 2),
    fails as (select distinct source_id from fi where code in ('MAPPING_UNSUPPORTED', 'PARITY_FAILED', 'SECURITY_EFFECTIVE_ACCESS_REVIEW',
        'DATAFORM_COMPILATION_DETAILS_UNAVAILABLE', 'EXTERNAL_PAYLOAD_INCOMPLETE_ADAPTER', 'ASSISTED_EVIDENCE_INCOMPLETE', 'SECURITY_EVIDENCE_MISSING', 'TYPE_UNSUPPORTED')),
    score as (select source_id, greatest({_RANK.format(c='compatibility')}, type_rank, coalesce(sql_rank, 0)) as worst, coverage, source_id in (select source_id from fails) as blocked,
        case when source_id in (select source_id from fails) then 0 else round_even([100, 80, 50, 0][1 + greatest({_RANK.format(c='compatibility')}, type_rank, coalesce(sql_rank, 0))] * coverage / 100.0, 0)::bigint end as score from big)"""

_LEVEL = "['direct', 'transform', 'redesign', 'unsupported']"

# ------------------------------------------------------------------ queries


@query("map_component", _MAPPED + " select source_id, kind, target, compatibility, n_actions::bigint as n_actions from mapped")
def map_component(t):
    return mapped(t).select("source_id", "kind", "target", "compatibility", F.size("actions").cast("long").alias("n_actions"))


@query("map_connection", _MAPPED + """
    select source_id, 'connection-' || substr(sha256(source_id), 1, 12) as reference_name,
        case connection_type when 'CLOUD_SQL' then case database_engine when 'POSTGRES' then 'PostgreSQL' when 'MYSQL' then 'MySQL' else 'cloud_sql' end
            when 'AWS' then 'Amazon S3' when 'AZURE' then 'Azure resource' when 'CLOUD_RESOURCE' then 'Google Cloud Storage' when 'SPARK' then 'Lakehouse'
            when 'CLOUD_SPANNER' then 'manual' else lower(connection_type) end as target_type, target, compatibility,
        case when compatibility = 'redesign' or n_cust = 0 then 'manual_review' else 'ready_for_review' end as status,
        case when n_cust = 0 then 'blocked' else 'clear' end as redaction_status
    from (select *, k % 5 as n_cust from mapped where kind = 'connection')""")
def map_connection(t):
    o = estate_objects(t).where("kind = 'connection'")
    leak = F.create_map(F.lit("url"), F.when(F.col("k") % 5 == 0, "postgresql://app:hunter2@db").otherwise("postgresql://db"))
    return R.map_connections(o.withColumn("properties", F.map_concat("properties", leak)))


@query("required_evidence", _EVID + " select source_id, field, coalesce(present, false) as present from ev")
def required_evidence(t):
    d = R.with_evidence(estate_objects(t)).select("source_id", F.explode("required").alias("field"), "missing")
    return d.select("source_id", "field", (~F.array_contains("missing", F.col("field"))).alias("present"))


@query("evidence_coverage", _EVID + """
    select kind, count(*)::bigint as n, sum(coverage)::bigint as points, round_even(avg(coverage), 0)::bigint as coverage from cov join mapped using (source_id) group by 1""")
def evidence_coverage(t):
    d = R.with_evidence(estate_objects(t))
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.sum("coverage").alias("points"), F.bround(F.avg("coverage"), 0).cast("long").alias("coverage"))


@query("findings", _ASSESSED + " select code, count(*)::bigint as n, count(distinct source_id)::bigint as components from fi group by 1")
def findings(t):
    f = all_findings(t, settle(assessed(t), "assessed"))
    return f.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("components"))


@query("layout_findings", EDGES_SQL + """
    select source_id, 'PERFORMANCE_PARTITION_REVIEW' as code from estate_objects where kind in ('table', 'external_table', 'materialized_view') and size_bytes >= 10737418240 and partition_field is null
    union all select source_id, 'PERFORMANCE_CLUSTERING_REVIEW' from estate_objects where kind in ('table', 'external_table', 'materialized_view') and size_bytes >= 10737418240 and clustering_fields is null""")
def layout_findings(t):
    return estate_objects(t).select("source_id", F.explode(R.layout_codes()).alias("code"))


@query("component_score", _ASSESSED + f" select source_id, {_LEVEL}[1 + worst] as worst, coverage, blocked, score from score")
def component_score(t):
    d = settle(assessed(t, streaming=False), "assessed")
    return R.component_scores(d, all_findings(t, d))


@query("strategy", _MAPPED + f""",
    w as (select target, sum(case compatibility when 'direct' then 3 when 'transform' then 2 when 'redesign' then 1 else 0 end) as s from mapped group by 1),
    r as (select coalesce((select s from w where target = 'warehouse'), 0)::bigint + 4 as warehouse, coalesce((select s from w where target = 'lakehouse'), 0)::bigint + 3 as lakehouse,
        coalesce((select s from w where target = 'eventhouse'), 0)::bigint as eventhouse, (select bool_or({_truthy('requires_multi_table_transactions')}) from mapped) as pinned)
    select warehouse, lakehouse, eventhouse, pinned, case when pinned or warehouse >= greatest(lakehouse, eventhouse) then 'warehouse' when lakehouse >= eventhouse then 'lakehouse'
        else 'eventhouse' end as "primary", 'hybrid' as architecture from r""")
def strategy(t):
    return R.strategy(mapped(t), data_target="lakehouse", team_skill="sql")


_REASONS = _ASSESSED + WAVES_SQL.format(edges="estate_edges") + """,
    seeds_a as (select source_id as id from fi where code = 'EXTERNAL_PAYLOAD_INCOMPLETE_ADAPTER'), seeds_d as (select source_id as id from fi where code = 'DATAFORM_COMPILATION_DETAILS_UNAVAILABLE'),
    ta(id) as (select id from seeds_a union select e.child from ta join inner_edges e on e.parent = ta.id),
    td(id) as (select id from seeds_d union select e.child from td join inner_edges e on e.parent = td.id),
    hits as (
      select child as id, 'external_dependency' as r from estate_edges where parent not in (select source_id from estate_objects)
      union select source_id, 'incompatible_mapping' from big where compatibility in ('redesign', 'unsupported')
      union select source_id, 'sql_incompatibility' from big where sql_rank >= 2
      union select source_id, case code when 'STREAMING_DOWNSTREAM_REVIEW' then 'streaming_downstream_review' when 'EXTERNAL_PAYLOAD_INCOMPLETE_ADAPTER' then 'incomplete_external_adapter'
        when 'DATAFORM_COMPILATION_DETAILS_UNAVAILABLE' then 'incomplete_dataform_compilation' when 'PARITY_FAILED' then 'parity_failed'
        when 'SECURITY_EFFECTIVE_ACCESS_REVIEW' then 'security_review' when 'SECURITY_EVIDENCE_MISSING' then 'security_review' when 'EVIDENCE_MISSING' then 'missing_required_evidence'
        when 'ASSISTED_EVIDENCE_UNVERIFIED' then 'assisted_evidence' when 'ASSISTED_EVIDENCE_INCOMPLETE' then 'assisted_evidence' end from fi
      union select id, 'depends_on_incomplete_external_adapter' from ta where id not in (select id from seeds_a)
      union select id, 'depends_on_incomplete_dataform_compilation' from td where id not in (select id from seeds_d)),
    item as (select source_id as id, kind, compatibility, wave, target, (select count(*) from hits where hits.id = source_id and r is not null) as n_reasons from big join waves on waves.id = source_id)"""


# finding code, reason of the component itself, reason of what depends on it
TAINTS = [
    ("EXTERNAL_PAYLOAD_INCOMPLETE_ADAPTER", "incomplete_external_adapter", "depends_on_incomplete_external_adapter"),
    ("DATAFORM_COMPILATION_DETAILS_UNAVAILABLE", "incomplete_dataform_compilation", "depends_on_incomplete_dataform_compilation"),
]


def plan_items(t, d, findings_, w):
    e = estate_edges(t)
    pick = lambda i: map_literal([(x[0], x[i]) for x in TAINTS])[F.col("code")]
    seeds = findings_.where(F.col("code").isin([x[0] for x in TAINTS])).select(
        F.col("source_id").alias("id"), pick(1).alias("direct"), pick(2).alias("derived"))
    return R.review_reasons(d, findings_, G.external_deps(nodes(t), e), G.taint(seeds, e, w.where("not stuck")), w)


def assessment(t):
    """Assessed components, findings and waves, each settled once and then reused."""
    d = settle(assessed(t), "assessed")
    return d, settle(all_findings(t, d), "findings"), G.waves(nodes(t), estate_edges(t))


def full_plan(t):
    d, f, w = assessment(t)
    return d, f, w, settle(plan_items(t, d, f, w), "items")


@query("review_reasons", _REASONS + " select r as reason, count(*)::bigint as n from hits where r is not null group by 1")
def review_reasons(t):
    return full_plan(t)[3].select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_STAGE_CASE = "case kind " + " ".join(f"when '{k}' then '{s}'" for k, s in R.STAGES) + " else 'other' end"


@query("stage_readiness", _MAPPED + f""",
    s as (select {_STAGE_CASE} as stage, count(*)::bigint as total, count_if(compatibility = 'direct')::bigint as direct, count_if(compatibility = 'transform')::bigint as transform,
        count_if(compatibility = 'redesign')::bigint as redesign, count_if(compatibility = 'unsupported')::bigint as unsupported,
        count_if(compatibility in ('redesign', 'unsupported'))::bigint as manual_review from mapped group by 1)
    select *, round_even((100.0 * direct + 80 * transform + 50 * redesign) / total, 0)::bigint as readiness from s""")
def stage_readiness(t):
    return R.stage_readiness(mapped(t).withColumn("manual_review", F.col("compatibility").isin("redesign", "unsupported")))


@query("portfolio_summary", _REASONS + """
    select (select round_even(avg(score), 0)::bigint from score) as score, (select round_even(avg(coverage), 0)::bigint from cov) as evidence_coverage,
        (select count(*)::bigint from big) as components, (select count(*)::bigint from fi) as findings, (select count(*)::bigint from fi where code in (
          'MAPPING_UNSUPPORTED', 'PARITY_FAILED', 'SECURITY_EFFECTIVE_ACCESS_REVIEW', 'DATAFORM_COMPILATION_DETAILS_UNAVAILABLE', 'EXTERNAL_PAYLOAD_INCOMPLETE_ADAPTER',
          'ASSISTED_EVIDENCE_INCOMPLETE', 'SECURITY_EVIDENCE_MISSING', 'TYPE_UNSUPPORTED')) as blockers,
        (select count(*)::bigint from item where n_reasons > 0) as manual_reviews, (select count(*)::bigint from (select distinct child, parent from estate_edges
          where parent not in (select source_id from estate_objects))) as unresolved, 'blocked' as status""")
def portfolio_summary(t):
    d, f, w, items = full_plan(t)
    sc = R.component_scores(d, f)
    one = sc.agg(F.bround(F.avg("score"), 0).cast("long").alias("score"), F.bround(F.avg("coverage"), 0).cast("long").alias("evidence_coverage"), F.count("*").alias("components"))
    one = one.withColumns({
        "findings": f.agg(F.count("*")).scalar(), "blockers": f.agg(F.count_if(F.col("severity") == "FAIL")).scalar(),
        "manual_reviews": items.agg(F.count_if(F.size("reasons") > 0)).scalar(),
        "unresolved": G.external_deps(nodes(t), estate_edges(t)).agg(F.count("*")).scalar()})
    return one.withColumn("status", F.when((F.col("blockers") > 0) | (F.col("unresolved") > 0), "blocked").otherwise("review_required"))


@query("wave_signoff", _REASONS + """,
    own as (select source_id, list(distinct code order by code) as blocker_codes from fi where code in ('SECURITY_EFFECTIVE_ACCESS_REVIEW', 'SECURITY_EVIDENCE_MISSING') group by 1),
    sec as (select wave, list(distinct code order by code) as wave_blocker_codes from (select source_id, unnest(blocker_codes) as code from own) join waves on id = source_id group by 1),
    total as (select wave, count(*)::bigint as items, count_if(parity_status = 'passed')::bigint as parity_passed, count_if(parity_status = 'failed')::bigint as parity_failed,
        count_if(parity_status = 'not_run')::bigint as parity_not_run, count(distinct discovered_from)::bigint as provenances from big join waves on id = source_id group by 1)
    select total.*, case when wave_blocker_codes is not null then 'blocked' else 'not_recorded' end as security_status, coalesce(wave_blocker_codes, []::varchar[]) as wave_blocker_codes,
        []::varchar[] as wave_review_codes, big.source_id, parity_status, discovered_from, coalesce(blocker_codes, []::varchar[]) as blocker_codes, []::varchar[] as review_codes
    from big join waves on id = big.source_id join total using (wave) left join sec using (wave) left join own on own.source_id = big.source_id""")
def wave_signoff(t):
    """A row per component: its wave, parity status, provenance, and the security codes that block
    it or ask for a review; beside them what these come to for its wave, the same in all its rows.
    So a wave may have any number of components."""
    d, f, w = assessment(t)
    codes = lambda fail: F.array_sort(F.collect_set(F.when((F.col("severity") == "FAIL") == F.lit(fail), F.col("code"))))
    own = f.where("category = 'security'").groupBy("source_id").agg(codes(True).alias("blocker_codes"), codes(False).alias("review_codes"))
    none = F.array().cast("array<string>")
    j = settle(d.select("source_id", "parity_status", "discovered_from").join(w.select(F.col("id").alias("source_id"), "wave"), "source_id").join(own, "source_id", "left")
               .withColumns({c: F.coalesce(c, none) for c in ("blocker_codes", "review_codes")}), "members")
    st = F.col("parity_status")
    some = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    g = j.groupBy("wave").agg(F.count("*").alias("items"), F.count_if(st == "passed").alias("parity_passed"), F.count_if(st == "failed").alias("parity_failed"),
                              F.count_if(st == "not_run").alias("parity_not_run"), F.size(F.collect_set("discovered_from")).cast("long").alias("provenances"),
                              some("blocker_codes").alias("wave_blocker_codes"), some("review_codes").alias("wave_review_codes"))
    status = F.when(F.size("wave_blocker_codes") > 0, "blocked").when(F.size("wave_review_codes") > 0, "review_required").otherwise("not_recorded")
    return j.join(g.withColumn("security_status", status), "wave")


@query("orchestration_candidates", _REASONS + """
    select id, wave, target, (select count(*)::bigint from estate_edges where child = id) as dependencies from item
    where target in ('airflow_job', 'data_pipeline') or kind in ('external_table', 'gcs_source', 'dbt_project', 'dataform_workflow', 'vertex_ai_pipeline', 'cloud_sql_database', 'spanner_database', 'materialized_view')
        or (kind = 'dataflow_job' and target in ('lakehouse', 'dataflow_gen2')) or (kind = 'connection' and id in (select source_id from big where connection_type in ('CLOUD_SPANNER', 'AWS', 'CLOUD_RESOURCE')))""")
def orchestration_candidates(t):
    e = estate_edges(t)
    w = G.waves(nodes(t), e)
    d = mapped(t).where(F.col("target").isin("airflow_job", "data_pipeline") | F.array_contains("supporting", "data_pipeline"))
    deps = e.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("dependencies"))
    return d.select(F.col("source_id").alias("id"), "target").join(w.select("id", "wave"), "id").join(deps, "id", "left").na.fill(0, ["dependencies"])


@query("readiness_gate", _EVID + """,
    c as (select count_if(compatibility = 'unsupported') as u, count_if(parity_status = 'failed') as p, count_if(compatibility = 'redesign') as r,
        (select count(*) from estate_edges where parent not in (select source_id from estate_objects)) as x from mapped)
    select 'blocked' as status, concat_ws('; ', case when x > 0 then 'plan contains unresolved dependencies: ' || x end, case when u > 0 then 'plan contains unsupported components: ' || u end,
        case when p > 0 then 'parity checks failed: ' || p end, case when r > 0 then 'plan contains components requiring redesign: ' || r end) as errors from c""")
def readiness_gate(t):
    c = mapped(t).agg(F.count_if(F.col("compatibility") == "unsupported").alias("unsupported"), F.count_if(F.col("parity_status") == "failed").alias("parity_failed"),
                      F.count_if(F.col("compatibility") == "redesign").alias("redesign"))
    unresolved = G.external_deps(nodes(t), estate_edges(t)).agg(F.count("*")).scalar()
    return R.readiness_gate(c.withColumn("unresolved", unresolved))


@query("workload_route", _MAPPED + """
    select source_id, case when kind = 'view' then 'spark_sql' when kind = 'routine' then case when m['language'] = 'JAVASCRIPT' then 'pyspark' else 'spark_sql' end
          when kind in ('scheduled_query', 'spark_job', 'dataproc_job', 'stream', 'pubsub_topic') then 'pyspark' else 'tsql' end as engine,
        case when kind in ('table', 'external_table', 'materialized_view', 'spark_job', 'dataproc_job', 'stream', 'pubsub_topic') then 'spark_sql' when kind = 'view' then 'pyspark,tsql'
          when kind = 'routine' and m['language'] = 'JAVASCRIPT' then '' when kind = 'routine' then 'pyspark,tsql' when kind = 'scheduled_query' then 'spark_sql,tsql' else '' end as alternatives
    from mapped""")
def workload_route(t):
    k = F.col("kind")
    work = F.when(k.isin("view", "materialized_view"), "analytical").when(k == "scheduled_query", "etl").when(k == "stream", "streaming").otherwise("unknown")
    d = estate_objects(t).withColumns({"complexity": sqlscan.complexity(F.coalesce("sql", F.lit(""))), "workload": work, "language": R.prop("language")})
    return R.workload_route(d).select("source_id", "engine", "alternatives")


@query("dag_compat", """
    select p_partkey as dag_id, case when p_size % 4 = 0 or p_brand = 'Brand#3' then 'redesign_required' else 'review_required' end as status,
        concat_ws(',', 'validate_providers', case when p_size % 4 = 0 then 'replace_operators' end, case when p_brand = 'Brand#3' then 'port_plugins' end,
            case when p_size % 3 = 0 then 'review_sensors' end, case when p_size % 5 = 0 then 'map_pools' end, case when p_type = 'PROMO' then 'recreate_sla' end) as actions from part""")
def dag_compat(t):
    some = lambda m, x: F.when(F.col("p_size") % m == 0, F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    return R.dag_compatibility(t.part.select(
        F.col("p_partkey").alias("dag_id"), some(4, "ShellOperator").alias("unsupported_operators"), some(3, "FileSensor").alias("sensors"), some(5, "pool").alias("pools"),
        (F.col("p_brand") == "Brand#3").alias("custom_plugins"), F.when(F.col("p_type") == "PROMO", "1h").alias("sla")))


@query("security_proposals", """
    select c_custkey as policy_id, coalesce(pt, 'not_recorded') as policy_type, case pt when 'row_access_policy' then 'warehouse_row_level_security' when 'policy_tag' then 'column_level_security'
        when 'authorized_view' then 'view_grant' else 'manual' end as control, case when pt in ('row_access_policy', 'policy_tag') then 'redesign' when pt = 'authorized_view' then 'transform'
        else 'unsupported' end as compatibility, 'principal:' || substr(sha256(lower(c_name)), 1, 12) as principals, 2::bigint as unpseudonymized
    from (select *, case c_mktsegment when 'BUILDING' then 'row_access_policy' when 'MACHINERY' then 'policy_tag' when 'HOUSEHOLD' then 'authorized_view' when 'FURNITURE' then 'other' end as pt from customer)""")
def security_proposals(t):
    from carryover.functions.canonical import pseudonym
    s = F.col("c_mktsegment")
    pt = (F.when(s == "BUILDING", "row_access_policy").when(s == "MACHINERY", "policy_tag").when(s == "HOUSEHOLD", "authorized_view").when(s == "FURNITURE", "other"))
    p = pseudonym(F.col("c_name"))
    return R.security_proposals(t.customer.select(F.col("c_custkey").alias("policy_id"), pt.alias("policy_type"), F.array(p, p, F.col("c_name")).alias("grantees")))


@query("unsupported_measures", """
    select name, agg, case when agg = 'list' then 'unsupported_measure' when has_filter then 'filtered_measure_not_migrated' when not simple and agg <> 'count' then 'unsupported_measure'
        when agg in ('sum', 'average') and dt <> 'number' then 'unsupported_measure_data_type' when agg in ('min', 'max') and dt = 'string' then 'unsupported_measure_data_type' else 'usable' end as code
    from (select 'm' || p_partkey as name, ['count', 'sum', 'average', 'min', 'max', 'count_distinct', 'list'][1 + p_partkey % 7] as agg, ['number', 'date', 'string'][1 + p_size % 3] as dt,
        p_brand = 'Brand#4' as has_filter, p_type <> 'PROMO' as simple from part)""")
def unsupported_measures(t):
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    d = t.part.select(
        F.concat(F.lit("m"), "p_partkey").alias("name"), pick(["count", "sum", "average", "min", "max", "count_distinct", "list"], F.col("p_partkey") % 7).alias("agg"),
        pick(["number", "date", "string"], F.col("p_size") % 3).alias("data_type"), (F.col("p_brand") == "Brand#4").alias("has_filter"),
        F.when(F.col("p_type") != "PROMO", "${TABLE}.price").otherwise("${TABLE}.price * 2").alias("sql"))
    return R.measure_usability(d).select("name", "agg", "code")


@query("dashboard_gate", """
    with t as (select p_brand as dashboard, p_partkey as tile, case when p_size % 2 = 0 then 'card' else 'column' end as type, p_size % 2 as nd, 1 + (p_size % 9 = 0)::int as nm,
        p_size % 7 = 0 as f, p_size % 11 = 0 as p, p_type <> 'PROMO' as r from part),
    o as (select *, case when not r then 'unresolved_model_context' when f then 'visual_filters_not_migrated' when p then 'unsupported_element_property'
        when type = 'card' and (nm <> 1 or nd <> 0) then 'unsupported_visual' when type <> 'card' and (nm < 1 or nd <> 1) then 'unsupported_visual' else 'ok' end as own from t),
    k as (select *, count_if(own = 'ok') over (partition by dashboard order by tile) as c from o)
    select dashboard, tile, case when own = 'ok' and c > 6 then 'layout_capacity_exceeded' else own end as code from k""")
def dashboard_gate(t):
    s = F.col("p_size")
    return R.dashboard_gate(t.part.select(
        F.col("p_brand").alias("dashboard"), F.col("p_partkey").alias("tile"), F.when(s % 2 == 0, "card").otherwise("column").alias("type"), (s % 2).alias("n_dimensions"),
        (F.lit(1) + (s % 9 == 0).cast("int")).alias("n_measures"), (s % 7 == 0).alias("has_filters"), (s % 11 == 0).alias("has_pivots"), (F.col("p_type") != "PROMO").alias("resolved")))


@query("manifest_consistency", """
    with pl as (select p_partkey as id, case when p_size % 10 = 0 then '../out/' || p_partkey when p_size % 9 = 0 then 'shared/' || p_brand else 'files/' || p_partkey end as path,
        case when p_type = 'PROMO' then 'manual_review' else 'planned' end as status, p_size from part),
    pr as (select path, bool_and(p_size % 4 <> 1) as valid from pl where p_size % 8 <> 3 or path like 'shared/%' group by 1)
    select id, path, 'escaping_path' as problem from pl where path like '../%'
    union all select min(id), path, 'duplicate_path' from pl group by path having count(distinct id) > 1
    union all select id, path, 'missing_file' from pl where path not in (select path from pr)
    union all select id, pl.path, 'invalid_file' from pl join pr using (path) where not valid and status <> 'manual_review'""")
def manifest_consistency(t):
    s = F.col("p_size")
    path = (F.when(s % 10 == 0, F.concat(F.lit("../out/"), "p_partkey")).when(s % 9 == 0, F.concat(F.lit("shared/"), "p_brand")).otherwise(F.concat(F.lit("files/"), "p_partkey")))
    pl = t.part.select(F.col("p_partkey").alias("id"), path.alias("path"), F.when(F.col("p_type") == "PROMO", "manual_review").otherwise("planned").alias("status"), "p_size")
    pr = pl.where("p_size % 8 <> 3 or path like 'shared/%'").groupBy("path").agg(F.bool_and(s % 4 != 1).alias("valid"))
    return R.manifest_consistency(pl.drop("p_size"), pr)


@query("summary_counts", _MAPPED + """
    select 'kind' as facet, kind as value, count(*)::bigint as n from mapped group by 2 union all select 'target', target, count(*) from mapped group by 2
    union all select 'compatibility', compatibility, count(*) from mapped group by 2 union all select 'provenance', discovered_from, count(*) from mapped group by 2""")
def summary_counts(t):
    d = mapped(t).groupBy("kind", "target", "compatibility", "discovered_from").agg(F.count("*").alias("n"))
    facets = [("kind", "kind"), ("target", "target"), ("compatibility", "compatibility"), ("provenance", "discovered_from")]
    long = d.select("n", F.explode(F.array(*[F.struct(F.lit(a).alias("facet"), F.col(b).alias("value")) for a, b in facets])).alias("f"))
    return long.groupBy("f.facet", "f.value").agg(F.sum("n").alias("n"))


@query("summary_cube", _MAPPED + """
    select coalesce(kind, '*') as kind, coalesce(target, '*') as target, coalesce(compatibility, '*') as compatibility, grouping_id(kind, target, compatibility)::bigint as level, count(*)::bigint as n
    from mapped group by grouping sets ((kind), (target), (compatibility), (kind, compatibility), ())""")
def summary_cube(t):
    # Count the combinations first: the grouping sets then expand a few hundred rows, not the catalog.
    base = mapped(t).groupBy("kind", "target", "compatibility").agg(F.count("*").alias("n"))
    return t.spark.sql("""
        select coalesce(kind, '*') as kind, coalesce(target, '*') as target, coalesce(compatibility, '*') as compatibility,
            cast(grouping_id(kind, target, compatibility) as bigint) as level, sum(n) as n
        from {d} group by grouping sets ((kind), (target), (compatibility), (kind, compatibility), ())""", d=base)


@query("ref_resolve", """
    with el as (select l_orderkey as element, l_linenumber as pos, case when l_returnflag = 'R' and l_discount = 0.1 then l_partkey + 100000000 else l_partkey end as field from lineitem),
    j as (select element, count_if(p_partkey is null)::bigint as unresolved from el left join part on p_partkey = field group by 1),
    dup as (select element, max(c) as c from (select element, pos, field, count(*) as c from el group by all) group by 1)
    select element, unresolved, case when unresolved > 0 then 'unresolved_reference' when c > 1 then 'duplicate_reference' else 'ok' end as code from j join dup using (element)""")
def ref_resolve(t):
    from carryover.operators.semantic import resolve_references
    field = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.1), F.col("l_partkey") + 100000000).otherwise(F.col("l_partkey"))
    refs = t.lineitem.select(F.col("l_orderkey").alias("element"), F.col("l_linenumber").alias("position"), field.alias("field"))
    return resolve_references(refs, t.part.select(F.col("p_partkey").alias("field")))
