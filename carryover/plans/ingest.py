"""Ingestion queries. Every payload is JSON that Spark derives from a table, one resource
per row, so the parsing work grows with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.plans.registry import query
from carryover.session import spread
from carryover.sources import ingest as I


def _json(df, fields, *extra):
    """``payload`` text from SQL field expressions, plus pass-through columns."""
    body = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return df.selectExpr(*extra, f"to_json(named_struct({body})) as payload")


def text(c):
    return F.array_join(c, ",")


@query("estate_load", """
    select 'proj-' || (p_partkey // 10) as project_id, 't' || p_partkey as source_id, case when p_partkey % 2 = 0 then 'dataset' else 'component' end as origin,
        case when p_partkey % 2 = 0 then 'table' else 'stream' end as kind, case when p_size % 3 = 0 then 'inventory' else 'assisted' end as discovered_from,
        coalesce(p_size::bigint, -1) as size_bytes, case when p_partkey >= 2 then 1 else 0 end::bigint as n_deps from part""")
def estate_load(t):
    """Ten parts make one catalog document, half of them in a dataset, half as components."""
    o = """named_struct('source_id', 't' || p_partkey, 'name', p_name, 'kind', if(p_partkey % 2 = 0, 'table', 'stream'), 'discovered_from', if(p_size % 3 = 0, null, 'assisted'),
        'size_bytes', cast(p_size as bigint), 'dependencies', if(p_partkey >= 2, array('t' || (p_partkey div 2)), array()), 'properties', map('brand', p_brand))"""
    d = t.part.selectExpr("p_partkey div 10 as g", f"{o} as o", "p_partkey % 2 = 0 as in_dataset")
    docs = d.groupBy("g").agg(F.collect_list(F.when(F.col("in_dataset"), F.col("o"))).alias("a"), F.collect_list(F.when(~F.col("in_dataset"), F.col("o"))).alias("b"))
    docs = docs.selectExpr("to_json(named_struct('project_id', 'proj-' || g, 'datasets', array(named_struct('source_id', 'd', 'name', 'd', 'objects', a)), 'components', b)) as payload")
    d = I.load_estate(docs)
    return d.select("project_id", "source_id", "origin", "kind", "discovered_from", "size_bytes", F.size(F.coalesce("dependencies", F.array())).cast("long").alias("n_deps"))


@query("columns_flatten", """
    select 't' || p_partkey as source_id, unnest(['id', 'detail', 'detail.size', 'detail.tags', 'detail.tags.name']) as path,
        unnest(['INT64', 'STRUCT', 'INT64', 'STRUCT', 'STRING']) as data_type, unnest(['REQUIRED', 'NULLABLE', 'NULLABLE', 'REPEATED', 'NULLABLE']) as mode,
        unnest([false, true, true, true, true]) as nullable from part""")
def columns_flatten(t):
    cols = """'[{"name":"id","type":"INTEGER","mode":"REQUIRED"},{"name":"detail","type":"record","fields":[{"name":"size","type":"INTEGER"},
        {"name":"tags","type":"RECORD","mode":"repeated","fields":[{"name":"name","data_type":"string"}]}]}]'"""
    d = t.part.selectExpr("'t' || p_partkey as source_id", f"{cols} as c")
    return d.select("source_id", F.explode(I.walk_columns(F.col("c"))).alias("x")).select("source_id", "x.path", "x.data_type", "x.mode", "x.nullable")


@query("bq_tables_ingest", """
    select 'p.d.' || p_name || p_partkey as source_id, case p_partkey % 4 when 0 then 'table' when 1 then 'view' when 2 then 'external_table' else 'table' end as kind,
        case when p_size % 3 = 0 then '_PARTITIONTIME' when p_size % 3 = 1 then 'ts' else '' end as partition_field, case when p_size % 2 = 0 then 'id,ts' else '' end as clustering,
        p_size::bigint * 1000 as size_bytes, 'id:INT64:false' as first_column, case when p_partkey % 4 = 1 then 'SELECT 1' else '' end as sql, '[redacted]' as token_label from part""")
def bq_tables_ingest(t):
    d = _json(t.part, {
        "tableReference": "named_struct('datasetId', 'd', 'tableId', p_name || p_partkey)", "type": "element_at(array('TABLE', 'VIEW', 'EXTERNAL', 'SNAPSHOT'), cast(1 + p_partkey % 4 as int))",
        "numBytes": "cast(p_size * 1000 as string)", "timePartitioning": "case p_size % 3 when 0 then named_struct('type', 'DAY', 'field', cast(null as string)) when 1 then named_struct('type', 'DAY', 'field', 'ts') end",
        "clustering": "if(p_size % 2 = 0, named_struct('fields', array('id', 'ts')), null)",
        "schema": "named_struct('fields', array(named_struct('name', 'id', 'type', 'INTEGER', 'mode', 'REQUIRED')))", "view": "if(p_partkey % 4 = 1, named_struct('query', 'SELECT 1'), null)",
        "labels": "map('api_token', p_brand, 'team', p_type)"})
    r = I.tables(d, "p")
    c = F.col("columns")[0]
    return r.select("source_id", "kind", F.coalesce("partition_field", F.lit("")).alias("partition_field"), text("clustering_fields").alias("clustering"), "size_bytes",
                    F.concat_ws(":", c["path"], c["data_type"], c["nullable"].cast("string")).alias("first_column"), F.coalesce("sql", F.lit("")).alias("sql"),
                    F.col("labels")["api_token"].alias("token_label"))


@query("bq_jobs_ingest", """
    select 'p.jobs.j' || o_orderkey as source_id, case o_orderstatus when 'F' then 'query' when 'O' then 'load' else 'unknown' end as job_type,
        case when o_orderpriority = '5-LOW' then 'UNKNOWN' else 'DONE' end as state, case when o_orderstatus = 'F' then 'WRITE_APPEND' else '' end as disposition from orders""")
def bq_jobs_ingest(t):
    d = _json(t.orders, {
        "jobReference": "named_struct('jobId', 'j' || o_orderkey)", "status": "if(o_orderpriority = '5-LOW', null, named_struct('state', 'DONE'))",
        "configuration": """named_struct('query', if(o_orderstatus = 'F', named_struct('query', 'SELECT 1', 'writeDisposition', 'WRITE_APPEND'), null),
            'load', if(o_orderstatus in ('F', 'O'), named_struct('x', 1), null))"""})
    return I.jobs(d, "p").select("source_id", "job_type", "state", F.coalesce("write_disposition", F.lit("")).alias("disposition"))


@query("bq_routines_ingest", """
    select 'p.d.r' || p_partkey as source_id, case when p_size % 2 = 0 then 'procedure' else 'routine' end as kind, case when p_size % 3 = 0 then 'SQL' else 'JAVASCRIPT' end as language from part""")
def bq_routines_ingest(t):
    d = _json(t.part, {"routineReference": "named_struct('datasetId', 'd', 'routineId', 'r' || p_partkey)", "routineType": "if(p_size % 2 = 0, 'procedure', 'SCALAR_FUNCTION')",
                       "language": "if(p_size % 3 = 0, null, 'javascript')", "definitionBody": "'RETURN 1'"})
    return I.routines(d, "p").select("source_id", "kind", "language")


@query("bq_models_ingest", """
    select 'p.d.m' || p_partkey as source_id, 'bqml_model' as kind, case when p_size % 2 = 0 then 'KMEANS' else 'UNKNOWN' end as model_type from part""")
def bq_models_ingest(t):
    return I.models(_json(t.part, {"modelReference": "named_struct('datasetId', 'd', 'modelId', 'm' || p_partkey)", "modelType": "if(p_size % 2 = 0, 'KMEANS', null)"}), "p")


@query("bq_schedules_ingest", """
    select 'p.scheduled_queries.' || case when c_acctbal > 0 then c_name else c_custkey::varchar end as source_id, 'principal:' || substr(sha256(lower(c_name || '@x.com')), 1, 12) as owner,
        'SELECT ' || c_custkey as sql, '[redacted]' as secret from customer""")
def bq_schedules_ingest(t):
    d = _json(t.customer, {"name": "'projects/p/configs/' || c_custkey", "displayName": "if(c_acctbal > 0, c_name, '')", "schedule": "'every day'",
                           "ownerInfo": "named_struct('email', c_name || '@x.com')", "params": "map('query', 'SELECT ' || c_custkey, 'password', 'x')"})
    return I.schedules(d, "p").select("source_id", "owner", "sql", F.col("params")["password"].alias("secret"))


@query("bq_connections_ingest", """
    select 'p.connections.c' || p_partkey as source_id, ['CLOUD_SQL', 'CLOUD_SPANNER', 'AWS', 'AZURE', 'SPARK', 'UNKNOWN'][1 + p_partkey % 6] as connection_type,
        case when p_size % 2 = 0 then 'eu' else 'unknown' end as location, case when p_partkey % 6 = 0 then 'MYSQL' else '' end as engine,
        case p_partkey % 6 when 0 then 'service_account' when 2 then 'iam_role' when 3 then 'entra_application' else '' end as identity_model, p_size % 3 = 0 as auth_configured from part""")
def bq_connections_ingest(t):
    d = _json(t.part, {
        "name": "if(p_size % 2 = 0, 'projects/p/locations/eu/connections/c', 'c/c') || p_partkey", "hasCredential": "if(p_size % 3 = 0, true, null)",
        "cloudSql": "if(p_partkey % 6 = 0, named_struct('type', 'mysql', 'serviceAccountId', 's'), null)", "cloudSpanner": "if(p_partkey % 6 = 1, named_struct('database', 'b'), null)",
        "aws": "if(p_partkey % 6 = 2, named_struct('accessRole', named_struct('iamRoleId', 'r')), null)", "azure": "if(p_partkey % 6 = 3, named_struct('clientId', 'x'), null)",
        "spark": "if(p_partkey % 6 = 4, named_struct('metastoreServiceConfig', 'm'), null)"})
    return I.connections(d, "p").select("source_id", "connection_type", "location", F.coalesce("database_engine", F.lit("")).alias("engine"),
                                        F.coalesce("identity_model", F.lit("")).alias("identity_model"), "auth_configured")


@query("bq_acl_ingest", """
    select 'p.d' || c_custkey || '.access.' || lpad(i::varchar, 4, '0') as source_id, case i when 0 then 'role' when 1 then 'userByEmail' when 2 then 'domain' else 'unknown' end as policy_type,
        case when i in (0, 1) then 'principal:' || substr(sha256(lower(c_name)), 1, 12) else '' end as person from customer, range(4) r(i)""")
def bq_acl_ingest(t):
    d = _json(t.customer, {"datasetReference": "named_struct('datasetId', 'd' || c_custkey)",
                           "access": "array(map('role', 'READER', 'userByEmail', c_name), map('userByEmail', c_name), map('domain', 'x.com'), map('view', 'v'))"})
    return I.access_entries(d, "p").select("source_id", "policy_type", F.coalesce(F.try_element_at("properties", F.lit("userByEmail")), F.lit("")).alias("person"))


@query("export_ingest", """
    select 'p.' || s || '.n' || p_partkey as source_id, k as kind, c as n_properties, v as probe from part, lateral (select
        ['pubsub', 'workflows', 'gcs', 'dataplex', 'vertex', 'cloudsql', 'spanner', 'looker'][1 + p_partkey % 8] as s,
        ['pubsub_topic', 'workflow', 'gcs_source', 'dataplex_asset', 'vertex_ai_pipeline', 'cloud_sql_database', 'spanner_database', 'looker_asset'][1 + p_partkey % 8] as k,
        [2, 2, 2, 2, 1, 3, 1, 1][1 + p_partkey % 8]::bigint as c,
        ['7d', 'eu', 'STANDARD', 'l/z', '["a","b"]', 'POSTGRES', 'GOOGLE_SQL', '["e1","e2"]'][1 + p_partkey % 8] as v) x""")
def export_ingest(t):
    s = "element_at(array('pubsub', 'workflows', 'gcs', 'dataplex', 'vertex', 'cloudsql', 'spanner', 'looker'), cast(1 + p_partkey % 8 as int))"
    on = lambda i, x: f"if(p_partkey % 8 = {i}, {x}, null)"
    d = _json(t.part, {
        "name": "case p_partkey % 8 when 1 then 'projects/p/locations/eu/workflows/n' when 3 then 'lakes/l/zones/z/assets/n' when 4 then 'jobs/x' else 'topics/n' end || p_partkey",
        "displayName": on(4, "'n' || p_partkey"), "messageRetentionDuration": on(0, "'7d'"), "sourceContents": on(1, "'main:'"), "location": on(2, "'US'"), "storageClass": on(2, "'STANDARD'"),
        "resourceSpec": on(3, "named_struct('type', 'BUCKET')"), "pipelineSpec": on(4, "named_struct('root', named_struct('dag', named_struct('tasks', map('b', 1, 'a', 2))))"),
        "databaseVersion": on(5, "'POSTGRES_14'"), "databaseDialect": on(6, "'GOOGLE_SQL'"), "explores": on(7, "array(named_struct('name', 'e2'), named_struct('name', 'e1'))")}, f"{s} as service")
    p = F.col("properties")
    probe = F.coalesce(*[F.try_element_at(p, F.lit(k)) for k in ("message_retention", "storage_class", "zone", "pipeline_steps", "engine", "dialect", "explores", "location")])
    return I.exports(d, "p").select("source_id", "kind", F.size(p).cast("long").alias("n_properties"), probe.alias("probe"))


@query("external_components_ingest", """
    select case when p_size % 2 = 0 then 'given.' || p_partkey else 'p.workflow.n' || p_partkey end as source_id, 'workflow' as kind, 'a,b' as dependencies, '[redacted]' as secret
    from part where p_partkey % 3 <> 0""")
def external_components_ingest(t):
    d = _json(t.part, {"kind": "if(p_partkey % 3 = 0, 'mystery', 'workflow')", "name": "'n' || p_partkey", "source_id": "if(p_size % 2 = 0, 'given.' || p_partkey, null)",
                       "dependencies": "array('b', 'a')", "properties": "map('api_key', 'x')"})
    return I.external_components(d, "p").select("source_id", "kind", text("dependencies").alias("dependencies"), F.col("properties")["api_key"].alias("secret"))


@query("dataflow_jobs_ingest", """
    select 'p.dataflow.r' || (l_suppkey % 3) || '.' || l_orderkey as source_id, max_by(l_partkey, l_partkey * 1000000 + l_extendedprice)::varchar as name,
        max_by(l_returnflag = 'R', l_partkey * 1000000 + l_extendedprice) as streaming from lineitem group by 1""")
def dataflow_jobs_ingest(t):
    d = _json(spread(t.lineitem, "l_orderkey"), {"id": "cast(l_orderkey as string)", "name": "cast(l_partkey as string)", "type": "if(l_returnflag = 'R', 'JOB_TYPE_STREAMING', 'JOB_TYPE_BATCH')"},
              "concat('r', l_suppkey % 3) as region", "l_partkey * 1000000 + l_extendedprice as position")
    return I.dataflow_jobs(d, "p").select("source_id", "name", "streaming")


def _clusters(t):
    return _json(t.supplier, {
        "clusterName": "s_name", "status": "if(s_nationkey % 2 = 0, named_struct('state', 'RUNNING'), named_struct('state', cast(null as string)))",
        "config": """named_struct('masterConfig', named_struct('machineTypeUri', 'n1'), 'workerConfig', named_struct('machineTypeUri', 'n2', 'numInstances', s_nationkey),
            'stagingBucket', 'b', 'softwareConfig', if(s_acctbal > 0, named_struct('imageVersion', '2.' || s_nationkey), null))"""}, "'eu' as region")


@query("clusters_ingest", """
    select 'p.dataproc.eu.' || s_name as source_id, 'n1' as master, s_nationkey::bigint as workers, case when s_nationkey % 2 = 0 then 'RUNNING' else 'UNKNOWN' end as state,
        case when s_acctbal > 0 then '2.' || s_nationkey else 'unknown' end as image_version from supplier""")
def clusters_ingest(t):
    return I.clusters(_clusters(t), "p").select("source_id", F.col("master_machine_type").alias("master"), F.col("worker_count").alias("workers"),
                                                F.coalesce("state", F.lit("UNKNOWN")).alias("state"), "image_version")


@query("dataproc_jobs_ingest", """
    select 'p.dataproc.job.eu.' || case when l_discount = 0.1 then 'train' else 'etl' end || l_orderkey || '-' || l_linenumber || '-' || l_partkey as source_id,
        case l_returnflag when 'R' then 'pyspark' when 'A' then 'hive' else 'unknown' end as job_type, case l_returnflag when 'R' then 'python' when 'A' then 'sql' else 'unknown' end as language,
        case when l_linestatus = 'O' and l_tax = 0 then 'streaming' when l_returnflag = 'R' then case when l_discount = 0.1 then 'ml_training' else 'data_engineering' end else 'unknown' end as workload_type,
        coalesce(case when s_acctbal > 0 then '2.' || s_nationkey else 'unknown' end, 'unknown') as runtime_version from lineitem left join supplier on l_suppkey = s_suppkey""")
def dataproc_jobs_ingest(t):
    d = _json(spread(t.lineitem, "l_orderkey", "l_linenumber").join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left"), {
        "reference": "named_struct('jobId', concat(if(l_discount = 0.1, 'train', 'etl'), l_orderkey, '-', l_linenumber, '-', l_partkey))",
        "placement": "named_struct('clusterName', s_name)", "labels": "if(l_linestatus = 'O' and l_tax = 0, map('workflow', 'streaming'), null)",
        "pysparkJob": "if(l_returnflag = 'R', named_struct('x', 1), null)", "hiveJob": "if(l_returnflag = 'A', named_struct('x', 1), null)"}, "'eu' as region")
    return I.dataproc_jobs(d, I.clusters(_clusters(t), "p"), "p").select("source_id", "job_type", "language", "workload_type", "runtime_version")


@query("airflow_envs_ingest", """
    select 'p.composer.env.eu.' || n_name as source_id, 'RUNNING' as state, n_nationkey % 2 = 0 as has_overrides, case when n_regionkey = 1 then 'v1' else 'unknown' end as runtime_version from nation""")
def airflow_envs_ingest(t):
    d = _json(t.nation, {"displayName": "n_name", "state": "'RUNNING'", "config": "named_struct('dagGcsPrefix', 'gs://b', 'airflowConfigOverrides', if(n_nationkey % 2 = 0, map('a', 'secret'), null))",
                         "labels": "if(n_regionkey = 1, map('version', 'v1'), null)"}, "'eu' as location")
    return I.airflow_environments(d, "p").select("source_id", "state", "has_overrides", "runtime_version")


def _dags(t):
    """Each order is a DAG; its lines are the tasks (a hot order keeps distinct task rows)."""
    task = """named_struct('task_type', case l_returnflag when 'R' then 'BigQueryInsertJobOperator' when 'A' then 'FileSensor' else 'BashOperator' end,
        'sql', if(l_returnflag = 'R', concat('SELECT * FROM `p.d.t', l_linenumber, '`'), null), 'gcp_conn_id', if(l_linestatus = 'F', 'gcp', null),
        'pool', if(l_returnflag = 'A', 'slow', ''), 'destination_dataset_table', if(l_returnflag = 'R' and l_linestatus = 'O', concat('d.out', l_linenumber), null))"""
    tasks = t.lineitem.selectExpr("l_orderkey", f"{task} as task").distinct().groupBy("l_orderkey").agg(F.collect_list("task").alias("tasks"))
    return _json(tasks, {"dagId": "concat('flow', l_orderkey)", "serializedDag": "named_struct('_task_cycle', tasks)"}, "'eu' as location")


_DAG_SQL = "(select l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem)"


@query("airflow_tasks_ingest", f"""
    select 'p.composer.dag.eu.flow' || l_orderkey as source_id, concat_ws(',', case when bool_or(l_returnflag = 'N') then 'BashOperator' end, case when bool_or(l_returnflag = 'R') then 'BigQueryInsertJobOperator' end,
        case when bool_or(l_returnflag = 'A') then 'FileSensor' end) as operators, case when bool_or(l_linestatus = 'F') then 'gcp' else '' end as connections,
        case when bool_or(l_returnflag = 'A') then 'FileSensor' else '' end as sensors, case when bool_or(l_returnflag = 'A') then 'slow' else '' end as pools,
        case when bool_or(l_returnflag = 'R') then 'analytics' when bool_or(l_returnflag = 'A') then 'event_driven' else 'general_orchestration' end as dag_type from {_DAG_SQL} group by l_orderkey""")
def airflow_tasks_ingest(t):
    d = I.airflow_dags(_dags(t), "p")
    return d.select("source_id", text("operators").alias("operators"), text("connections").alias("connections"), text("sensors").alias("sensors"), text("pools").alias("pools"), "dag_type")


@query("dag_table_refs", f"""
    select distinct 'flow' || l_orderkey as dag_id, 'p.d.t' || l_linenumber as ref from {_DAG_SQL} where l_returnflag = 'R'
    union select distinct 'flow' || l_orderkey, 'd.out' || l_linenumber from {_DAG_SQL} where l_returnflag = 'R' and l_linestatus = 'O'""")
def dag_table_refs(t):
    return I.airflow_dags(_dags(t), "p").select("dag_id", F.explode("tables").alias("ref"))


def _compilations(t):
    """Each order is a compilation: its distinct line numbers are targets in a chain."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ls"))
    node = lambda x: f"named_struct('schema', 's', 'name', concat('n', {x}))"
    ok = f"""to_json(named_struct('dataSourceA', named_struct(
        'targets', concat(transform(ls, x -> named_struct('schema', 's', 'name', concat('n', x), 'relationType', 'TABLE', 'isView', x = 2, 'incremental', x = 3)),
            array(named_struct('schema', 's', 'name', 'check', 'relationType', 'ASSERTION', 'isView', false, 'incremental', false))),
        'edges', concat(transform(filter(ls, x -> x > 1), x -> named_struct('sourceTarget', {node('1')}, 'targetTarget', {node('x')}, 'edgeType', 'DEPENDENCY')),
            array(named_struct('sourceTarget', {node('1')}, 'targetTarget', named_struct('schema', 's', 'name', 'check'), 'edgeType', 'ASSERTION'))))))"""
    return lines.selectExpr("concat('c', l_orderkey) as compilation", f"if(l_orderkey % 10 = 0, 'unavailable', {ok}) as payload")


_COMP = "(select distinct l_orderkey, l_linenumber from lineitem)"


@query("dataform_graph_ingest", f"""
    select 'c' || l_orderkey as compilation, 'p.dataform.target.s.n' || l_linenumber as source_id, case when l_linenumber = 2 then 'view' else 'table' end as kind,
        case when l_linenumber > 1 then 's.n1' else '' end as dependencies, l_linenumber = 1 as has_assertions, l_linenumber = 3 as incremental, false as incomplete from {_COMP} where l_orderkey % 10 <> 0
    union all select distinct 'c' || l_orderkey, 'p.dataform.assertion.s.check', 'dataform_workflow', 's.n1', false, false, false from {_COMP} where l_orderkey % 10 <> 0
    union all select distinct 'c' || l_orderkey, 'p.dataform.compilation.c' || l_orderkey, 'dataform_workflow', '', false, false, true from {_COMP} where l_orderkey % 10 = 0""")
def dataform_graph_ingest(t):
    d = I.dataform_objects(_compilations(t), "p")
    return d.select("compilation", "source_id", "kind", text("dependencies").alias("dependencies"), "has_assertions", "incremental", "incomplete")


@query("dataform_evidence", f"""
    select 'c' || l_orderkey as compilation, case when l_orderkey % 10 = 0 then 0 else count(*) end::bigint as models, l_orderkey % 10 <> 0 as assertions,
        l_orderkey % 10 <> 0 and bool_or(l_linenumber = 3) as incremental, l_orderkey % 10 = 0 as incomplete from {_COMP} group by l_orderkey""")
def dataform_evidence(t):
    return I.dataform_evidence(I.dataform_objects(_compilations(t), "p"))


@query("dbt_manifest_ingest", f"""
    select 'proj' || l_orderkey as project, 'model' as type, 'm' || l_linenumber as name, case when l_linenumber = 2 then 'incremental' else 'view' end as materialized,
        case when l_linenumber > 1 and (l_orderkey, 1) in (select (l_orderkey, l_linenumber) from {_COMP}) then 'm1' else '' end as refs, case when l_linenumber = 1 then 'raw.orders' else '' end as sources,
        'surrogate_key' as macros, '' as "column" from {_COMP}
    union all select 'proj' || l_orderkey, 'test', 'not_null', '', 'm' || l_linenumber, '', '', 'id' from {_COMP}""")
def dbt_manifest_ingest(t):
    """Each order is a project: its distinct line numbers are models with one test each. The text is
    what to_json writes of the nested maps; put together from its parts it takes a sixth of the time."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("ls"))
    model = """concat('"model.m', x, '":{"resource_type":"model","name":"m', x, '","config":{', if(x = 2, '"materialized":"incremental"', ''),
        '},"depends_on":{"nodes":["', if(x = 1, 'source.raw.orders', 'model.m1'), '"],"macros":["dbt.ref","utils.surrogate_key"]},"test_metadata":{"kwargs":{}}}')"""
    test = """concat('"test.t', x, '":{"resource_type":"test","name":"x","config":{},"depends_on":{"nodes":["model.m', x,
        '"],"macros":["m.test"]},"test_metadata":{"name":"not_null","kwargs":{"column_name":"id"}}}')"""
    nodes = f"array_join(concat(transform(ls, x -> {model}), transform(ls, x -> {test})), ',')"
    d = lines.selectExpr("concat('proj', l_orderkey) as project",
                         f"""concat('{{"sources":{{"source.raw.orders":{{"source_name":"raw","name":"orders"}}}},"nodes":{{', {nodes}, '}}}}') as payload""")
    r = I.dbt_nodes(d)
    return r.select("project", "type", "name", F.coalesce("materialized", F.lit("")).alias("materialized"), text("refs").alias("refs"), text("sources").alias("sources"),
                    text("macros").alias("macros"), "column")
