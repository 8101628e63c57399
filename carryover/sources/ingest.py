"""Saved API payloads to catalog rows.

Input frames hold one resource per row as JSON text (JSON lines scale; one giant document
does not). Schemas are declared, so nothing is inferred and absent fields stay null.
Arrays that belong to one resource are handled inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions.canonical import pseudonym
from carryover.operators.lookups import map_literal
from carryover.operators.secrets import nesting, opened, redact_map
from carryover.operators.windows import latest_per_key
from carryover.session import settle, settle_counted
from carryover.sources.estate import KINDS

COLUMN = "struct<name:string,data_type:string,type:string,nullable:boolean,mode:string,description:string,fields:string>"
LEGACY = [("INTEGER", "INT64"), ("FLOAT", "FLOAT64"), ("BOOLEAN", "BOOL"), ("RECORD", "STRUCT")]


def parsed(df: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Every other column plus the parsed fields; text that is not JSON is flagged."""
    d = df.withColumn("_j", F.from_json(payload, schema))
    return d.select(*[c for c in df.columns if c != payload], "_j.*", F.try_parse_json(payload).isNull().alias("unreadable"))


def column_levels(fields: Column) -> Column:
    """Levels of nested columns below the top one: a list and an object each."""
    return F.greatest(F.floor(nesting(fields) / 2).cast("int") - 1, F.lit(0))


def walk_columns(fields: Column, levels: int | None = None) -> Column:
    """Nested column list (JSON text) to a flat array of (path, type, nullable, mode).

    Each step opens the children of the last one inside the row, as many levels as the row has
    (or ``levels``); a column that is still closed then is an error, as those in it would be missing.
    """
    item = f"array<{COLUMN}>"

    def rows(text: Column, prefix: Column) -> Column:
        return F.transform(F.coalesce(F.from_json(text, item), F.array().cast(item)), lambda c: F.struct(
            F.concat(prefix, c["name"]).alias("path"),
            F.coalesce(F.upper(F.coalesce(c["data_type"], c["type"])), F.lit("STRING")).alias("data_type"),
            F.coalesce(c["nullable"], F.upper(F.coalesce(c["mode"], F.lit("NULLABLE"))) != "REQUIRED").alias("nullable"),
            F.upper(F.coalesce(c["mode"], F.lit("NULLABLE"))).alias("mode"), c["fields"].alias("inner")))

    out = opened(rows(fields, F.lit("")), column_levels(fields) if levels is None else F.lit(levels), lambda acc: F.flatten(F.transform(acc, lambda c: F.concat(
        F.array(F.struct(c["path"].alias("path"), c["data_type"].alias("data_type"), c["nullable"].alias("nullable"), c["mode"].alias("mode"),
                         F.lit(None).cast("string").alias("inner"))),
        rows(c["inner"], F.concat(c["path"], F.lit(".")))))))
    closed = F.exists(out, lambda c: c["inner"].isNotNull() & (c["inner"] != "[]"))
    out = F.when(closed, F.raise_error(F.lit("columns nest deeper than the levels given")).cast(
        "array<struct<path:string,data_type:string,nullable:boolean,mode:string,inner:string>>")).otherwise(out)
    return F.transform(out, lambda c: F.struct(
        c["path"].alias("path"), F.coalesce(F.try_element_at(map_literal(LEGACY), c["data_type"]), c["data_type"]).alias("data_type"),
        c["nullable"].alias("nullable"), c["mode"].alias("mode")))


OBJECT = ("struct<source_id:string,name:string,kind:string,discovered_from:string,dataset:string,columns:string,sql:string,dependencies:array<string>,"
          "partition_field:string,clustering_fields:array<string>,size_bytes:bigint,labels:map<string,string>,properties:map<string,string>>")


def load_estate(docs: DataFrame) -> DataFrame:
    """Canonical catalog documents to objects: those of datasets first, then components."""
    d = parsed(docs, f"project_id string, datasets array<struct<source_id:string,name:string,objects:array<{OBJECT}>>>, components array<{OBJECT}>")
    inner = d.select("project_id", F.lit(0).alias("_part"), F.explode("datasets").alias("_d")).select("project_id", "_part", F.explode("_d.objects").alias("o"))
    top = d.select("project_id", F.lit(1).alias("_part"), F.explode("components").alias("o"))
    o = inner.unionByName(top).select("project_id", F.when(F.col("_part") == 0, "dataset").otherwise("component").alias("origin"), "o.*")
    return o.withColumn("discovered_from", F.coalesce("discovered_from", F.lit("inventory")))


def estate_tables(objects: DataFrame) -> dict[str, DataFrame]:
    """The columns, edges and properties tables of loaded objects."""
    cols = objects.select("source_id", F.posexplode(walk_columns(F.col("columns"))).alias("ordinal", "c")).select("source_id", "ordinal", "c.*")
    edges = objects.select(F.col("source_id").alias("child"), F.explode("dependencies").alias("parent"))
    props = objects.select("source_id", F.explode("properties").alias("name", "value"))
    return {"columns": cols, "edges": edges, "properties": props}


TABLE_KINDS = [("TABLE", "table"), ("VIEW", "view"), ("MATERIALIZED_VIEW", "materialized_view"), ("EXTERNAL", "external_table"), ("SNAPSHOT", "table")]


def tables(df: DataFrame, project: str) -> DataFrame:
    d = parsed(df, """tableReference struct<datasetId:string,tableId:string>, type string, numBytes string, timePartitioning struct<type:string,field:string>,
        rangePartitioning struct<field:string>, clustering struct<fields:array<string>>, schema struct<fields:string>, view struct<query:string>,
        materializedView struct<query:string>, externalDataConfiguration struct<sourceFormat:string>, labels map<string,string>""")
    ref = F.col("tableReference")
    part = F.coalesce(F.nullif(F.col("timePartitioning.field"), F.lit("")), F.nullif(F.col("rangePartitioning.field"), F.lit("")),
                      F.when(F.col("timePartitioning").isNotNull(), "_PARTITIONTIME"))
    return d.select(
        F.concat_ws(".", F.lit(project), ref["datasetId"], ref["tableId"]).alias("source_id"), ref["tableId"].alias("name"),
        F.coalesce(F.try_element_at(map_literal(TABLE_KINDS), F.upper("type")), F.lit("table")).alias("kind"), ref["datasetId"].alias("dataset"),
        walk_columns(F.col("schema.fields")).alias("columns"), F.coalesce(F.nullif(F.col("view.query"), F.lit("")), F.col("materializedView.query")).alias("sql"),
        part.alias("partition_field"), F.coalesce(F.col("clustering.fields"), F.array().cast("array<string>")).alias("clustering_fields"),
        F.col("numBytes").try_cast("long").alias("size_bytes"), F.col("externalDataConfiguration.sourceFormat").alias("source_format"),
        redact_map(F.coalesce("labels", F.create_map().cast("map<string,string>"))).alias("labels"))


def jobs(df: DataFrame, project: str) -> DataFrame:
    d = parsed(df, """id string, jobReference struct<jobId:string,location:string>, status struct<state:string>, configuration struct<
        query:struct<query:string,priority:string,writeDisposition:string,createDisposition:string>,load:string,copy:string,extract:string>""")
    q, job = F.col("configuration.query"), F.coalesce(F.nullif(F.col("jobReference.jobId"), F.lit("")), F.col("id"))
    kind = F.coalesce(*[F.when(F.col(f"configuration.{k}").isNotNull(), k) for k in ("query", "load", "copy", "extract")], F.lit("unknown"))
    return d.select(F.concat_ws(".", F.lit(project), F.lit("jobs"), job).alias("source_id"), job.alias("name"), kind.alias("job_type"),
                    F.coalesce("status.state", F.lit("UNKNOWN")).alias("state"), q["priority"].alias("priority"), q["writeDisposition"].alias("write_disposition"),
                    q["createDisposition"].alias("create_disposition"), q["query"].alias("sql"))


def routines(df: DataFrame, project: str) -> DataFrame:
    d = parsed(df, "routineReference struct<datasetId:string,routineId:string>, routineType string, language string, definitionBody string")
    return d.select(F.concat_ws(".", F.lit(project), "routineReference.datasetId", "routineReference.routineId").alias("source_id"),
                    F.when(F.upper("routineType") == "PROCEDURE", "procedure").otherwise("routine").alias("kind"),
                    F.upper(F.coalesce("language", F.lit("SQL"))).alias("language"), F.col("definitionBody").alias("sql"))


def models(df: DataFrame, project: str) -> DataFrame:
    d = parsed(df, "modelReference struct<datasetId:string,modelId:string>, modelType string")
    return d.select(F.concat_ws(".", F.lit(project), "modelReference.datasetId", "modelReference.modelId").alias("source_id"),
                    F.lit("bqml_model").alias("kind"), F.coalesce("modelType", F.lit("UNKNOWN")).alias("model_type"))


def schedules(df: DataFrame, project: str) -> DataFrame:
    d = parsed(df, "name string, displayName string, schedule string, state string, dataSourceId string, ownerInfo struct<email:string>, params map<string,string>")
    name = F.coalesce(F.nullif(F.col("displayName"), F.lit("")), F.element_at(F.split("name", "/"), -1))
    return d.select(F.concat_ws(".", F.lit(project), F.lit("scheduled_queries"), name).alias("source_id"), name.alias("name"), "schedule",
                    F.coalesce("state", F.lit("UNKNOWN")).alias("state"), pseudonym(F.col("ownerInfo.email")).alias("owner"),
                    F.try_element_at("params", F.lit("query")).alias("sql"), redact_map(F.col("params")).alias("params"))


BACKENDS = [("cloudSql", "CLOUD_SQL"), ("cloudSpanner", "CLOUD_SPANNER"), ("aws", "AWS"), ("azure", "AZURE"), ("cloudResource", "CLOUD_RESOURCE"), ("spark", "SPARK")]


def connections(df: DataFrame, project: str) -> DataFrame:
    """The first backend block present decides; credentials are only known to exist."""
    d = parsed(df, """name string, friendlyName string, hasCredential boolean, cloudSql struct<type:string,instanceId:string,database:string,serviceAccountId:string>,
        cloudSpanner struct<database:string,databaseRole:string>, aws struct<accessRole:struct<iamRoleId:string>>, azure struct<clientId:string,customerTenantId:string>,
        cloudResource struct<serviceAccountId:string>, spark struct<serviceAccountId:string,metastoreServiceConfig:string>""")
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), v) for k, v in BACKENDS], F.lit("UNKNOWN"))
    leaf = F.element_at(F.split("name", "/"), -1)
    ident = (F.when(kind == "AWS", F.when(F.col("aws.accessRole").isNotNull(), "iam_role")).when(kind == "AZURE", F.when(F.col("azure.clientId").isNotNull(), "entra_application"))
             .when(F.coalesce(*[F.when(kind == v, F.col(f"{k}.serviceAccountId")) for k, v in BACKENDS if k in ("cloudSql", "cloudResource", "spark")]).isNotNull(), "service_account"))
    return d.select(F.concat_ws(".", F.lit(project), F.lit("connections"), leaf).alias("source_id"), kind.alias("connection_type"),
                    F.coalesce(F.nullif(F.regexp_extract("name", "/locations/([^/]+)", 1), F.lit("")), F.lit("unknown")).alias("location"),
                    F.when(kind == "CLOUD_SQL", F.upper(F.coalesce("cloudSql.type", F.lit("UNKNOWN")))).alias("database_engine"),
                    ident.alias("identity_model"), F.coalesce("hasCredential", F.lit(False)).alias("auth_configured"))


ACL_KEYS = ["role", "userByEmail", "groupByEmail", "specialGroup", "domain"]


def access_entries(df: DataFrame, project: str) -> DataFrame:
    d = parsed(df, "datasetReference struct<datasetId:string>, access array<map<string,string>>")
    e = d.select(F.col("datasetReference.datasetId").alias("ds"), F.posexplode("access").alias("i", "a"))
    kind = F.coalesce(*[F.when(F.map_contains_key("a", k), k) for k in ACL_KEYS], F.lit("unknown"))
    at = F.lpad(F.col("i").cast("string"), 4, "0")
    return e.select(F.concat_ws(".", F.lit(project), "ds", F.lit("access"), at).alias("source_id"), kind.alias("policy_type"),
                    F.lit("dataset_access_entry").alias("evidence_scope"), redact_map(F.col("a")).alias("properties"))


EXPORT = """name string, displayName string, kmsKeyName string, messageRetentionDuration string, sourceContents string, state string, location string, storageClass string,
    resourceSpec struct<type:string>, pipelineSpec struct<root:struct<dag:struct<tasks:map<string,string>>>>, databaseVersion string, replicaNames array<string>,
    databaseDialect string, explores array<struct<name:string>>, labels map<string,string>"""
EXPORT_KINDS = [("pubsub", "pubsub_topic"), ("workflows", "workflow"), ("gcs", "gcs_source"), ("dataplex", "dataplex_asset"), ("vertex", "vertex_ai_pipeline"),
                ("cloudsql", "cloud_sql_database"), ("spanner", "spanner_database"), ("looker", "looker_asset")]


def exports(df: DataFrame, project: str) -> DataFrame:
    """Resources of eight services (column ``service``) in one schema, in one projection."""
    d = parsed(df, EXPORT)
    s = F.col("service")
    name = F.element_at(F.split(F.rtrim(F.when(s == "vertex", F.col("displayName")).otherwise(F.col("name")), F.lit("/")), "/"), -1)
    seg = lambda k: F.nullif(F.regexp_extract("name", f"(?:^|/){k}/([^/]+)", 1), F.lit(""))
    db = F.split("databaseVersion", "_", 2)
    props = {
        "cmek": F.when(s == "pubsub", F.coalesce(F.col("kmsKeyName") != "", F.lit(False)).cast("string")), "message_retention": F.when(s == "pubsub", F.col("messageRetentionDuration")),
        "location": F.when(s == "workflows", F.coalesce(seg("locations"), F.lit(""))).when(s == "gcs", F.col("location")),
        "source_contents": F.when(s == "workflows", F.col("sourceContents")), "state": F.when(s == "workflows", F.col("state")), "storage_class": F.when(s == "gcs", F.col("storageClass")),
        "zone": F.when((s == "dataplex") & seg("lakes").isNotNull() & seg("zones").isNotNull(), F.concat_ws("/", seg("lakes"), seg("zones"))),
        "resource_type": F.when(s == "dataplex", F.col("resourceSpec.type")),
        "pipeline_steps": F.when(s == "vertex", F.to_json(F.array_sort(F.map_keys("pipelineSpec.root.dag.tasks")))),
        "replication": F.when(s == "cloudsql", F.coalesce(F.size("replicaNames") > 0, F.lit(False)).cast("string")),
        "engine": F.when((s == "cloudsql") & F.col("databaseVersion").contains("_"), db[0]), "version": F.when((s == "cloudsql") & F.col("databaseVersion").contains("_"), db[1]),
        "dialect": F.when(s == "spanner", F.col("databaseDialect")),
        "explores": F.when((s == "looker") & (F.size("explores") > 0), F.to_json(F.array_sort(F.transform("explores", lambda e: e["name"])))),
    }
    bag = F.map_filter(F.create_map(*[x for k, c in props.items() for x in (F.lit(k), c)]), lambda _, v: v.isNotNull())
    out = d.select(F.concat_ws(".", F.lit(project), "service", name).alias("source_id"), name.alias("name"), map_literal(EXPORT_KINDS)[s].alias("kind"),
                   F.lit("external_payload").alias("discovered_from"), redact_map(bag).alias("properties"))
    return out.where("name <> ''")


def external_components(df: DataFrame, project: str) -> DataFrame:
    d = parsed(df, "kind string, name string, id string, source_id string, dependencies array<string>, properties map<string,string>")
    name = F.coalesce("name", "id")
    return d.where(F.col("kind").isin(KINDS)).select(
        F.coalesce("source_id", F.concat_ws(".", F.lit(project), "kind", name)).alias("source_id"), name.alias("name"), "kind",
        F.array_sort(F.coalesce("dependencies", F.array().cast("array<string>"))).alias("dependencies"),
        redact_map(F.coalesce("properties", F.create_map().cast("map<string,string>"))).alias("properties"))


def dataflow_jobs(df: DataFrame, project: str) -> DataFrame:
    """Regional job lists (columns region, position); the last row of an id wins."""
    d = parsed(df, "id string, name string, type string, currentState string, portable boolean, connector_compatible boolean")
    d = d.where("id <> ''").select(F.concat_ws(".", F.lit(project), F.lit("dataflow"), "region", "id").alias("source_id"), "position",
                                   F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id")).alias("name"),
                                   F.col("currentState").alias("state"), (F.col("type") == "JOB_TYPE_STREAMING").alias("streaming"))
    return latest_per_key(d, ["source_id"], ["position"]).drop("position")


CLUSTER = """clusterName string, status struct<state:string>, config struct<masterConfig:struct<machineTypeUri:string>,workerConfig:struct<machineTypeUri:string,numInstances:bigint>,
    autoscalingConfig:struct<minInstances:bigint,maxInstances:bigint>,stagingBucket:string,softwareConfig:struct<imageVersion:string>>"""


def clusters(df: DataFrame, project: str) -> DataFrame:
    d = parsed(df, CLUSTER)
    c = F.col("config")
    return d.select(
        F.concat_ws(".", F.lit(project), F.lit("dataproc"), "region", "clusterName").alias("source_id"), F.col("clusterName").alias("name"), "region",
        c["masterConfig"]["machineTypeUri"].alias("master_machine_type"), c["workerConfig"]["machineTypeUri"].alias("worker_machine_type"),
        F.when(c["workerConfig"].isNotNull(), F.coalesce(c["workerConfig"]["numInstances"], F.lit(0))).alias("worker_count"),
        c["autoscalingConfig"]["minInstances"].alias("autoscaling_min"), c["autoscalingConfig"]["maxInstances"].alias("autoscaling_max"),
        c["stagingBucket"].alias("staging_bucket"), F.when(F.col("status").isNotNull(), F.coalesce("status.state", F.lit("UNKNOWN"))).alias("state"),
        F.coalesce(c["softwareConfig"]["imageVersion"], F.lit("unknown")).alias("image_version"))


JOB_BLOCKS = [("pysparkJob", "pyspark", "python"), ("sparkJob", "spark", "unknown"), ("sparkSqlJob", "spark_sql", "sql"), ("hadoopJob", "hadoop", "unknown"),
              ("hiveJob", "hive", "sql"), ("pigJob", "pig", "pig")]


def dataproc_jobs(df: DataFrame, clusters_: DataFrame, project: str) -> DataFrame:
    """Type of the first block present, its language, and the runtime of the job's cluster."""
    d = parsed(df, "reference struct<jobId:string>, placement struct<clusterName:string>, status struct<state:string>, labels map<string,string>, "
               + ", ".join(f"{b} string" for b, _, _ in JOB_BLOCKS))
    kind = F.coalesce(*[F.when(F.col(b).isNotNull(), k) for b, k, _ in JOB_BLOCKS], F.lit("unknown"))
    lang = F.coalesce(F.try_element_at(map_literal([(k, x) for _, k, x in JOB_BLOCKS]), kind), F.lit("unknown"))
    label = lambda k: F.nullif(F.try_element_at("labels", F.lit(k)), F.lit(""))
    work = (F.when(label("workload_type").isNotNull(), label("workload_type")).when(label("workflow") == "streaming", "streaming")
            .when((kind == "pyspark") & F.lower("reference.jobId").contains("train"), "ml_training")
            .when(kind.isin("pyspark", "spark_sql", "spark", "hadoop"), "data_engineering").otherwise("unknown"))
    j = d.select(F.concat_ws(".", F.lit(project), F.lit("dataproc"), F.lit("job"), "region", "reference.jobId").alias("source_id"), F.col("reference.jobId").alias("name"),
                 kind.alias("job_type"), lang.alias("language"), work.alias("workload_type"), F.col("placement.clusterName").alias("cluster"), F.col("status.state").alias("state"))
    versions = clusters_.groupBy(F.col("name").alias("cluster")).agg(F.max("image_version").alias("runtime_version"))
    return j.join(versions, "cluster", "left").na.fill("unknown", ["runtime_version"])


def airflow_environments(df: DataFrame, project: str) -> DataFrame:
    d = parsed(df, """displayName string, name string, state string, config struct<nodeConfig:struct<machineType:string,location:string>,dagGcsPrefix:string,
        airflowConfigOverrides:string,softwareConfig:struct<imageVersion:string>>, labels map<string,string>""")
    name = F.coalesce("displayName", F.element_at(F.split("name", "/"), -1))
    return d.select(F.concat_ws(".", F.lit(project), F.lit("composer"), F.lit("env"), "location", name).alias("source_id"), name.alias("name"), "location",
                    F.coalesce("state", F.lit("UNKNOWN")).alias("state"), F.col("config.nodeConfig.machineType").alias("machine_type"),
                    F.col("config.dagGcsPrefix").alias("dag_prefix"), F.col("config.airflowConfigOverrides").isNotNull().alias("has_overrides"),
                    F.coalesce("config.softwareConfig.imageVersion", F.try_element_at("labels", F.lit("version")), F.lit("unknown")).alias("runtime_version"))


TASK = ("struct<task_type:string,sql:string,query:string,destination_dataset_table:string,dataset_id:string,table_id:string,conn_id:string,connection_id:string,"
        "gcp_conn_id:string,google_cloud_conn_id:string,provider:string,pool:string,sla:string,retries:bigint>")
DAG = f"dagId string, schedule string, isPaused boolean, serializedDag struct<_task_cycle:array<{TASK}>>"
# tables named in task SQL (fixed value)
DAG_TABLE = r"`([^`]+\.[^`]+\.[^`]+)`|bigquery\.table\(['\"`]([^'\"` ]+)['\"`]\)"


def _values(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda x: F.coalesce(x != "", F.lit(False)))))


def dag_table_refs(tasks: Column) -> Column:
    """Tables a DAG touches: in SQL text, as destination, or as dataset plus table."""
    sql = F.transform(tasks, lambda k: F.coalesce(k["sql"], k["query"], F.lit("")))
    group = lambda i: F.flatten(F.transform(sql, lambda s: F.regexp_extract_all(s, F.lit(DAG_TABLE), F.lit(i))))
    found = [group(1), group(2)]
    pair = F.transform(tasks, lambda k: F.when((k["dataset_id"] != "") & (k["table_id"] != ""), F.concat_ws(".", k["dataset_id"], k["table_id"])))
    return _values(*found, F.transform(tasks, lambda k: k["destination_dataset_table"]), pair)


def airflow_dags(df: DataFrame, project: str) -> DataFrame:
    """DAGs with what their tasks use; tasks stay an array of their own DAG's row."""
    d = parsed(df, DAG)
    tasks = F.coalesce(F.col("serializedDag._task_cycle"), F.array().cast(f"array<{TASK}>"))
    ops = _values(F.transform(tasks, lambda k: F.coalesce(k["task_type"], F.lit("Unknown"))))
    each = lambda f: F.transform(tasks, lambda k: k[f])
    conns = _values(*[each(c) for c in ("conn_id", "connection_id", "gcp_conn_id", "google_cloud_conn_id")])
    first = lambda f: F.get(F.filter(F.transform(tasks, lambda k: k[f]), lambda x: x.isNotNull()), F.lit(0))
    has = lambda *w: F.exists(ops, lambda o: o.rlike("|".join(w)))
    low = F.lower("dagId")
    kind = (F.when(low.rlike("train|ml"), "ml_training").when(low.rlike("stream|kafka"), "streaming").when(has("Dataproc", "Spark"), "spark_orchestration")
            .when(has("BigQuery", "SQL"), "analytics").when(has("Sensor"), "event_driven").otherwise("general_orchestration"))
    return d.select(F.concat_ws(".", F.lit(project), F.lit("composer"), F.lit("dag"), "location", "dagId").alias("source_id"), F.col("dagId").alias("dag_id"),
                    kind.alias("dag_type"), ops.alias("operators"), conns.alias("connections"), _values(F.transform(tasks, lambda k: k["provider"])).alias("providers"),
                    F.filter(ops, lambda o: o.contains("Sensor")).alias("sensors"), _values(F.transform(tasks, lambda k: k["pool"])).alias("pools"),
                    first("sla").alias("sla"), first("retries").alias("retries"), dag_table_refs(tasks).alias("tables"))


NODE = "struct<database:string,schema:string,name:string,relationType:string,isView:boolean,incremental:boolean>"


def dataform_objects(df: DataFrame, project: str) -> DataFrame:
    """Compiled targets with their dependencies (incoming edges) and assertion flag (outgoing
    ASSERTION edges). A result that cannot be read stays as an incomplete row."""
    d = parsed(df, f"dataSourceA struct<targets:array<{NODE}>,edges:array<struct<sourceTarget:{NODE},targetTarget:{NODE},edgeType:string>>>")
    d = settle(d, "compilations")  # parsed once, read for targets, edges and flaws
    key = lambda p: F.concat_ws(".", p + ".schema", p + ".name")
    edges = d.select("compilation", F.explode("dataSourceA.edges").alias("e")).select(
        "compilation", key("e.sourceTarget").alias("src"), key("e.targetTarget").alias("dst"), (F.col("e.edgeType") == "ASSERTION").alias("is_assertion"))
    deps = edges.groupBy("compilation", F.col("dst").alias("key")).agg(F.sort_array(F.collect_set("src")).alias("dependencies"))
    tested = edges.groupBy("compilation", F.col("src").alias("key")).agg(F.bool_or("is_assertion").alias("has_assertions"))
    t = d.select("compilation", F.explode("dataSourceA.targets").alias("t")).select("compilation", key("t").alias("key"), F.col("t.name").alias("name"), (
        F.upper(F.coalesce("t.relationType", F.lit("TABLE"))) == "ASSERTION").alias("is_assertion"), F.coalesce("t.isView", F.lit(False)).alias("is_view"),
        F.coalesce("t.incremental", F.lit(False)).alias("incremental"))
    out = t.join(deps, ["compilation", "key"], "left").join(tested, ["compilation", "key"], "left")
    prefix = F.when(F.col("is_assertion"), "assertion").otherwise("target")
    full = out.select(
        "compilation", F.concat_ws(".", F.lit(project), F.lit("dataform"), prefix, "key").alias("source_id"), "name",
        F.when(F.col("is_assertion"), "dataform_workflow").when(F.col("is_view"), "view").otherwise("table").alias("kind"),
        F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"), F.coalesce("has_assertions", F.lit(False)).alias("has_assertions"),
        (F.col("incremental") & ~F.col("is_assertion")).alias("incremental"), (~F.col("is_assertion")).alias("is_model"), F.lit(False).alias("incomplete"))
    bad = d.where("unreadable").select(
        "compilation", F.concat_ws(".", F.lit(project), F.lit("dataform"), F.lit("compilation"), "compilation").alias("source_id"), F.col("compilation").alias("name"),
        F.lit("dataform_workflow").alias("kind"), F.array().cast("array<string>").alias("dependencies"), F.lit(False).alias("has_assertions"),
        F.lit(False).alias("incremental"), F.lit(False).alias("is_model"), F.lit(True).alias("incomplete"))
    return full.unionByName(bad)


def dataform_evidence(objects: DataFrame) -> DataFrame:
    """Summary per compilation: model count, any assertion, any incremental, incomplete."""
    return objects.groupBy("compilation").agg(
        F.count_if("is_model").alias("models"), F.bool_or(F.col("source_id").contains(".assertion.")).alias("assertions"),
        F.bool_or("incremental").alias("incremental"), F.bool_or("incomplete").alias("incomplete"))


TRANSLATED_MACROS = ["ref", "source", "config", "is_incremental"]
DBT_NODE = ("struct<resource_type:string,name:string,schema:string,config:struct<materialized:string,unique_key:string>,raw_code:string,"
            "depends_on:struct<nodes:array<string>,macros:array<string>>,test_metadata:struct<name:string,kwargs:struct<column_name:string>>>")


# up to this many characters a manifest is resolved inside its row, where a lookup is a scan of its nodes
ROW_CHARS = 1 << 15
DBT_TARGET = "array<struct<up:string,ref:string,source:string>>"


def _dbt_entries(d: DataFrame) -> DataFrame:
    """Per manifest the fields of its nodes that are used, and what a node can refer to: models by name, sources by both names."""
    n = lambda e: e["value"]
    models = F.transform(F.filter(F.map_entries("nodes"), lambda e: n(e)["resource_type"] == "model"), lambda e: F.struct(
        e["key"].alias("up"), n(e)["name"].alias("ref"), F.lit(None).cast("string").alias("source")))
    sources = F.transform(F.map_entries("sources"), lambda e: F.struct(
        e["key"].alias("up"), F.lit(None).cast("string").alias("ref"), F.concat_ws(".", n(e)["source_name"], n(e)["name"]).alias("source")))
    return d.select("project", F.transform(F.map_entries("nodes"), lambda e: F.struct(
        e["key"].alias("key"), n(e)["resource_type"].alias("resource_type"), n(e)["name"].alias("name"), n(e)["config"]["materialized"].alias("materialized"),
        n(e)["config"]["unique_key"].alias("unique_key"), n(e)["depends_on"]["nodes"].alias("ups"), n(e)["depends_on"]["macros"].alias("macros"),
        n(e)["test_metadata"]["name"].alias("test"), n(e)["test_metadata"]["kwargs"]["column_name"].alias("column"))).alias("entries"),
        F.concat(*[F.coalesce(x.cast(DBT_TARGET), F.array().cast(DBT_TARGET)) for x in (models, sources)]).alias("targets"),
        (F.size(F.array_distinct(F.map_keys("nodes"))) < F.size("nodes")).alias("repeats"))


def _joined_references(d: DataFrame) -> DataFrame:
    """Nodes of manifests with their references, by joins on the node key."""
    # Parsed once: nodes and targets leave the manifest as rows of one written table.
    node, target = (d.schema[c].dataType.elementType for c in ("entries", "targets"))
    entries = F.concat(F.transform("entries", lambda n: F.struct(n.alias("n"), F.lit(None).cast(target).alias("t"))),
                       F.transform("targets", lambda t: F.struct(F.lit(None).cast(node).alias("n"), t.alias("t"))))
    rows = settle(d.select("project", F.explode(entries).alias("e")).select("project", "e.*"), "manifest")
    nodes, targets = rows.where("n is not null").select("project", "n.*"), rows.where("t is not null").select("project", "t.*")
    up = nodes.select("project", "key", F.explode("ups").alias("up")).join(targets, ["project", "up"])
    refs = up.groupBy("project", "key").agg(F.sort_array(F.collect_list("ref")).alias("refs"), F.sort_array(F.collect_list("source")).alias("sources"))
    return nodes.join(refs, ["project", "key"], "left").drop("key", "ups")


def _row_references(d: DataFrame) -> DataFrame:
    """The same for manifests that are the only one of their project: all that a node can refer
    to is in its row. Where the project is null nothing is referred to, as in the joins."""
    none = F.array().cast("array<string>")
    # a key that JSON repeats is one node with the references of all
    ups = lambda e: F.when(F.col("project").isNull(), none).when(F.col("repeats"), F.flatten(F.transform(
        F.filter("entries", lambda o: o["key"] == e["key"]), lambda o: F.coalesce(o["ups"], none)))).otherwise(F.coalesce(e["ups"], none))
    found = lambda e: F.flatten(F.transform(ups(e), lambda u: F.filter("targets", lambda o: o["up"] == u)))
    n = d.select("project", F.explode(F.transform("entries", lambda e: F.struct(e.alias("n"), found(e).alias("found")))).alias("e")).select("project", "e.n.*", "e.found")
    return n.select(*[c for c in n.columns if c not in ("key", "ups", "found")], *[F.sort_array(F.array_compact(F.col(f"found.{c}"))).alias(f"{c}s") for c in ("ref", "source")])


def dbt_nodes(df: DataFrame) -> DataFrame:
    """Models and tests of manifests (column ``project``), references resolved on the node key:
    inside the row of a manifest that is short and the only one of its project, by joins for
    all others, so a manifest of any size is spread over the cluster."""
    df, n = settle_counted(df.select("project", "payload"), "manifests", long=F.count_if(F.length("payload") > ROW_CHARS))
    again = df.where("project is not null").groupBy("project").count().where("count > 1").select("project", F.lit(True).alias("again"))
    again, m = settle_counted(again, "projects", rows=F.count(F.lit(1)))
    of = lambda some: _dbt_entries(parsed(some, f"sources map<string,struct<source_name:string,name:string>>, nodes map<string,{DBT_NODE}>"))
    if n["long"] or m["rows"]:
        df = df.join(again, "project", "left").withColumn("joined", F.coalesce(F.col("again"), F.length("payload") > ROW_CHARS, F.lit(False))).drop("again")
        nodes = _row_references(of(df.where("not joined"))).unionByName(_joined_references(of(df.where("joined"))))
    else:
        nodes = _row_references(of(df))
    macros = F.array_sort(F.array_except(F.transform("macros", lambda m: F.element_at(F.split(m, r"\."), -1)), F.array(*[F.lit(m) for m in TRANSLATED_MACROS])))
    is_test = F.col("resource_type") == "test"
    none = F.array().cast("array<string>")
    return nodes.where(F.col("resource_type").isin("model", "test")).select(
        "project", F.col("resource_type").alias("type"), F.when(is_test, F.coalesce("test", "name")).otherwise(F.col("name")).alias("name"),
        F.when(~is_test, F.coalesce("materialized", F.lit("view"))).alias("materialized"), "unique_key",
        F.coalesce("refs", none).alias("refs"), F.coalesce("sources", none).alias("sources"), F.when(is_test, none).otherwise(F.coalesce(macros, none)).alias("macros"),
        F.coalesce("column", F.lit("")).alias("column"))
