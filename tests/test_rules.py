import pytest
from pyspark.sql import functions as F

from carryover.operators import rules as R
from carryover.operators import typemap

BASE = dict(source_id="x", name="n", kind="table", discovered_from="inventory", size_bytes=None, partition_field=None, clustering_fields=None, sql=None,
            n_columns=1, properties={}, parity_status="passed", nested=False)
SCHEMA = ("source_id string, name string, kind string, discovered_from string, size_bytes long, partition_field string, clustering_fields string, sql string, "
          "n_columns long, properties map<string,string>, parity_status string, nested boolean")


def frame(spark, *rows_):
    return spark.createDataFrame([tuple({**BASE, **r}.values()) for r in rows_], SCHEMA)


@pytest.mark.parametrize("row,prefs,want", [
    (dict(kind="stream"), {}, ("eventhouse", "transform")),
    (dict(kind="spark_job", properties={"streaming": "true"}), {}, ("lakehouse", "transform")),
    (dict(kind="dataflow_job", properties={"streaming": "false", "portable": "true", "connector_compatible": "true"}), {}, ("dataflow_gen2", "transform")),
    (dict(kind="dataflow_job", properties={"streaming": "true", "portable": "true", "connector_compatible": "true"}), {}, ("eventhouse", "redesign")),
    (dict(kind="dataflow_job"), {}, ("lakehouse", "redesign")),
    (dict(kind="composer_dag", properties={"unsupported_operators": "[]"}), {}, ("airflow_job", "transform")),
    (dict(kind="composer_dag"), {"preserve_airflow": False}, ("data_pipeline", "transform")),
    (dict(kind="composer_dag", properties={"custom_plugins": "true"}), {}, ("data_pipeline", "redesign")),
    (dict(kind="dataform_workflow"), {"transformation_framework": "dbt"}, ("dbt_job", "transform")),
    (dict(kind="dataform_workflow"), {"data_target": "lakehouse"}, ("lakehouse", "transform")),
    (dict(kind="routine", properties={"language": "javascript"}), {}, ("lakehouse", "redesign")),
    (dict(kind="routine"), {}, ("warehouse", "transform")),
    (dict(kind="connection", properties={"connection_type": "CLOUD_SQL", "database_engine": "POSTGRES"}), {}, ("data_pipeline", "transform")),
    (dict(kind="connection", properties={"connection_type": "CLOUD_SQL", "database_engine": "SQLSERVER"}), {}, ("manual", "redesign")),
    (dict(kind="connection", properties={}), {}, ("manual", "redesign")),
    (dict(kind="table"), {}, ("warehouse", "direct")),
    (dict(kind="table", nested=True), {}, ("lakehouse", "transform")),
    (dict(kind="security_policy"), {}, ("manual", "unsupported")),
])
def test_mapping(spark, row, prefs, want):
    r = R.map_component(frame(spark, row), prefs).first()
    assert (r.target, r.compatibility) == want


def test_evidence(spark):
    d = R.with_evidence(frame(
        spark, dict(source_id="a", kind="dataform_workflow", properties={"models": "[]", "assertions": "false", "incremental": "[]"}),
        dict(source_id="b", kind="spark_job", properties={"language": "python", "runtime_version": "unknown", "code": " "}),
        dict(source_id="c", kind="stream"), dict(source_id="d", kind="table", size_bytes=0, n_columns=0),
        dict(source_id="e", kind="composer_dag", properties={"operators": "x", "runtime_version": "Not Specified", "connections": "[]"})))
    got = {r.source_id: (sorted(r.missing), r.coverage) for r in d.collect()}
    assert got == {"a": (["incremental"], 67), "b": (["code", "runtime_version"], 33), "c": ([], 100), "d": (["columns"], 50), "e": (["runtime_version"], 67)}


def test_half_even(spark):
    d = spark.range(1).select(F.bround(F.lit(62.5), 0).alias("a"), F.bround(F.lit(63.5), 0).alias("b")).first()
    assert (d.a, d.b) == (62.0, 64.0)


def test_layout_threshold(spark):
    size = 10 * 1024 ** 3
    d = frame(spark, dict(source_id="at", size_bytes=size), dict(source_id="below", size_bytes=size - 1), dict(source_id="ok", size_bytes=size, partition_field="d", clustering_fields="c"))
    got = {r.source_id: len(r.c) for r in d.select("source_id", R.layout_codes().alias("c")).collect()}
    assert got == {"at": 2, "below": 0, "ok": 0}


def assess(spark, *rows_):
    d = R.with_evidence(R.map_component(frame(spark, *rows_)))
    return d.withColumns({"sql_level": F.lit(None).cast("string"), "streaming_downstream": F.lit(False), "rank": F.lit(0)})


def test_one_fail_zeroes_the_score(spark):
    d = assess(spark, dict(source_id="a", size_bytes=1), dict(source_id="b", size_bytes=1, parity_status="failed"), dict(source_id="c", kind="view", sql="s"))
    f = R.with_severity(R.row_findings(d))
    got = {r.source_id: r.score for r in R.component_scores(d, f).collect()}
    assert got == {"a": 100, "b": 0, "c": 80}


def test_many_trivial_columns_do_not_change_the_score(spark):
    d1 = assess(spark, dict(source_id="a", size_bytes=1, n_columns=1))
    d2 = assess(spark, dict(source_id="a", size_bytes=1, n_columns=101))
    score = lambda d: R.component_scores(d, R.with_severity(R.row_findings(d))).first().score
    assert score(d1) == score(d2) == 100


def test_strategy_ties_and_pin(spark):
    one = lambda *k: R.strategy(R.map_component(frame(spark, *[dict(source_id=str(i), **x) for i, x in enumerate(k)]))).first()
    tie = one(dict(kind="view"), dict(kind="gcs_source"))
    assert (tie.warehouse, tie.lakehouse, tie.primary, tie.architecture) == (2, 2, "warehouse", "hybrid")
    pin = one(dict(kind="gcs_source", properties={"requires_multi_table_transactions": "true"}))
    assert pin.primary == "warehouse" and pin.lakehouse == 2


def test_type_findings_group_paths(spark):
    d = spark.createDataFrame([("t", "b", "ARRAY<INT64>"), ("t", "a", "array"), ("t", "c", "WEIRD"), ("t", "d", "NUMERIC(10,2)")], "source_id string, path string, data_type string")
    got = {(r.source_type, r.paths, r.code) for r in typemap.type_findings(typemap.map_types(d)).collect()}
    assert got == {("ARRAY", "a, b", "TYPE_REDESIGN"), ("WEIRD", "c", "TYPE_UNSUPPORTED")}


def test_review_reasons_keep_their_order_and_cycle_stands_alone(spark):
    d = assess(spark, dict(source_id="a", kind="bqml_model", discovered_from="assisted"), dict(source_id="b", kind="bqml_model"))
    f = R.with_severity(R.row_findings(d))
    ext = spark.createDataFrame([("a", "z")], "child string, parent string")
    taints = spark.createDataFrame([("a", "depends_on_incomplete_external_adapter")], "id string, reason string")
    w = spark.createDataFrame([("a", 1, False), ("b", 2, True)], "id string, wave long, stuck boolean")
    got = {r.id: r.reasons for r in R.review_reasons(d, f, ext, taints, w).collect()}
    assert got == {"a": ["external_dependency", "incompatible_mapping", "depends_on_incomplete_external_adapter", "missing_required_evidence", "assisted_evidence"],
                   "b": ["cycle_or_unresolved_dependency"]}


def test_dashboard_capacity(spark):
    t = spark.createDataFrame([("d", i, "card", 0, 1, False, False, True) for i in range(8)] + [("d", 8, "card", 1, 1, False, False, True)],
                              "dashboard string, tile int, type string, n_dimensions int, n_measures int, has_filters boolean, has_pivots boolean, resolved boolean")
    got = {r.tile: r.code for r in R.dashboard_gate(t).collect()}
    assert [got[i] for i in range(9)] == ["ok"] * 6 + ["layout_capacity_exceeded"] * 2 + ["unsupported_visual"]


def test_the_estate_is_derived_once_for_mapping_and_stream_seeds(spark, tmp_path, monkeypatch):
    from carryover.plans import estate_rules
    from carryover.plans.registry import Tables
    spark.range(1, 40).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size", "900.0 + id as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    calls, real = [], estate_rules.estate_objects
    monkeypatch.setattr(estate_rules, "estate_objects", lambda t: calls.append(1) or real(t))
    assert estate_rules.assessed(Tables(spark, str(tmp_path))).count() == 39
    assert len(calls) == 1


def test_a_sign_off_names_the_parity_provenance_and_security_codes_of_each_component(spark, tmp_path):
    from carryover.plans import estate_rules
    from carryover.plans.registry import Tables
    spark.range(1, 60).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size", "900.0 + id as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    t = Tables(spark, str(tmp_path))
    got = estate_rules.wave_signoff(t).collect()
    own = {r.source_id: r for r in estate_rules.estate_objects(t).collect()}
    assert sorted(r.source_id for r in got) == sorted(own)
    for r in got:
        o, wave = own[r.source_id], [x for x in got if x.wave == r.wave]
        assert (r.parity_status, r.discovered_from) == (o.parity_status, o.discovered_from)
        assert r.review_codes == r.wave_review_codes == [] and (not r.blocker_codes or o.kind == "security_policy")
        assert (r["items"], r.parity_failed, r.provenances) == (len(wave), sum(x.parity_status == "failed" for x in wave), len({x.discovered_from for x in wave}))
        assert r.wave_blocker_codes == sorted({c for x in wave for c in x.blocker_codes})
        assert r.security_status == ("blocked" if r.wave_blocker_codes else "not_recorded")
    assert {c for r in got for c in r.blocker_codes} == {"SECURITY_EVIDENCE_MISSING"}
