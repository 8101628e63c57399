import json

from pyspark.sql import functions as F

from carryover import plans
from carryover.plans.registry import QUERIES
from carryover.sources import ingest

plans.load()


def _manifest(n_models, **more):
    """Models m0, m1, ..., each built on the one before it and on a source, and a test of each."""
    nodes = {f"model.m{i}": {"resource_type": "model", "name": f"m{i}", "depends_on": {"nodes": [f"model.m{i - 1}", "source.s"], "macros": ["dbt.ref", "u.key"]}} for i in range(n_models)}
    nodes |= {f"test.t{i}": {"resource_type": "test", "name": "x", "depends_on": {"nodes": [f"model.m{i}"]}, "test_metadata": {"name": "unique", "kwargs": {"column_name": "id"}}} for i in range(n_models)}
    return json.dumps({"sources": {"source.s": {"source_name": "raw", "name": "o"}}, "nodes": nodes | more})


def _found(df):
    return sorted(((r.project, r.type, r.name, r.materialized, tuple(r.refs), tuple(r.sources), tuple(r.macros), r.column) for r in df.collect()), key=repr)


ODD_MANIFESTS = [
    ("whole", _manifest(3, seed={"resource_type": "seed", "name": "s"}, none=None, bare={"resource_type": "model", "name": None, "config": {"materialized": "table"}},
                        twice={"resource_type": "model", "name": "tw", "depends_on": {"nodes": ["model.m1", "model.m1", None, "bare", "gone", "seed", "test.t0"]}})),
    (None, _manifest(2)), (None, _manifest(2)),
    ("shared", _manifest(1)), ("shared", json.dumps({"nodes": {"model.o": {"resource_type": "model", "name": "o", "depends_on": {"nodes": ["model.m0", "source.s"]}}}})),
    ("same", '{"nodes":{"a":{"resource_type":"model","name":"a1"},"a":{"resource_type":"model","name":"a2","depends_on":{"nodes":["a"]}},"b":{"resource_type":"model","name":"b","depends_on":{"nodes":["a"]}}}}'),
    ("empty source", '{"sources":{"s":null},"nodes":{"m":{"resource_type":"model","name":"m","depends_on":{"nodes":["s"]}}}}'),
    ("both", '{"sources":{"m":{"source_name":"r","name":"t"}},"nodes":{"m":{"resource_type":"model","name":"m","depends_on":{"nodes":["m"]}}}}'),
    ("no json", "nothing"), ("no text", None), ("no nodes", "{}"),
]


def test_dbt_references_in_row_equal_joined_ones(spark, monkeypatch):
    d = spark.createDataFrame([*ODD_MANIFESTS, ("long", _manifest(300))], "project string, payload string")
    got = _found(ingest.dbt_nodes(d))
    monkeypatch.setattr(ingest, "ROW_CHARS", -1)
    assert got == _found(ingest.dbt_nodes(d))
    of = lambda p: {(r[1], r[2]): r[4:6] for r in got if r[0] == p}
    assert of("whole") == {("model", "m0"): ((), ("raw.o",)), ("model", "m1"): (("m0",), ("raw.o",)), ("model", "m2"): (("m1",), ("raw.o",)), ("model", None): ((), ()),
                           ("model", "tw"): (("m1", "m1"), ()), ("test", "unique"): (("m2",), ())}
    assert sorted(r[4] for r in got if r[0] == "whole" and r[1] == "test") == [("m0",), ("m1",), ("m2",)]
    assert len([r for r in got if r[0] is None]) == 8 and {r[4:6] for r in got if r[0] is None} == {((), ())}
    assert of("shared")[("model", "o")] == (("m0",), ("raw.o",))
    assert of("same") == {("model", "a1"): (("a1", "a2"), ()), ("model", "a2"): (("a1", "a2"), ()), ("model", "b"): (("a1", "a2"), ())}
    assert of("empty source") == {("model", "m"): ((), ("",))} and of("both") == {("model", "m"): (("m",), ("r.t",))}
    assert of("long")[("model", "m299")] == (("m298",), ("raw.o",)) and len([r for r in got if r[0] == "long"]) == 600


def test_dbt_nodes_of_short_manifests_are_not_shuffled(spark):
    d = spark.createDataFrame([(f"p{i}", _manifest(3)) for i in range(20)], "project string, payload string")
    r = ingest.dbt_nodes(d)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and r.count() == 120


def test_dbt_manifest_text_is_what_to_json_writes(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(o, n) for o in (1, 2, None) for n in (3, 1, 2, 1, None)] + [(4, None)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, nodes = [], ingest.dbt_nodes
    monkeypatch.setattr(ingest, "dbt_nodes", lambda d: seen.append(d) or nodes(d))
    QUERIES["dbt_manifest_ingest"](spark, str(tmp_path))
    schema = f"sources map<string,struct<source_name:string,name:string>>, nodes map<string,{ingest.DBT_NODE}>"
    r = seen[0].select("project", "payload", F.to_json(F.from_json("payload", schema)).alias("again")).collect()
    assert sorted(str(x.project) for x in r) == ["None", "proj1", "proj2", "proj4"] and all(x.payload == x.again for x in r)
    assert {len(json.loads(x.payload)["nodes"]) for x in r} == {6, 0}
