import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from carryover.operators import access, dml, graph, integrity, quality, semantic, steps, training
from carryover.operators.reshape import array_to_child, flatten_struct, item_arrays
from carryover.session import scratch, settle
from carryover.sources import ingest, sinks


def test_merge(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    s = spark.createDataFrame([(2, "B", False), (3, "x", True), (4, "d", False), (5, "e", True)], "k int, v string, gone boolean")
    assert rows(dml.merge(t, s, ["k"], delete=F.col("gone"))) == [(1, "a"), (2, "B"), (4, "d")]


def test_merge_raises_on_two_matches_only(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="more than one source row"):
        dml.merge(t, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), ["k"]).collect()
    fine = dml.merge(t, spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string"), ["k"])
    assert rows(fine) == [(1, "a"), (2, "x"), (2, "y")]


def test_delete_keeps_unknown(spark):
    d = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    assert rows(dml.delete_where(d, F.col("v") == "x").select("k")) == [(2,), (3,)]


def test_change_set_round_trip(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "k int, v string")
    ch = dml.change_set(a, b, ["k"]).withColumn("n", F.lit(1))
    assert rows(dml.apply_changes(a, ch, ["k"], ["n"])) == rows(b)
    assert {(r.k, r.op) for r in dml.change_set(b, a, ["k"]).collect()} == {(2, "update"), (3, "insert"), (4, "delete")}


def test_upsert_needs_a_key_and_takes_the_newest(spark):
    t = spark.createDataFrame([(1, "a", 1)], "k int, v string, n int")
    s = spark.createDataFrame([(1, "b", 2), (1, "c", 3), (2, "d", 1)], "k int, v string, n int")
    assert rows(dml.upsert_latest(t, s, ["k"], ["n"])) == [(1, 3, "c"), (2, 1, "d")]
    with pytest.raises(ValueError):
        dml.upsert_latest(t, s, [], ["n"])


def test_watermark_load_retries_without_repeats(spark):
    src = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i)) for i in range(10)], "id int, ts timestamp_ntz")
    path, state = scratch(spark, "inc"), scratch(spark, "state")
    assert sinks.incremental_load(src, "ts", path, state, "t", "2024-01-05") == "2024-01-05 00:00:00"
    # A run that wrote its rows but died before its record: the next one replaces it.
    sinks.overwrite_partitions(src.where("id = 7").withColumn("_after", F.lit(sinks.batch_name("2024-01-05 00:00:00"))), path, ["_after"])
    assert sinks.incremental_load(src, "ts", path, state, "t") == "2024-01-10 00:00:00"
    assert sinks.incremental_load(src, "ts", path, state, "t") == "2024-01-10 00:00:00"
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10))
    assert sinks.read_watermark(spark, state, "other", src.schema["ts"].dataType) is None


@pytest.mark.parametrize("kind, values", [
    ("timestamp_ntz", [dt.datetime(2024, 1, 1, 0, 0, 0, 250_000), dt.datetime(2024, 1, 1, 0, 0, 0, 999_999), dt.datetime(2024, 1, 1, 0, 0, 1)]),
    ("bigint", [9, 10, 100]), ("date", [dt.date(2024, 1, 9), dt.date(2024, 1, 10), dt.date(2024, 2, 1)]), ("double", [0.1, 0.30000000000000004, 2.0]),
    ("string", ["a", "b:c", "d/e"])])
def test_watermarks_of_any_type(spark, kind, values):
    path, state = scratch(spark, "inc"), scratch(spark, "state")
    for n in (1, 2, 2, 3, 3):
        src = spark.createDataFrame([(i, v) for i, v in enumerate(values[:n])] + [(9, None)], f"id int, w {kind}")
        sinks.incremental_load(src, "w", path, state, "t")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2]


def test_append_run_twice(spark):
    d, path = spark.range(5), scratch(spark, "app")
    for run in ("a", "b", "b"):
        sinks.append_run(d, path, run)
    assert spark.read.parquet(path).count() == 10


def test_report_is_ordered_and_stable(spark):
    d = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    read = lambda p: [r.value for r in spark.read.text(p).collect()]
    a, b = scratch(spark, "r"), scratch(spark, "r")
    sinks.write_report(d, a, ["k"], single_file=True)
    sinks.write_report(d.repartition(3), b, ["k"], single_file=True)
    assert read(a) == read(b) == ["k,v", "1,a", "2,b", "3,c"]


def test_models_run_in_order_and_cycles_fail(spark):
    x = spark.range(4)
    ms = [sinks.Model("b", "select sum(id) s from {a}", "table", ["a"]), sinks.Model("a", "select id * 2 as id from {x}", "view", ["x"])]
    assert sinks.materialize_models(spark, ms, scratch(spark, "m"), {"x": x})["b"].first().s == 12
    with pytest.raises(Exception):
        sinks.materialize_models(spark, [sinks.Model("a", "select 1", "view", ["b"]), sinks.Model("b", "select 1", "view", ["a"])], "x", {})


def test_statements_stop_at_the_first_failure(spark):
    with pytest.raises(RuntimeError, match="statement 2 .bad."):
        steps.run_statements(spark, [("a", "select 1 as x"), ("bad", "select nope from {a}"), ("c", "select 1")], {})
    d = steps.with_fallback(lambda: spark.sql("select nope"), lambda e: spark.sql("select 'fallback' as b"))
    assert d.first().b == "fallback"


def test_reshape(spark):
    d = spark.createDataFrame([(1, ("x", (2,)))], "id int, s struct<a:string, t:struct<b:int>>")
    assert flatten_struct(d).columns == ["id", "s_a", "s_t_b"]
    arr = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None)], "id int, a array<int>")
    assert rows(array_to_child(arr, ["id"], "a").select("id", "ordinal", "item")) == rows(
        spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, None, None), (3, None, None)], "id int, ordinal int, item int"))
    assert arr.select(F.explode("a")).count() == 2
    hot = spark.range(1000).select(F.lit("k").alias("k"), "id")
    nested = item_arrays(hot, ["k"], {"id": "id"}, F.col("id").cast("string"), 100)
    assert nested.count() == 10 and nested.agg(F.max(F.size("items"))).first()[0] < 200 and nested.select(F.explode("items")).count() == 1000


def ledger_replay(entries):
    """Reference replay, one entry after the other."""
    last, out = {}, {}
    for s, r, n, o, v, q in sorted(entries, key=lambda e: (e[0], e[1], e[2], e[5])):
        p = last.get((s, r))
        if p is None:
            x = "accepted" if n == 1 else "first verdict must be round 1"
        elif p[1] != "changes_requested":
            x = "thread already closed"
        elif n != p[0] + 1:
            x = "unexpected round"
        elif o != p[2]:
            x = "owner changed"
        else:
            x = "accepted"
        if x == "accepted":
            last[(s, r)] = (n, v, o)
        out[q] = x
    return out


@pytest.mark.parametrize("long", [integrity.LONG_THREAD, 300, 0])
def test_ledger_matches_replay(spark, monkeypatch, long):
    """All threads sorted whole, some of them spread, all of them spread."""
    monkeypatch.setattr(integrity, "LONG_THREAD", long)
    r = random.Random(11)
    es = [(r.choice("ab") if i % 3 else "hot", r.choice("xy"), r.randrange(0, 6), r.choice("pq"), r.choice(["changes_requested"] * 4 + ["accepted", "escalate"]), i) for i in range(600)]
    # Long valid threads too, so that hot threads are cut.
    es += [("long", "x", n, "p", "changes_requested", 1000 + n) for n in range(1, 400)] + [("long", "x", 400, "p", "accepted", 5000), ("long", "x", 401, "p", "accepted", 5001)]
    d = spark.createDataFrame(es, "slice string, reviewer string, round long, owner string, verdict string, seq long")
    got = {x.seq: x.outcome for x in integrity.ledger_sequence(d.repartition(6)).collect()}
    assert got == ledger_replay(es)


def test_file_manifest(spark):
    root = scratch(spark, "files")
    spark.createDataFrame([("a",), ("b",)], "v string").repartition(2, "v").write.text(root)
    m = integrity.file_manifest(spark, root).where("path like '%part-%'")
    h = integrity.manifest_hash(m).first().manifest_sha256
    assert h == integrity.manifest_hash(m.orderBy(F.desc("path"))).first().manifest_sha256 and len(h) == 64
    bad = m.limit(1).withColumn("sha256", F.lit("0" * 64)).unionByName(spark.createDataFrame([("gone", "1" * 64, 1), ("../x", "2" * 64, 1), ("m", "zz", 1)], "path string, sha256 string, size long"))
    assert sorted(r.problem for r in integrity.verify_files(bad, m).collect()) == ["changed", "escaping", "malformed", "missing"]


def test_fan_out_does_not_double(spark):
    o = spark.createDataFrame([(1, "F", 10.0), (2, "F", 20.0), (3, "O", 5.0)], "ok int, st string, price double")
    li = spark.createDataFrame([(1, "A", 1.0), (1, "A", 2.0), (1, "R", 4.0), (2, "A", 8.0)], "lk int, flag string, q double")
    orders = semantic.View("orders", o, "ok", {"status": "st"}, {"revenue": semantic.Measure("sum", "price"), "count": semantic.Measure("count")})
    items = semantic.View("items", li, "lk", {"flag": "flag"}, {"qty": semantic.Measure("sum", "q")})
    ex = semantic.Explore(orders, [semantic.Join(items, ("ok", "lk"), "one_to_many")])
    got = {r.orders_status: (r.orders_revenue, r.orders_count, r.items_qty) for r in semantic.semantic_query(ex, ["orders.status"], ["orders.revenue", "orders.count", "items.qty"]).collect()}
    assert got == {"F": (30.0, 2, 15.0), "O": (5.0, 1, None)}
    with pytest.raises(ValueError):
        semantic.semantic_query(ex, ["orders.nope"], ["orders.count"])
    with pytest.raises(ValueError):
        semantic.check_measure(semantic.Measure("sum", "st"), o)
    assert semantic.semantic_query(ex, [], ["orders.count"], "st = 'none'").first().orders_count == 0


def test_period_bounds_are_open_at_the_start(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),), (dt.date(2024, 1, 11),), (dt.date(2023, 12, 22),), (dt.date(2024, 1, 12),)], "d date")
    assert [r[0] for r in d.select(semantic.period_label(F.col("d"), "2024-01-11", 10)).collect()] == ["Previous", "Selected", "Selected", "Not", "Not"]


def test_rows_are_denied_until_a_policy_exists(spark):
    d = spark.createDataFrame([(1, "eu"), (2, "us")], "id int, region string")
    assert access.row_filter(d, "region", {"a": ["eu"]}, "b").count() == 0
    assert access.row_filter(d, "region", {"a": ["eu"]}, "a").count() == 1


def test_repair_stops_or_gives_up(spark):
    d = spark.createDataFrame([(1, "aaab"), (2, "b")], "id int, s string")
    strip = [("strip", {"s": F.regexp_replace("s", "^a", "")})]
    out, status, applied, passes = quality.repair_until_stable(d, strip, F.col("s") == "b", 9)
    assert (status, passes, len(applied)) == ("repaired", 4, 3) and {r.s for r in out.collect()} == {"b"}
    assert quality.repair_until_stable(d, strip, F.col("s") == "b", 2)[1] == "manual_review"
    assert quality.repair_until_stable(d.where("id = 2"), strip, F.col("s") == "b", 2)[1] == "passed"
    assert quality.repair_until_stable(d.where("id = 2"), strip, F.col("s") == "z", 2)[1] == "manual_review"


def test_unreadable_payload_is_kept(spark):
    d = spark.createDataFrame([("c1", "not json")], "compilation string, payload string")
    r = ingest.dataform_objects(d, "p").first()
    assert r.incomplete and r.source_id == "p.dataform.compilation.c1"


def test_nested_columns_keep_their_order(spark):
    d = spark.createDataFrame([('[{"name":"a","type":"RECORD","mode":"REPEATED","fields":[{"name":"b","type":"FLOAT"}]},{"name":"c"}]',)], "j string")
    got = [(x.path, x.data_type, x.mode) for x in d.select(ingest.walk_columns(F.col("j")).alias("w")).first().w]
    assert got == [("a", "STRUCT", "REPEATED"), ("a.b", "FLOAT64", "NULLABLE"), ("c", "STRING", "NULLABLE")]


def test_nested_columns_of_any_depth(spark):
    text = '{"name":"c15","type":"STRING"}'
    for i in range(14, -1, -1):
        text = '{"name":"c%d","type":"RECORD","description":"a ] } [ in \\\\"text\\\\"","fields":[%s]}' % (i, text)
    text = text.replace("\\\\", "\\")
    d = spark.createDataFrame([("[" + text + "]",), ('[{"name":"a","type":"STRING"}]',), (None,)], "j string")
    assert [r[0] for r in d.select(ingest.column_levels(F.col("j"))).collect()] == [15, 0, 0]
    paths = [[x.path for x in r.w] for r in d.select(ingest.walk_columns(F.col("j")).alias("w")).collect()]
    assert len(paths[0]) == 16 and paths[0][-1] == ".".join(f"c{i}" for i in range(16)) and paths[1] == ["a"]
    with pytest.raises(Exception, match="nest deeper"):
        d.select(ingest.walk_columns(F.col("j"), 5)).collect()


def test_least_squares_from_statistics(spark):
    """Against numpy on the rows; a column that repeats another, and no rows at all."""
    import numpy as np
    r = np.random.default_rng(6)
    x = r.normal(size=(500, 3)) * [1, 100, 0.01] + [5, 1e4, 0]
    y = x @ [2.0, -0.3, 40.0] + 7 + r.normal(size=500)
    d = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, label double")
    want, _, _, _ = np.linalg.lstsq(np.column_stack([x, np.ones(500)]), y, rcond=None)
    got = training.linear_fit(d, ["a", "b", "c"])
    assert np.allclose([got[k] for k in ("a", "b", "c", "intercept")], want, rtol=1e-6)
    assert got["rmse"] == pytest.approx(np.sqrt(np.mean((y - np.column_stack([x, np.ones(500)]) @ want) ** 2)), rel=1e-6)
    twice = training.linear_fit(d.withColumn("e", F.col("a")), ["a", "e"])
    assert twice["a"] == pytest.approx(twice["e"]) and twice["rmse"] == pytest.approx(training.linear_fit(d, ["a"])["rmse"])
    assert set(training.linear_fit(d.limit(0), ["a"]).values()) == {0.0}


def test_metrics_pass_and_fail(spark):
    found = spark.createDataFrame([("A", "rmse", 1.0), ("B", "rmse", 1.2), ("C", "accuracy", 0.9), ("D", "accuracy", 0.5), ("E", "rmse", float("nan")), ("F", "rmse", 1.0)], "model_type string, metric string, value double")
    recorded = spark.createDataFrame([("A", "rmse", 1.1), ("B", "rmse", 1.1), ("C", "accuracy", 0.8), ("D", "accuracy", 0.8), ("E", "rmse", 1.0)], "model_type string, metric string, value double")
    status = lambda **kw: {r.model_type: r.status for r in training.compare_metrics(found, recorded, 0.01, **kw).collect()}
    assert status() == {"A": "failed", "B": "failed", "C": "failed", "D": "failed", "E": "failed", "F": "not_run"}
    assert status(one_sided=True) == {"A": "passed", "B": "failed", "C": "passed", "D": "failed", "E": "failed", "F": "not_run"}


def test_two_hundred_levels_of_columns(spark):
    text = '{"name":"c200","type":"STRING"}'
    for i in range(199, -1, -1):
        text = '{"name":"c%d","type":"RECORD","fields":[%s]}' % (i, text)
    d = spark.createDataFrame([("[" + text + "]",), ('[{"name":"a","type":"STRING"}]',)], "j string")
    paths = [[x.path for x in r.w] for r in d.select(ingest.walk_columns(F.col("j")).alias("w")).collect()]
    assert paths == [[".".join(f"c{i}" for i in range(n + 1)) for n in range(201)], ["a"]]


def test_models_score_in_a_session_that_ran_a_loop(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    graph.waves(nodes, spark.createDataFrame([("b", "a")], "child string, parent string")).collect()
    d = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 2)) for i in range(60)], "x double, y double, label double")
    for kind in ("LOGISTIC_REG", "LINEAR_REG", "RANDOM_FOREST_CLASSIFIER"):
        model = training.train(d, kind, ["x", "y"])
        assert model.transform(d).where("prediction is not null").count() == 60
        assert training.evaluate(model, d, kind).count() == 1


def test_recursion_goes_past_a_million_rows(spark, tmp_path):
    from carryover.plans import load
    from carryover.plans.registry import QUERIES
    load()
    keys = spark.range(1, 80_001).selectExpr("id as p_partkey").unionByName(spark.sql("select cast(null as bigint) as p_partkey"))
    keys.write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["recursive_cte"](spark, str(tmp_path))
    all_ = got.selectExpr("sum(steps) as s", "count(*) as n").first()
    assert all_.n == 80_001 and all_.s == 1 + sum(k.bit_length() for k in range(1, 80_001)) > 1_000_000
    assert got.where("start = 65536").first().depth == 16


def test_recursion_goes_past_a_hundred_rounds(spark):
    got = steps.recursive_union(spark.range(2), lambda d: d.where("id < 150").selectExpr("id + 1 as id"))
    assert got.count() == 151 + 150


def test_jobs_read_frames_that_are_written_once(spark, tmp_path, monkeypatch):
    """Each frame is written once, before the first fit, and vectors give the models that columns give."""
    from carryover.plans import learning, load
    from carryover.plans.registry import QUERIES
    load()
    spark.range(300).selectExpr("id as l_orderkey", "double(id % 50) as l_quantity", "if(id % 90 = 7, null, (id % 11) / 100D) as l_discount", "(id % 9) / 100D as l_tax",
                                "1000D + 30 * (id % 50) + id * 37 % 13 as l_extendedprice", "if(id % 50 > 30, 'R', 'N') as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(200).selectExpr("id % 20 as user_id", "concat('e', id % 4) as event_type", "double(id % 20 * (1 + id % 4)) as value").write.parquet(f"{tmp_path}/events.parquet")
    written = []
    monkeypatch.setattr(learning, "settle", lambda d, name="stage": written.append(name) or settle(d, name))
    with monkeypatch.context() as m:
        m.setattr(training, "train", lambda *a, **kw: 1 / 0)
        for name, frames in (("ml_evaluate", 3), ("ml_train_score", 5)):
            written.clear()
            with pytest.raises(ZeroDivisionError):
                QUERIES[name](spark, str(tmp_path))
            assert len(written) == frames and written.count("pairs") == 1
    d = training.features(spark.read.parquet(f"{tmp_path}/lineitem.parquet").withColumnRenamed("l_extendedprice", "y"), learning.LINE, "y").coalesce(1)
    for kind in ("LINEAR_REG", "BOOSTED_TREE_REGRESSOR"):
        a, b = (training.train(x, kind, learning.LINE).transform(x).select(*learning.LINE, "prediction") for x in (d, settle(training.assembled(d, learning.LINE), "vectors")))
        want, have = (sorted(map(tuple, x.collect())) for x in (a, b))
        assert len(want) == 296 and [x[:3] for x in have] == [x[:3] for x in want]
        assert [x[3] for x in have] == pytest.approx([x[3] for x in want])
