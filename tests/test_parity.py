import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from carryover.functions.canonical import canonical_number
from carryover.operators import parity as P
from carryover.operators.bags import bag_diff, bag_intersect, bag_subtract

E = P.EVIDENCE


def ev(spark, *items):
    return spark.createDataFrame([("t", c, i, v, n) for c, i, v, n in items], E)


def status(spark, s, t):
    return {(r.check): r.status for r in P.check_status(P.compare_evidence(ev(spark, *s), ev(spark, *t))).collect()}


@pytest.mark.parametrize("s,t,want", [
    ([("row_count", "rows", "5", 5)], [("row_count", "rows", "5", 5)], "passed"),
    ([("row_count", "rows", "5", 5)], [("row_count", "rows", "4", 4)], "failed"),
    ([("row_count", "rows", "5", 5)], [("aggregate", "a.sum", "1", 5)], "not_run"),
    ([("row_count", "rows", "-1", 5)], [("row_count", "rows", "-1", 5)], "not_run"),
    ([("row_count", "rows", "true", 5)], [("row_count", "rows", "true", 5)], "not_run"),
    ([("row_count", "rows", None, 5)], [("row_count", "rows", "5", 5)], "not_run"),
    ([("null_distribution", "c", "9", 5)], [("null_distribution", "c", "1", 5)], "not_run"),
    ([("null_distribution", "c", "1", 5)], [("null_distribution", "d", "1", 5)], "failed"),
    ([("aggregate", "a.sum", None, 5), ("aggregate", "b.sum", "1", 5)], [("aggregate", "b.sum", "1", 5)], "failed"),
    ([("aggregate", "a.sum", None, 5)], [("aggregate", "a.sum", None, 5)], "passed"),
    ([("checksum", "algorithm", "x", 1), ("checksum", "ordering", "key", 1), ("checksum", "value", "1", 1)],
     [("checksum", "algorithm", "x", 1), ("checksum", "ordering", "none", 1), ("checksum", "value", "1", 1)], "failed"),
    ([("checksum", "algorithm", "x", 1), ("checksum", "ordering", None, 1), ("checksum", "value", "1", 1)],
     [("checksum", "algorithm", "x", 1), ("checksum", "ordering", "key", 1), ("checksum", "value", "1", 1)], "not_run"),
])
def test_check_status(spark, s, t, want):
    assert status(spark, s, t)[s[0][0]] == want


def test_table_status_precedence_and_declared(spark):
    checks = spark.createDataFrame([("a", "x", "failed"), ("a", "y", "not_run"), ("b", "x", "not_run"), ("b", "y", "passed"),
                                    ("c", "x", "passed"), ("c", "y", "not_applicable"), ("d", "x", "not_applicable")], "table string, check string, status string")
    objects = spark.createDataFrame([("a", "table", "passed"), ("b", "table", None), ("c", "view", "passed"), ("d", "table", None),
                                     ("e", "table", "passed"), ("f", "routine", None)], "table string, kind string, declared string")
    got = {r.table: (r.status, r.declared_status) for r in P.table_status(checks, objects).collect()}
    assert got == {"a": ("failed", "passed"), "b": ("not_run", None), "c": ("passed", None), "d": ("not_applicable", None),
                   "e": ("not_run", "passed"), "f": ("not_applicable", None)}


def test_parity_of_itself_passes_in_any_order(spark):
    d = spark.createDataFrame([(i, f"n{i % 3}", None if i % 4 == 0 else i * 1.5) for i in range(50)], "id long, name string, v double")
    shuffled = d.orderBy(F.rand(3)).repartition(7)
    assert {r.status for r in P.parity_report(d, shuffled, "t").collect()} == {"passed"}
    assert P.row_diff(d, shuffled, ["id"]).count() == 0


@pytest.mark.parametrize("kind, a, b", [
    ("x timestamp_ntz", [(dt.datetime(2024, 1, 1, 0, 0, 0, 100_000),)], [(dt.datetime(2024, 1, 1, 0, 0, 0, 900_000),)]),
    ("x double", [(1.001,)], [(1.004,)]), ("x double", [(0.1 + 0.2,)], [(0.3,)]), ("x float", [(1.0,)], [(1.0000001,)]),
    ("x string, y string", [("a|b", "c")], [("a", "b|c")]), ("x string", [(None,)], [("~",)]), ("x string", [(None,)], [("-",)]),
    ("x string, y string", [(None, "a")], [("a", None)]), ("x string, y string", [("1:a", "b")], [("1:a1", ":b")]),
    ("x struct<a:string,b:string>", [((None, "v"),)], [(("v", None),)]), ("x struct<t:timestamp_ntz>", [((dt.datetime(2024, 1, 1, 0, 0, 0, 1),),)], [((dt.datetime(2024, 1, 1),),)]),
    ("x binary", [(b"\x00",)], [(b"00",)]), ("x int", [(1,), (1,)], [(1,), (1,), (1,)]),
])
def test_digest_sees_every_difference(spark, kind, a, b):
    a, b = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    got = {r.item: r.status for r in P.parity_report(a, b, "t", checks=("checksum",)).collect()}
    assert got["value"] == "failed"
    same = {r.status for r in P.parity_report(a, a.repartition(2), "t", checks=("checksum",)).collect()}
    assert same == {"passed"}


def test_digest_takes_equal_values_as_equal(spark):
    a = spark.sql("select cast(100.50 as decimal(9,2)) as x, map('a', 1, 'b', 2) as m")
    b = spark.sql("select cast(100.5 as decimal(12,4)) as x, map('b', 2, 'a', 1) as m")
    assert {r.status for r in P.parity_report(a, b, "t", checks=("checksum",)).collect()} == {"passed"}


NESTED = "named_struct('m', map({0}), 'a', array(named_struct('d', cast({1} as decimal({2})), 'f', cast({3} as double))))"


@pytest.mark.parametrize("a,b,want", [
    (("'x', 1, 'y', 2", "1.50", "9,2", "0.0"), ("'y', 2, 'x', 1", "1.5", "12,1", "-0.0"), "passed"),
    (("'x', 1, 'y', 2", "1.50", "9,2", "0.1"), ("'x', 2, 'y', 1", "1.50", "9,2", "0.1"), "failed"),
    (("'x', 1", "1.50", "9,2", "0.1"), ("'x', 1", "1.51", "9,2", "0.1"), "failed"),
    (("'x', 1", "1.50", "9,2", "0.1"), ("'x', 1", "1.50", "9,2", "0.1 + 1e-17 + 1e-16"), "failed"),
    (("'x', null", "1.50", "9,2", "0.1"), ("'x', 0", "1.50", "9,2", "0.1"), "failed"),
    (("'x', 1", "null", "9,2", "0.1"), ("'x', 1", "0", "9,2", "0.1"), "failed"),
])
def test_digest_of_nested_values(spark, a, b, want):
    """Order of map entries, scale and sign of zero do not count, at any depth; the rest does."""
    a, b = (spark.sql(f"select array({NESTED.format(*x)}) as n") for x in (a, b))
    assert {r.item: r.status for r in P.parity_report(a, b, "t", checks=("checksum",)).collect()}["value"] == want


def test_digest_of_deep_types_stays_small(spark):
    kind = "int"
    for i in range(25):
        kind = f"struct<a{i}:array<{kind}>>"
    d = spark.createDataFrame([(None,)], f"x {kind}")
    assert {r.status for r in P.parity_report(d, d, "t", checks=("checksum",)).collect()} == {"passed"}


def test_row_diff_sees_where_nulls_are(spark):
    """Two copies of (null, 7) are not two copies of (7, null); nor is one of each."""
    kind = "k int, x int, y int"
    a = spark.createDataFrame([(1, None, 7), (1, None, 7), (2, None, 7), (3, None, 7), (3, 7, None), (4, None, None)], kind)
    b = spark.createDataFrame([(1, 7, None), (1, 7, None), (2, 7, None), (3, 7, None), (3, None, 7), (4, None, None)], kind)
    assert sorted((r.k, r.op, r.changed) for r in P.row_diff(a, b, ["k"]).collect()) == [(1, "bag", ""), (2, "changed", "x,y")]


def test_row_diff_compares_values_not_types(spark):
    a = spark.sql("select 1 as k, cast(1.50 as decimal(9,2)) as d, map('a', 1, 'b', 2) as m, 5 as i")
    b = spark.sql("select 1L as k, cast(1.5 as decimal(12,1)) as d, map('b', 2, 'a', 1) as m, 5L as i")
    assert P.row_diff(a, b, ["k"]).count() == 0
    c = spark.sql("select 1L as k, cast(1.5 as decimal(12,1)) as d, map('b', 1, 'a', 2) as m, 6L as i")
    assert [tuple(r) for r in P.row_diff(a, c, ["k"]).collect()] == [(1, "changed", "m,i")]


def test_row_diff_takes_null_keys_and_key_only_tables(spark):
    a = spark.createDataFrame([(None, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(None, "x"), (1, "z")], "k int, v string")
    assert [(r.k, r.op, r.changed) for r in P.row_diff(a, b, ["k"]).collect()] == [(1, "changed", "v")]
    assert [(r.k, r.op) for r in P.row_diff(a.select("k"), b.select("k").where("k = 1"), ["k"]).collect()] == [(None, "missing")]


def test_canonical_number(spark):
    d = spark.createDataFrame([("100.50",), ("100.5",), ("007",), ("abc",), (None,), ("0.0",), ("1200",)], "x string")
    assert [r[0] for r in d.select(canonical_number(F.col("x"))).collect()] == ["100.5", "100.5", "7", "abc", None, "0", "1200"]


def test_row_diff_names_columns_and_falls_back_to_bags(spark):
    s = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 4), (4, "d", 4), (5, "e", 5), (5, "f", 5)], "k int, x string, y int")
    t = spark.createDataFrame([(1, "a", 1), (2, "B", 9), (6, "z", 6), (4, "d", 4), (5, "f", 5), (5, "e", 5)], "k int, x string, y int")
    got = {r.k: (r.op, r.changed) for r in P.row_diff(s, t, ["k"]).collect()}
    assert got == {2: ("changed", "x,y"), 3: ("missing", ""), 6: ("extra", ""), 4: ("bag", "")}


def test_bags(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    assert rows(bag_subtract(a, b)) == rows(a.exceptAll(b))
    assert rows(bag_intersect(a, b)) == rows(a.intersectAll(b))
    diff = {(r.x, r.side): r.copies for r in bag_diff(a, b).collect()}
    assert diff == {(1, "source"): 2, (2, "target"): 1}


def test_ingest_rejects_foreign_and_tampered(spark):
    checks = spark.createDataFrame([("a", "a:row_count", "row_count", ["rows"], ""), ("b", "b:row_count", "row_count", ["rows"], "")],
                                   "source_id string, query_id string, check string, items array<string>, skipped string")
    res = lambda pid: spark.createDataFrame([(pid, "a:row_count", "rows", "1", "1"), (pid, "zz", "rows", "1", "1")], "pack_id string, query_id string, item string, source string, target string")
    per, err = P.ingest_results(checks, res("p"), "p", "p")
    assert {r.source_id: r.status for r in per.collect()} == {"a": "passed", "b": "not_run"}
    assert [r.error for r in err.collect()] == ["unknown query id"]
    for args in (("p", "tampered"),):
        per, err = P.ingest_results(checks, res("p"), *args)
        assert {r.status for r in per.collect()} == {"not_run"} and err.count() == 2
    per, err = P.ingest_results(checks, res("other"), "p", "p")
    assert {r.status for r in per.collect()} == {"not_run"} and err.count() >= 2


def test_schema_evidence_is_recursive(spark):
    a = spark.createDataFrame([], "id long, s struct<x:int, y:array<struct<z:string>>>")
    b = spark.createDataFrame([], "id long, s struct<x:int, y:array<struct<z:int>>>")
    d = P.compare_evidence(P.table_evidence(a, "t", ("schema",)), P.table_evidence(b, "t", ("schema",)))
    assert [r.item for r in d.where("status = 'failed'").collect()] == ["s.y.z.data_type"]


def test_pack_id_ignores_order_and_sees_changes(spark):
    c = spark.createDataFrame([("a:x", ["p", "q"]), ("b:x", ["r"])], "query_id string, items array<string>")
    one = P.pack_id(c).first()[0]
    assert len(one) == 16 and one == P.pack_id(c.orderBy(F.desc("query_id"))).first()[0]
    assert one != P.pack_id(c.withColumn("items", F.array(F.lit("p")))).first()[0]
