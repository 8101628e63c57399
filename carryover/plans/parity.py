"""Parity and drift queries. The target is a copy of ``orders`` with faults a real move
makes: a late slice is lost, cents are cut off, a code turns into null."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions.canonical import money
from carryover.operators import parity as P
from carryover.operators.dml import change_set
from carryover.operators.typemap import normal_type
from carryover.plans.registry import query
from carryover.sources.estate import COLUMNS_SQL, OBJECTS_SQL, TYPE_CASE_SQL, estate_columns, estate_objects


def source_orders(t):
    return t.orders.withColumn("o_totalprice", money("o_totalprice"))


def target_orders(t):
    lost = "o_orderdate >= timestamp_ntz '2001-07-01' and o_orderstatus = 'O'"
    p = F.col("o_totalprice")
    return source_orders(t).where(f"not ({lost})").withColumns({
        "o_totalprice": F.when(F.col("o_orderstatus") == "P", F.floor(p).cast("decimal(18,2)")).otherwise(p),
        "o_orderpriority": F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))})


SIDES = """
    with src as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice::decimal(18,2) as o_totalprice, o_orderdate, o_orderpriority from orders),
    tgt as (select o_orderkey, o_custkey, o_orderstatus, case when o_orderstatus = 'P' then floor(o_totalprice)::decimal(18,2) else o_totalprice end as o_totalprice,
        o_orderdate, nullif(o_orderpriority, '4-NOT SPECIFIED') as o_orderpriority from src
        where not (o_orderdate >= timestamp '2001-07-01' and o_orderstatus = 'O'))"""

COLS = ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
EXACT = ["o_orderkey", "o_custkey", "o_totalprice"]


def _dec(x):
    return f"regexp_replace(regexp_replace({x}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"




def netstring(x):
    """A value as the digest writes it: its length, a colon, its text; a null is ``-``."""
    return f"coalesce(length({x})::varchar || ':' || {x}, '-')"


_ROW = " || ".join(netstring(x) for x in (
    "o_custkey::varchar", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')", "o_orderkey::varchar", "o_orderpriority", "o_orderstatus", _dec("o_totalprice::varchar")))
_DIGEST = f"sum(('0x' || substr(md5({_ROW}), 1, 15))::bigint)::varchar"


def _sql(check, pairs):
    """Long-form comparison of (item, expression) pairs over src and tgt."""
    parts = [f"select 'orders' as \"table\", '{check}' as \"check\", '{i}' as item, (select {e} from src) as source, (select {e} from tgt) as target"
             for i, e in pairs]
    return " union all ".join(parts)


ROWS = [("rows", "count(*)::varchar")]
NULLS = [(c, f"count_if({c} is null)::varchar") for c in COLS]
AGGS = [(f"{c}.{f}", _dec(f"{f}({c})::varchar")) for c in EXACT for f in ("sum", "min", "max")]
SUMS = [("algorithm", "any_value('sum-md5-60-netstring-2')"), ("ordering", "any_value('order-free')"), ("value", _DIGEST)]
STATUS = "case when source is not distinct from target then 'passed' else 'failed' end as status"


def _wrap(body):
    return f"{SIDES}, r as ({body}) select *, {STATUS} from r"


# What the tables' own catalog says of them, in our names of types.
_TYPES = ("case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' "
          "when 'TIMESTAMP' then 'timestamp_ntz' else column_type end")
_COLUMNS = f"(select column_name as c, {_TYPES} as dt from (describe select * from orders))"
_SCHEMA = f"""select 'orders' as "table", 'schema' as "check", c || '.' || unnest(['data_type', 'nullable', 'mode']) as item,
    unnest([if(c = 'o_totalprice', 'decimal(18,2)', dt), 'true', 'NULLABLE']) as source, unnest([if(c = 'o_totalprice', 'decimal(18,2)', dt), 'true', 'NULLABLE']) as target
    from {_COLUMNS}"""
_TAKEN = "('0x' || substr(md5(o_orderkey::varchar), 1, 7))::bigint % 100 < 25"
SAMPLE = [("o_orderkey.25.rows", f"count_if({_TAKEN})::varchar"), ("o_orderkey.25.digest", f"(sum(('0x' || substr(md5({_ROW}), 1, 15))::bigint) filter (where {_TAKEN}))::varchar")]
_RESULT = "select year(o_orderdate) as y, o_orderstatus as s, count(*) as n, sum(o_totalprice) as v from {d} group by 1, 2"
_RESULT_ROW = " || ".join(netstring(x) for x in ("n::varchar", "s", _dec("v::varchar"), "y::varchar"))
_RESULTS = " union all ".join(
    f"""select 'orders', 'sql_result', 'by_year.{i}', (select {e} from ({_RESULT.format(d='src')})), (select {e} from ({_RESULT.format(d='tgt')}))"""
    for i, e in (("rows", "count(*)::varchar"), ("digest", f"sum(('0x' || substr(md5({_RESULT_ROW}), 1, 15))::bigint)::varchar")))
ALL = " union all ".join([_sql("row_count", ROWS), _sql("null_distribution", NULLS), _sql("aggregate", AGGS), _sql("checksum", SUMS),
                          _SCHEMA, _sql("sample", SAMPLE), _RESULTS])


@query("parity_report", _wrap(ALL))
def parity_report(t):
    """All seven checks."""
    return P.parity_report(source_orders(t), target_orders(t), "orders", checks=P.ONE_PASS, sample=("o_orderkey", 25), queries={"by_year": _RESULT})


def _one(check):
    def run(t):
        return P.parity_report(source_orders(t), target_orders(t), "orders", checks=(check,))
    return run


query("parity_row_count", _wrap(_sql("row_count", ROWS)))(_one("row_count"))
query("parity_null_distribution", _wrap(_sql("null_distribution", NULLS)))(_one("null_distribution"))
query("parity_aggregate", _wrap(_sql("aggregate", AGGS)))(_one("aggregate"))
query("parity_checksum", _wrap(_sql("checksum", SUMS)))(_one("checksum"))


@query("parity_schema", f"""
    with s as (select c, dt from {_COLUMNS}), t as (select c, if(c = 'o_custkey', 'string', dt) as dt from s where c <> 'o_orderpriority'),
    a as (select c || '.' || unnest(['data_type', 'nullable', 'mode']) as item, unnest([dt, 'true', 'NULLABLE']) as v from s),
    b as (select c || '.' || unnest(['data_type', 'nullable', 'mode']) as item, unnest([dt, 'true', 'NULLABLE']) as v from t)
    select 'orders' as "table", 'schema' as "check", item, a.v as source, coalesce(b.v, '-') as target, if(a.v is not distinct from b.v, 'passed', 'failed') as status
    from a left join b using (item)
    union all select 'orders', 'row_count', 'rows', count(*)::varchar, count(*)::varchar, 'passed' from orders""")
def parity_schema(t):
    target = t.orders.withColumn("o_custkey", F.col("o_custkey").cast("string")).drop("o_orderpriority")
    return P.parity_report(t.orders, target, "orders", checks=("schema", "row_count")).na.fill("-", ["target"])


@query("parity_sample", SIDES + """
    , s as (select * from src where ('0x' || substr(md5(o_orderkey::varchar), 1, 7))::bigint % 100 < 25),
    g as (select * from tgt where ('0x' || substr(md5(o_orderkey::varchar), 1, 7))::bigint % 100 < 25)
    select o_orderkey, o_totalprice::double as o_totalprice, coalesce(o_orderpriority, '~') as o_orderpriority, side, copies::bigint as copies from (
      select o_orderkey, o_totalprice, o_orderpriority, 'source' as side, count(*) as copies from (select * from s except all select * from g) group by all
      union all select o_orderkey, o_totalprice, o_orderpriority, 'target', count(*) from (select * from g except all select * from s) group by all)""")
def parity_sample(t):
    d = P.parity_sample(source_orders(t), target_orders(t), "o_orderkey", 25)
    return d.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"),
                    F.coalesce("o_orderpriority", F.lit("~")).alias("o_orderpriority"), "side", "copies")


@query("parity_sql_result", SIDES + """
    , a as (""" + _RESULT.format(d="src") + "), b as (" + _RESULT.format(d="tgt") + """)
    select y::bigint as y, s, n::bigint as n, v::double as v, 'source' as side from (select * from a except all select * from b)
    union all select y, s, n, v::double, 'target' from (select * from b except all select * from a)""")
def parity_sql_result(t):
    run = lambda d: t.spark.sql(_RESULT, d=d)
    d = P.bag_diff(run(source_orders(t)), run(target_orders(t)))
    return d.select(F.col("y").cast("long").alias("y"), "s", "n", F.col("v").cast("double").alias("v"), "side")


@query("parity_status", OBJECTS_SQL + """
    select source_id as "table", kind, case when parity_status = 'not_applicable' then 'not_applicable' else parity_status end as status,
        case when coalesce(declared, '-') <> parity_status then coalesce(declared, '-') else '-' end as declared_status
    from (select *, case when k % 2 = 0 then 'passed' end as declared from estate_objects)""")
def parity_status(t):
    o = estate_objects(t).select(F.col("source_id").alias("table"), "kind", "parity_status",
                                 F.when(F.col("k") % 2 == 0, "passed").alias("declared"))
    checks = o.where("parity_status <> 'not_applicable'").select(
        "table", F.explode(F.array(F.lit("row_count"), F.lit("aggregate"))).alias("check"), "parity_status")
    checks = checks.select("table", "check", F.when(F.col("check") == "aggregate", F.col("parity_status")).otherwise("passed").alias("status"))
    return P.table_status(checks, o.select("table", "kind", "declared")).na.fill("-", ["declared_status"])


# Each table and the column whose values its copy loses in some rows: every pair of sides differs.
_PACK = {"region": "r_name", "nation": "n_regionkey", "customer": "c_mktsegment", "supplier": "s_name", "part": "p_size", "lineitem": "l_returnflag", "events": "event_type",
         "documents": "lang", "labels": "quality", "conversations": "role", "pages": "url", "benchmark": "text"}
_PACK_KEY = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "lineitem": "l_orderkey", "events": "event_id",
             "documents": "doc_id", "labels": "doc_id", "conversations": "conv_id", "pages": "page_id", "benchmark": "item_id"}
#: Columns that the aggregate check covers, so that their loss may show there too.
_PACK_NUMBERS = {"nation": "n_regionkey", "part": "p_size", "labels": "quality"}


def _pack_sql(name, column):
    """Items of a table, and how many of them the loss of ``column`` in every third key changes."""
    flat = f"(select count(*) from (describe select * from {name}))"
    exact = f"(select count(*) from (describe select * from {name}) where column_type in ('BIGINT', 'INTEGER', 'SMALLINT') or column_type like 'DECIMAL%')"
    lost = f"if({_PACK_KEY[name]} % 3 = 0, null, {column})"
    failed = f"count_if({column} is null) is distinct from count_if({lost} is null)"
    failed = f"({failed})::int"
    if name in _PACK_NUMBERS:
        failed += "".join(f" + ({f}({column}) is distinct from {f}({lost}))::int" for f in ("sum", "min", "max"))
    return f"select '{name}' as \"table\", count(*)::bigint as rows, (1 + {flat} + 3 * {exact})::bigint as items, ({failed})::bigint as failed from {name}"


@query("parity_pack", SIDES + " " + " union all ".join(_pack_sql(n, c) for n, c in _PACK.items()) + """
    union all select 'orders', (select count(*) from src), 16, (select count_if(source is distinct from target) from (""" + " union all ".join(
        [_sql("row_count", ROWS), _sql("null_distribution", NULLS), _sql("aggregate", AGGS)]) + "))")
def parity_pack(t):
    def damaged(name, column):
        d = getattr(t, name)
        return d.withColumn(column, F.when(F.col(_PACK_KEY[name]) % 3 != 0, F.col(column)))

    tables = {n: (getattr(t, n), damaged(n, c)) for n, c in _PACK.items()}
    tables["orders"] = (source_orders(t), target_orders(t))
    tables["bad-name"] = (t.region, t.region)
    rows, _ = P.build_pack(tables)
    rows_n = F.max(F.when(F.col("check") == "row_count", F.col("source").cast("long")))
    return rows.groupBy("table").agg(rows_n.alias("rows"), F.count("*").alias("items"), F.count_if(F.col("status") == "failed").alias("failed"))


_FLAT = f"(mode <> 'REPEATED' and {TYPE_CASE_SQL['norm']} not in ('STRUCT', 'ARRAY', 'JSON', 'GEOGRAPHY'))"
_NUM = f"({_FLAT} and {TYPE_CASE_SQL['norm']} in ('INT64', 'NUMERIC', 'BIGNUMERIC'))"


@query("parity_ingest", COLUMNS_SQL.replace("with estate_columns", OBJECTS_SQL.strip() + ", estate_columns") + f"""
    , c as (select source_id, count_if({_FLAT}) as flat, count_if({_NUM}) as num from estate_columns group by 1),
    o as (select o.*, coalesce(flat, 0) as flat, coalesce(num, 0) as num from estate_objects o left join c using (source_id) where parity_status <> 'not_applicable')
    select source_id || ':row_count' as query_id, parity_status as status, '-' as error from o
    union all select source_id || ':null_distribution', 'not_run', '-' from o where flat > 0
    union all select source_id || ':aggregate', 'not_run', '-' from o where num > 0
    union all select source_id || ':no_such_check', 'rejected', 'unknown query id' from estate_objects where parity_status = 'not_applicable'""")
def parity_ingest(t):
    o = estate_objects(t)
    cols = estate_columns(t).withColumn("source_type", normal_type(F.col("data_type")))
    checks = P.pack_checks(o, cols)
    # Collected results: row counts that agree, differ or miss a side; other ids are unknown.
    known = o.where("parity_status <> 'not_applicable'").select(
        F.concat_ws(":", "source_id", F.lit("row_count")).alias("query_id"), F.lit("rows").alias("item"), F.lit("10").alias("source"),
        F.when(F.col("parity_status") == "passed", "10").when(F.col("parity_status") == "failed", "9").alias("target"))
    unknown = o.where("parity_status = 'not_applicable'").select(
        F.concat_ws(":", "source_id", F.lit("no_such_check")).alias("query_id"), F.lit("rows").alias("item"), F.lit("1").alias("source"), F.lit("1").alias("target"))
    results = known.unionByName(unknown).withColumn("pack_id", F.lit("p1"))
    per, errors = P.ingest_results(checks, results, "p1", "p1")
    return per.select(F.concat_ws(":", "source_id", "check").alias("query_id"), "status", F.lit("-").alias("error")).unionByName(
        errors.select("query_id", F.lit("rejected").alias("status"), "error"))


@query("parity_row_diff", SIDES + """
    select coalesce(s.o_orderkey, g.o_orderkey) as o_orderkey, case when g.o_orderkey is null then 'missing' else 'changed' end as op,
        case when g.o_orderkey is null then '' else concat_ws(',', case when s.o_totalprice <> g.o_totalprice then 'o_totalprice' end,
            case when s.o_orderpriority is distinct from g.o_orderpriority then 'o_orderpriority' end) end as changed
    from src s left join tgt g on s.o_orderkey = g.o_orderkey
    where g.o_orderkey is null or s.o_totalprice <> g.o_totalprice or s.o_orderpriority is distinct from g.o_orderpriority""")
def parity_row_diff(t):
    return P.row_diff(source_orders(t), target_orders(t), ["o_orderkey"])


# Orders by key with a value that sits in one of two columns; in every 50th order it changes places.
_LINES = """with src as (select l_orderkey, if(l_linenumber % 2 = 0, l_partkey, null) as a, if(l_linenumber % 2 = 0, null, l_partkey) as b from lineitem),
    tgt as (select l_orderkey, if(l_orderkey % 50 = 0, b, a) as a, if(l_orderkey % 50 = 0, a, b) as b from src)"""


@query("parity_row_diff_bags", _LINES + """,
    n as (select l_orderkey, count(*) as n from src group by 1),
    diff as (select l_orderkey from (select * from src except all select * from tgt) group by 1)
    select l_orderkey, if(n = 1, 'changed', 'bag') as op, if(n = 1, 'a,b', '') as changed from n join diff using (l_orderkey)""")
def parity_row_diff_bags(t):
    d = t.lineitem
    src = d.select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("a"), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_partkey")).alias("b"))
    moved = F.col("l_orderkey") % 50 == 0
    tgt = src.select("l_orderkey", F.when(moved, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(moved, F.col("a")).otherwise(F.col("b")).alias("b"))
    return P.row_diff(src, tgt, ["l_orderkey"])


def _nested_row(month):
    """The canonical form of the nested column and the key."""
    price, whole = _dec("o_totalprice::decimal(18,2)::varchar"), _dec("floor(o_totalprice)::decimal(18,2)::varchar")
    return (f"'[2:4:half(-' || {netstring(whole)} || ')5:total([2:' || {netstring('year(o_orderdate)::varchar')} || {netstring(month)} || ']' || {netstring(price)} || ')]' || "
            + netstring("o_orderkey::varchar"))


def _nested_digest(month):
    return f"(select sum(('0x' || substr(md5({_nested_row(month)}), 1, 15))::bigint)::varchar from orders)"


@query("parity_checksum_nested", f"""
    with d as (select {_nested_digest('month(o_orderdate)::varchar')} as s, {_nested_digest('(month(o_orderdate) + (o_orderkey % 97 = 0)::int)::varchar')} as p)
    select 'same' as "table", 'value' as item, s as source, s as target, 'passed' as status from d
    union all select 'planted', 'value', s, p, 'failed' from d""")
def parity_checksum_nested(t):
    """Maps that are filled in another order and decimals of another scale are equal; a
    difference three levels down is one."""
    def table(d, first, second, scale, month):
        entry = {"total": f"'total', named_struct('days', array(year(o_orderdate), {month}), 'price', cast(o_totalprice as decimal(20,{scale})))",
                 "half": f"'half', named_struct('days', cast(null as array<int>), 'price', cast(floor(o_totalprice) as decimal(20,{scale})))"}
        return d.selectExpr("o_orderkey", f"map({entry[first]}, {entry[second]}) as n")

    d = source_orders(t)
    source = table(d, "total", "half", 2, "month(o_orderdate)")
    same = table(d, "half", "total", 4, "month(o_orderdate)")
    planted = table(d, "half", "total", 4, "month(o_orderdate) + if(o_orderkey % 97 = 0, 1, 0)")
    out = P.union([P.parity_report(source, x, name, checks=("checksum",)) for name, x in (("same", same), ("planted", planted))])
    return out.where("item = 'value'").select("table", "item", "source", "target", "status")


@query("parity_bag_diff", """
    with tgt as (select l_orderkey, l_partkey, l_linenumber, l_quantity, case when l_returnflag = 'N' and l_discount = 0.1 then 'n' else l_returnflag end as l_returnflag from lineitem),
    src as (select l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag from lineitem)
    select *, 'source' as side, count(*)::bigint as copies from (select * from src except all select * from tgt) group by all
    union all select *, 'target', count(*)::bigint from (select * from tgt except all select * from src) group by all""")
def parity_bag_diff(t):
    cols = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"]
    flag = F.when((F.col("l_returnflag") == "N") & (F.col("l_discount") == 0.1), "n").otherwise(F.col("l_returnflag"))
    return P.bag_diff(t.lineitem.select(*cols), t.lineitem.withColumn("l_returnflag", flag).select(*cols))


@query("unnest_multiplicity", """
    select label::bigint as label, count(*)::bigint as parents, sum(len(embedding))::bigint as expected, sum(len(embedding))::bigint as exploded, true as matches
    from embeddings group by 1""")
def unnest_multiplicity(t):
    e = t.embeddings
    a = e.groupBy("label").agg(F.count("*").alias("parents"), F.sum(F.size("embedding")).alias("expected"))
    b = e.select("label", F.explode("embedding")).groupBy("label").agg(F.count("*").alias("exploded"))
    return a.join(b, "label", "left").select(F.col("label").cast("long").alias("label"), "parents", "expected", "exploded",
                                             (F.col("expected") == F.col("exploded")).alias("matches"))


@query("estate_drift", OBJECTS_SQL + """
    , b as (select * from estate_objects where kind <> 'dbt_project'), a as (select * from estate_objects where kind <> 'stream')
    select source_id, case when kind = 'dbt_project' then 'added' when kind = 'stream' then 'removed' else 'changed' end as op,
        case when kind = 'table' then concat_ws(',', case when size_bytes is not null then 'size_bytes' end, 'properties.reviewed')
            else '' end as fields from estate_objects where kind in ('dbt_project', 'stream', 'table')""")
def estate_drift(t):
    o = estate_objects(t)
    before = o.where("kind <> 'dbt_project'")
    table = F.col("kind") == "table"
    after = o.where("kind <> 'stream'").withColumns({
        "size_bytes": F.when(table, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")),
        "properties": F.when(table, F.map_concat("properties", F.create_map(F.lit("reviewed"), F.lit("true")))).otherwise(F.col("properties"))})
    return P.estate_drift(before, after)


@query("snapshot_diff", SIDES + """
    select coalesce(s.o_orderkey, g.o_orderkey) as o_orderkey, case when g.o_orderkey is null then 'delete' else 'update' end as op,
        coalesce(case when g.o_orderkey is null then s.o_orderpriority else g.o_orderpriority end, '~') as o_orderpriority,
        (case when g.o_orderkey is null then s.o_totalprice else g.o_totalprice end)::double as o_totalprice
    from src s left join tgt g on s.o_orderkey = g.o_orderkey
    where g.o_orderkey is null or s.o_totalprice <> g.o_totalprice or s.o_orderpriority is distinct from g.o_orderpriority""")
def snapshot_diff(t):
    cols = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    d = change_set(source_orders(t).select(*cols), target_orders(t).select(*cols), ["o_orderkey"])
    return d.select("o_orderkey", "op", F.coalesce("o_orderpriority", F.lit("~")).alias("o_orderpriority"),
                    F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("schema_drift", COLUMNS_SQL + """
    select source_id, path, case when mode = 'REPEATED' then 'removed' else 'data_type' end as change from estate_columns
    where mode = 'REPEATED' or data_type = 'INT64'""")
def schema_drift(t):
    c = estate_columns(t).select("source_id", "path", "data_type", "mode")
    later = c.where("mode <> 'REPEATED'").withColumn("data_type", F.when(F.col("data_type") == "INT64", "NUMERIC").otherwise(F.col("data_type")))
    d = change_set(c, later, ["source_id", "path"])
    return d.select("source_id", "path", F.when(F.col("op") == "delete", "removed").when(F.col("op") == "insert", "added").otherwise("data_type").alias("change"))
