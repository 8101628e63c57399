"""DML, scripting and dynamic SQL as user-level jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions.canonical import money
from carryover.operators import dml, steps
from carryover.plans.registry import query
from carryover.session import settle


@query("dml_insert", """
    select s_suppkey, s_name, s_nationkey, s_acctbal from supplier union all
    select c_custkey + 1000000, c_name, c_nationkey, c_acctbal from customer where c_mktsegment = 'MACHINERY'""")
def dml_insert(t):
    rows = t.customer.where("c_mktsegment = 'MACHINERY'").select(
        (F.col("c_custkey") + 1000000).alias("s_suppkey"), F.col("c_name").alias("s_name"),
        F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("s_acctbal"))
    return dml.insert_rows(t.supplier, rows)


@query("dml_update", """
    select o_orderkey, case when o_orderstatus = 'P' and o_totalprice < 50000 then 'X' else o_orderstatus end as o_orderstatus,
        o_totalprice from orders""")
def dml_update(t):
    d = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return dml.update_where(d, F.expr("o_orderstatus = 'P' and o_totalprice < 50000"), o_orderstatus=F.lit("X"))


@query("dml_delete", """
    with o as (select o_orderkey, nullif(o_orderpriority, '1-URGENT') as p from orders)
    select o_orderkey, coalesce(p, 'none') as p from o where not coalesce(p = '5-LOW', false)""")
def dml_delete(t):
    d = t.orders.select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("p"))
    return dml.delete_where(d, F.col("p") == "5-LOW").select("o_orderkey", F.coalesce("p", F.lit("none")).alias("p"))


def _merge_sides(t):
    target = t.orders.where("o_orderdate < timestamp_ntz '1999-01-01'").select(
        "o_orderkey", "o_orderstatus", money("o_totalprice").cast("double").alias("price"))
    source = t.orders.where("o_orderdate >= timestamp_ntz '1998-01-01'").select(
        "o_orderkey", F.lit("N").alias("o_orderstatus"), (money("o_totalprice") + 1).cast("double").alias("price"),
        F.col("o_orderpriority"))
    return target, source


@query("merge_upsert", """
    with tgt as (select o_orderkey, o_orderstatus, o_totalprice as price from orders where o_orderdate < timestamp '1999-01-01'),
    src as (select o_orderkey, 'N' as s, (o_totalprice::decimal(18,2) + 1)::double as price, o_orderpriority = '5-LOW' as del
            from orders where o_orderdate >= timestamp '1998-01-01')
    select coalesce(tgt.o_orderkey, src.o_orderkey) as o_orderkey, coalesce(src.s, tgt.o_orderstatus) as o_orderstatus,
        coalesce(src.price, tgt.price) as price
    from tgt full join src on tgt.o_orderkey = src.o_orderkey where not coalesce(src.del, false)""")
def merge_upsert(t):
    target, source = _merge_sides(t)
    return dml.merge(target, source, ["o_orderkey"], delete=F.col("o_orderpriority") == "5-LOW")


@query("script_loop", """
    with recursive y as (select 1995 as yr, 0::bigint as total union all
        select yr + 1, total + (select count(*) from orders where year(o_orderdate) = yr) from y where yr <= 2001)
    select (yr - 1)::bigint as yr, total from y where yr > 1995""")
def script_loop(t):
    """DECLARE/SET/WHILE: one step per year appends a running total; the loop variable
    lives on the driver, the data never does."""
    spark = t.spark
    # Written once: every step of the loop reads the small table, not the orders.
    yearly = settle(t.orders.groupBy(F.year("o_orderdate").cast("long").alias("yr")).agg(F.count("*").alias("n")), "yearly")
    out, yr = None, 1995
    while yr <= 2001:
        step = spark.sql("select cast(:y as bigint) as yr, coalesce(sum(n), 0) as total from {d} where yr <= :y",
                         args={"y": yr}, d=yearly)
        out = step if out is None else out.unionByName(step)
        yr += 1
    return out


@query("script_exception", """
    select 'fallback' as branch, o_orderstatus, count(*)::bigint as n from orders group by all""")
def script_exception(t):
    agg = lambda b: t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.lit(b).alias("branch"), "o_orderstatus", "n")
    return steps.with_fallback(lambda: t.orders.select("no_such_column"), lambda e: agg("fallback"))


@query("dynamic_sql", """
    select 'customer' as name, count(*)::bigint as n from customer union all select 'orders', count(*) from orders
    union all select 'lineitem', count(*) from lineitem union all select 'events', count(*) from events""")
def dynamic_sql(t):
    names = ["customer", "orders", "lineitem", "events"]
    spark = t.register(*names, prefix="dyn_")
    parts = [spark.sql("select :n as name, count(*) as n from identifier('dyn_' || :n)", args={"n": n}) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("multi_statement", """
    with o as (select o_custkey, sum(o_totalprice::decimal(18,2)) as v from orders group by 1),
    c as (select c_nationkey, sum(v) as v, count(*) as n from o join customer on c_custkey = o_custkey group by 1)
    select n_name, v::double as v, n::bigint as n from c join nation on n_nationkey = c_nationkey""")
def multi_statement(t):
    frames = steps.run_statements(t.spark, [
        ("per_customer", "select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as v from {orders} group by 1"),
        ("per_nation", "select c_nationkey, sum(v) as v, count(*) as n from {per_customer} join {customer} on c_custkey = o_custkey group by 1"),
        ("final", "select n_name, cast(v as double) as v, n from {per_nation} join {nation} on n_nationkey = c_nationkey"),
    ], {"orders": t.orders, "customer": t.customer, "nation": t.nation})
    return frames["final"]
