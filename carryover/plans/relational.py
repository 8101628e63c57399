"""Projections, predicates, joins, aggregations, sorting, set operations and CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions.canonical import md5_bucket, money
from carryover.operators.lookups import broadcast_if_small, lookup_join
from carryover.operators.reshape import star_replace, unpivot_long
from carryover.operators.steps import recursive_union
from carryover.plans.registry import query
from carryover.session import spread

# ---------------------------------------------------------------- projections, predicates


@query("select_where", """
    select o_orderkey, o_totalprice, o_orderpriority from orders
    where o_orderstatus = 'F' and o_totalprice > 250000""")
def select_where(t):
    return t.orders.where("o_orderstatus = 'F' and o_totalprice > 250000").select(
        "o_orderkey", "o_totalprice", "o_orderpriority")


@query("select_star_except", "select * exclude (c_acctbal, c_nationkey) from customer")
def select_star_except(t):
    return t.customer.drop("c_acctbal", "c_nationkey")


@query("select_star_replace", """
    select * replace (upper(c_mktsegment[:4]) as c_mktsegment, c_nationkey + 100 as c_nationkey) from customer""")
def select_star_replace(t):
    return star_replace(t.customer, c_mktsegment=F.upper(F.substring("c_mktsegment", 1, 4)),
                        c_nationkey=F.col("c_nationkey") + 100)


@query("case_expr", """
    select o_orderkey, case when o_totalprice >= 400000 then 'large'
        when o_totalprice >= 100000 then 'medium' else 'small' end as size_band from orders""")
def case_expr(t):
    p = F.col("o_totalprice")
    band = F.when(p >= 400000, "large").when(p >= 100000, "medium").otherwise("small")
    return t.orders.select("o_orderkey", band.alias("size_band"))


@query("null_handling", """
    select p_partkey, coalesce(nullif(p_type, 'ECONOMY'), 'none') as ptype,
        nullif(p_size, 1) is null as was_one from part""")
def null_handling(t):
    return t.part.select(
        "p_partkey", F.coalesce(F.nullif("p_type", F.lit("ECONOMY")), F.lit("none")).alias("ptype"),
        F.nullif(F.col("p_size"), F.lit(1)).isNull().alias("was_one"))


@query("cast_basic", """
    select o_orderkey, o_orderkey::varchar as as_text, o_custkey::double as as_float,
        trunc(o_totalprice)::bigint as as_int, o_totalprice::decimal(18,2)::varchar as as_numeric,
        strftime(o_orderdate::date::timestamp, '%Y-%m-%d %H:%M:%S') as as_ts from orders""")
def cast_basic(t):
    return t.orders.select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("as_text"),
        F.col("o_custkey").cast("double").alias("as_float"), F.col("o_totalprice").cast("long").alias("as_int"),
        money("o_totalprice").cast("string").alias("as_numeric"),
        F.col("o_orderdate").cast("date").cast("timestamp").cast("string").alias("as_ts"))


@query("safe_cast", """
    select o_orderkey, coalesce(try_cast(substr(o_orderpriority, 1, 1) as bigint), -1) as lead_digit,
        try_cast(o_orderpriority as bigint) is null as bad_cast,
        try_cast(nullif(o_orderstatus, 'F') as bigint) is null as null_or_bad from orders""")
def safe_cast(t):
    pr = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey", F.coalesce(F.substring(pr, 1, 1).try_cast("long"), F.lit(-1)).alias("lead_digit"),
        pr.try_cast("long").isNull().alias("bad_cast"),
        F.nullif(F.col("o_orderstatus"), F.lit("F")).try_cast("long").isNull().alias("null_or_bad"))


@query("safe_prefix", """
    select l_orderkey, l_linenumber, l_partkey,
        coalesce(l_extendedprice / nullif(l_tax, 0), -1) as price_per_tax,
        coalesce(strftime(try_strptime(l_returnflag || '-01', '%Y-%m-%d'), '%Y'), 'bad') as bad_date,
        coalesce(strftime(try_strptime(strftime(l_shipdate, '%Y%m%d'), '%Y%m%d'), '%Y-%m-%d'), 'bad') as good_date
    from lineitem""")
def safe_prefix(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.coalesce(F.try_divide("l_extendedprice", "l_tax"), F.lit(-1.0)).alias("price_per_tax"),
        F.coalesce(F.expr("cast(try_to_date(l_returnflag || '-01', 'yyyy-MM-dd') as string)"), F.lit("bad")).alias("bad_date"),
        F.coalesce(F.expr("cast(try_to_date(date_format(l_shipdate, 'yyyyMMdd'), 'yyyyMMdd') as string)"),
                   F.lit("bad")).alias("good_date"))


@query("not_in_null", """
    with bad as (select nullif(n_nationkey, 3) as k from nation where n_regionkey = 0)
    select 'not_in' as form, count(*)::bigint as n from customer where c_nationkey not in (select k from bad)
    union all
    select 'not_exists', count(*)::bigint from customer c
    where not exists (select 1 from bad where bad.k = c.c_nationkey)""")
def not_in_null(t):
    spark = t.register("customer", "nation")
    return spark.sql("""
        with bad as (select nullif(n_nationkey, 3) as k from nation where n_regionkey = 0)
        select 'not_in' as form, count(*) as n from customer where c_nationkey not in (select k from bad)
        union all
        select 'not_exists', count(*) from customer c left anti join bad on bad.k = c.c_nationkey""")


@query("distinct_rows", "select distinct c_mktsegment, c_nationkey from customer order by all")
def distinct_rows(t):
    return t.customer.select("c_mktsegment", "c_nationkey").distinct().orderBy("c_mktsegment", "c_nationkey")


@query("table_sample", """
    select o_orderkey, o_totalprice from orders
    where ('0x' || substr(md5(o_orderkey::varchar), 1, 7))::bigint % 100 < 10""")
def table_sample(t):
    return t.orders.where(md5_bucket(F.col("o_orderkey").cast("string")) < 10).select("o_orderkey", "o_totalprice")


@query("identifier_guard", """
    select p_partkey, replace(p_name, ' ', '_') as ident,
        regexp_full_match(replace(p_name, ' ', '_'), '[A-Za-z_][A-Za-z0-9_]*')
          and regexp_full_match(p_brand, '[A-Za-z_][A-Za-z0-9_]*') as safe,
        case when regexp_full_match(p_brand, '[A-Za-z_][A-Za-z0-9_]*') then 'none' else 'unsafe name' end as skip_reason
    from part""")
def identifier_guard(t):
    safe = lambda c: c.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    names = F.array(F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_brand"))
    d = t.part.select("p_partkey", names.alias("names"))
    return d.select(
        "p_partkey", F.col("names")[0].alias("ident"), F.forall("names", safe).alias("safe"),
        F.when(safe(F.col("names")[1]), "none").otherwise("unsafe name").alias("skip_reason"))


@query("not_null_filter", """
    with d as (select o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') as priority from orders)
    select * from d where priority is not null""")
def not_null_filter(t):
    pr = F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("priority")
    return t.orders.select("o_orderkey", pr).where(F.col("priority").isNotNull())


# ---------------------------------------------------------------- joins


@query("join_inner", """
    select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey""")
def join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("join_left", """
    select c_custkey, coalesce(o_orderkey, -1) as o_orderkey from customer
    left join orders on o_custkey = c_custkey and o_orderstatus = 'P'""")
def join_left(t):
    o = t.orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


@query("join_right", """
    select coalesce(s_name, 'none') as s_name, n_name from supplier right join nation on s_nationkey = n_nationkey""")
def join_right(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select(
        F.coalesce("s_name", F.lit("none")).alias("s_name"), "n_name")


@query("join_full", """
    with s as (select s_nationkey k, count(*)::bigint ns from supplier where s_acctbal > 5000 group by 1),
         c as (select c_nationkey k, count(*)::bigint nc from customer where c_acctbal < 0 group by 1)
    select coalesce(s.k, c.k) as nationkey, coalesce(ns, 0) as ns, coalesce(nc, 0) as nc from s full join c on s.k = c.k""")
def join_full(t):
    s = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("ns"))
    c = t.customer.where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("nc"))
    return s.join(c, "nationkey", "full").na.fill(0, ["ns", "nc"])


@query("join_cross_unnest", """
    select vec_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as x from embeddings""")
def join_cross_unnest(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "v")).select(
        "vec_id", F.col("p").cast("long").alias("pos"), F.col("v").cast("double").alias("x"))


@query("join_multi", """
    select o_orderkey, n_name, r_name, sum(l_quantity)::bigint as qty
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
    group by all""")
def join_multi(t):
    # Pre-aggregate the fact before it meets anything; the order key is unique downstream.
    qty = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("qty"))
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return (
        qty.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(broadcast_if_small(geo), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "n_name", "r_name", "qty"))


@query("join_semi", """
    select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)""")
def join_semi(t):
    o = t.orders.where("o_totalprice > 400000").select("o_custkey")
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("join_anti", """
    select c_custkey, c_name from customer c where not exists (select 1 from orders where o_custkey = c.c_custkey
        and o_totalprice > 400000)""")
def join_anti(t):
    o = t.orders.where("o_totalprice > 400000").select("o_custkey")
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("join_lookup", """
    select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' when 'P' then 'partial'
        else 'other' end as status_name from orders""")
def join_lookup(t):
    rules = [("F", "finished"), ("O", "open"), ("P", "partial")]
    return lookup_join(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", rules,
                       "status_name", default="other").drop("o_orderstatus")


@query("three_part_names", """
    select r.r_name, count(*)::bigint as n from nation n join region r on n.n_regionkey = r.r_regionkey group by 1""")
def three_part_names(t):
    from carryover.operators.steps import NameMap
    names = NameMap({"proj-a.geo.nation": t.nation, "proj-b.ref.region": t.region}, project="proj-a", dataset="geo")
    n, r = names.resolve("nation"), names.resolve("`proj-b.ref.region`")
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.count("*").alias("n"))


@query("time_travel", """
    with log as (
        select o_custkey k, o_orderkey v, o_orderstatus s, o_orderdate ts from orders)
    select k, v, s from log where ts <= timestamp '1998-06-30'
    qualify row_number() over (partition by k order by ts desc, v desc) = 1 and s <> 'P'""")
def time_travel(t):
    from carryover.operators.dml import state_as_of
    log = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"),
                          F.col("o_orderstatus").alias("s"), F.col("o_orderdate").alias("ts"))
    return state_as_of(log, ["k"], ["ts", "v"], "1998-06-30", deleted=F.col("s") == "P").select("k", "v", "s")


# ---------------------------------------------------------------- aggregations


@query("agg_basic", """
    select l_returnflag, l_linestatus, count(*)::bigint as n, sum(l_quantity::decimal(18,2))::double as sum_qty,
        sum(l_quantity::decimal(18,2))::double / count(*) as avg_qty,
        min(l_extendedprice) as min_price, max(l_extendedprice) as max_price from lineitem group by all""")
def agg_basic(t):
    q = F.sum(money("l_quantity")).cast("double")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), q.alias("sum_qty"), (q / F.count("*")).alias("avg_qty"),
        F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"))


@query("agg_by_expr_ordinal", """
    select strftime(o_orderdate, '%Y-%m') as month, count(*)::bigint as n from orders group by 1""")
def agg_by_expr_ordinal(t):
    return t.register("orders").sql(
        "select date_format(o_orderdate, 'yyyy-MM') as month, count(*) as n from orders group by 1")


@query("agg_distinct", """
    select l_returnflag, count(distinct l_partkey)::bigint as parts, count(distinct l_orderkey)::bigint as orders_n
    from lineitem group by 1""")
def agg_distinct(t):
    # One key pair at a time: each distinct is spread over (flag, id), never over the flag alone.
    li = t.lineitem
    p = li.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))
    o = li.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders_n"))
    return p.join(o, "l_returnflag")


@query("agg_array", """
    select l_orderkey, array_to_string(list_sort(list(distinct l_linenumber)), ',') as line_numbers
    from lineitem group by 1""")
def agg_array(t):
    # The distinct line numbers of an order are few, however often a hot order repeats them.
    return t.lineitem.groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("line_numbers"))


@query("agg_unnest_sum", """
    with o as (select l_orderkey, strftime(l_shipdate, '%Y-%m') as month,
                 list({'sku': l_partkey, 'amount': l_extendedprice}) as items from lineitem group by all)
    select month, sum(i.amount::decimal(18,2))::double as amount, count(*)::bigint as n
    from o, unnest(items) as u(i) group by 1""")
def agg_unnest_sum(t):
    from carryover.operators.reshape import item_arrays
    o = item_arrays(t.lineitem.withColumn("month", F.date_format("l_shipdate", "yyyy-MM")), ["l_orderkey", "month"],
                    {"sku": "l_partkey", "amount": "l_extendedprice"}, unit=F.concat_ws("-", "l_partkey", "l_linenumber"), limit=10_000)
    return o.select("month", F.explode("items").alias("i")).groupBy("month").agg(
        F.sum(money(F.col("i.amount"))).cast("double").alias("amount"), F.count("*").alias("n"))


@query("agg_countif", """
    select o_orderpriority, count_if(o_orderstatus = 'F')::bigint as finished,
        count_if(o_totalprice > 200000)::bigint as large from orders group by 1""")
def agg_countif(t):
    return t.orders.groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query("pivot", """
    select o_orderpriority, count_if(o_orderstatus='F')::bigint as F, count_if(o_orderstatus='O')::bigint as O,
        count_if(o_orderstatus='P')::bigint as P from orders group by 1""")
def pivot(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("unpivot", """
    select l_orderkey, l_linenumber, l_partkey, u.metric, u.value from lineitem,
        lateral (values ('l_quantity', l_quantity), ('l_discount', l_discount), ('l_tax', l_tax)) as u(metric, value)""")
def unpivot(t):
    return unpivot_long(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])


@query("date_hierarchy_rollup", """
    select coalesce(year(o_orderdate), -1)::bigint as y, coalesce(quarter(o_orderdate), -1)::bigint as q,
        coalesce(month(o_orderdate), -1)::bigint as m, coalesce(day(o_orderdate), -1)::bigint as d,
        grouping_id(year(o_orderdate), quarter(o_orderdate), month(o_orderdate), day(o_orderdate))::bigint as level,
        count(*)::bigint as n, sum(o_totalprice::decimal(18,2))::double as revenue
    from orders group by rollup(year(o_orderdate), quarter(o_orderdate), month(o_orderdate), day(o_orderdate))""")
def date_hierarchy_rollup(t):
    from carryover.operators.reshape import date_hierarchy
    return date_hierarchy(t.orders, "o_orderdate", {"n": F.col("o_totalprice"), "revenue": money("o_totalprice")})


@query("auto_measures", """
    select * from (
      select 'Row Count' as measure, count(*)::double as value from orders union all
      select 'Sum o_orderkey', sum(o_orderkey)::double from orders union all
      select 'Average o_orderkey', sum(o_orderkey)::double / count(o_orderkey) from orders union all
      select 'Count o_orderkey', count(o_orderkey)::double from orders union all
      select 'Sum o_custkey', sum(o_custkey)::double from orders union all
      select 'Average o_custkey', sum(o_custkey)::double / count(o_custkey) from orders union all
      select 'Count o_custkey', count(o_custkey)::double from orders union all
      select 'Sum o_totalprice', sum(o_totalprice::decimal(18,2))::double from orders union all
      select 'Average o_totalprice', sum(o_totalprice::decimal(18,2))::double / count(o_totalprice) from orders union all
      select 'Count o_totalprice', count(o_totalprice)::double from orders)""")
def auto_measures(t):
    from carryover.operators.semantic import auto_measures as run
    return run(t.orders)


@query("order_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def order_limit(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("group_topk", """
    select c_nationkey, count(*)::bigint as n from customer group by 1 order by n desc, c_nationkey limit 5""")
def group_topk(t):
    return t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(5)


@query("detail_grid", """
    select o_orderkey, c_name, l_partkey, l_linenumber, l_extendedprice from lineitem
    join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    order by l_extendedprice desc, o_orderkey, l_partkey, l_linenumber limit 50""")
def detail_grid(t):
    # Both joins are many-to-one on unique keys, so the top rows can be taken afterwards in one pass.
    return (
        t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        .orderBy(F.desc("l_extendedprice"), "o_orderkey", "l_partkey", "l_linenumber").limit(50)
        .select("o_orderkey", "c_name", "l_partkey", "l_linenumber", "l_extendedprice"))


# ---------------------------------------------------------------- set operations, CTEs

_A = "select c_nationkey as k, c_mktsegment as s from customer where c_acctbal > 0"
_B = "select c_nationkey as k, c_mktsegment as s from customer where c_acctbal < 3000"


def _ab(t):
    d = t.customer
    pick = lambda c: d.where(c).select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s"))
    return pick("c_acctbal > 0"), pick("c_acctbal < 3000")


@query("union_all", f"{_A} union all {_B}")
def union_all(t):
    a, b = _ab(t)
    return a.unionByName(b)


@query("union_distinct", f"{_A} union {_B}")
def union_distinct(t):
    a, b = _ab(t)
    return a.unionByName(b).distinct()


@query("intersect", f"{_A} intersect {_B}")
def intersect(t):
    a, b = _ab(t)
    return a.intersect(b)


@query("except", f"{_A.replace('> 0', '> 9990')} except {_B.replace('< 3000', '< -950')}")
def except_(t):
    d = t.customer
    pick = lambda c: d.where(c).select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s"))
    return pick("c_acctbal > 9990").subtract(pick("c_acctbal < -950"))


@query("intersect_all", f"{_A} intersect all {_B}")
def intersect_all(t):
    from carryover.operators.bags import bag_intersect
    return bag_intersect(*_ab(t))


@query("except_all", f"{_A} except all {_B}")
def except_all(t):
    from carryover.operators.bags import bag_subtract
    return bag_subtract(*_ab(t))


_CTE = """
    with recent as (select o_custkey, o_totalprice, 'recent' as era from orders where o_orderdate >= {d}'1999-01-01'),
         older as (select o_custkey, o_totalprice, 'older' as era from orders
                   where o_orderdate < {d}'1999-01-01' and o_orderstatus not in ('P'))
    select era, count(*) as n, count(distinct o_custkey) as customers
    from (select * from recent union all select * from older) u group by era"""


@query("cte_union", _CTE.format(d="timestamp "))
def cte_union(t):
    return t.register("orders").sql(_CTE.format(d="timestamp_ntz "))


@query("recursive_cte", """
    with recursive walk as (
        select p_partkey as start, p_partkey as node, 0 as depth from part
        union all select start, node // 2, depth + 1 from walk where node >= 2)
    select start, max(depth)::bigint as depth, count(*)::bigint as steps from walk group by start""")
def recursive_cte(t):
    start = spread(t.part.select("p_partkey"), "p_partkey").selectExpr("p_partkey as start", "p_partkey as node", "0 as depth")
    walk = recursive_union(start, lambda d: d.where("node >= 2").selectExpr("start", "node div 2 as node", "depth + 1 as depth"))
    return walk.groupBy("start").agg(F.max("depth").cast("long").alias("depth"), F.count(F.lit(1)).alias("steps"))
