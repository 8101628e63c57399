"""Semantic-layer queries over an orders explore."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions.canonical import money
from carryover.operators import semantic as S
from carryover.plans.registry import query
from carryover.session import scratch
from carryover.sources.sinks import overwrite


def orders_explore(t) -> S.Explore:
    orders = S.View("orders", t.orders, "o_orderkey", {
        "status": "o_orderstatus", "priority": "o_orderpriority", "month": "date_format(o_orderdate, 'yyyy-MM')",
        "year": "year(o_orderdate)", "is_large": "o_totalprice > 300000",
        "band": "case when o_totalprice >= 400000 then 'A' when o_totalprice >= 200000 then 'B' else 'C' end"}, {
        "count": S.Measure("count"), "revenue": S.Measure("sum", "o_totalprice"), "average": S.Measure("average", "o_totalprice"),
        "first": S.Measure("min", "o_totalprice"), "largest": S.Measure("max", "o_totalprice"), "buyers": S.Measure("count_distinct", "o_custkey"),
        "finished_revenue": S.Measure("sum", "o_totalprice", "o_orderstatus = 'F'"), "finished": S.Measure("count", None, "o_orderstatus = 'F'")})
    customer = S.View("customer", t.customer, "c_custkey", {"segment": "c_mktsegment", "nation": "c_nationkey"}, {"customers": S.Measure("count_distinct", "c_custkey")})
    items = S.View("items", t.lineitem, "l_orderkey", {"flag": "l_returnflag"}, {"quantity": S.Measure("sum", "l_quantity"), "lines": S.Measure("count")})
    nation = S.View("nation", t.nation, "n_nationkey", {"name": "n_name"}, {})
    return S.Explore(orders, [S.Join(customer, ("o_custkey", "c_custkey")), S.Join(nation, ("c_nationkey", "n_nationkey")),
                              S.Join(items, ("o_orderkey", "l_orderkey"), "one_to_many")])


@query("semantic_query", """
    select c_mktsegment as customer_segment, count(*)::bigint as orders_count, sum(o_totalprice::decimal(18,2))::double as orders_revenue
    from orders left join customer on o_custkey = c_custkey where o_orderstatus <> 'P' group by 1 order by orders_revenue desc limit 3""")
def semantic_query(t):
    return S.semantic_query(orders_explore(t), ["customer.segment"], ["orders.count", "orders.revenue"], "orders.o_orderstatus <> 'P'",
                            ["-orders_revenue"], 3)


@query("explore_join", """
    with f as (select distinct n_name, l_returnflag, o_orderkey, o_totalprice from orders left join customer on o_custkey = c_custkey
        left join nation on c_nationkey = n_nationkey left join lineitem on o_orderkey = l_orderkey),
    a as (select n_name, l_returnflag, count(*)::bigint as n, sum(o_totalprice::decimal(18,2))::double as revenue from f group by all),
    b as (select n_name, l_returnflag, sum(l_quantity)::double as q from orders left join customer on o_custkey = c_custkey
        left join nation on c_nationkey = n_nationkey left join lineitem on o_orderkey = l_orderkey group by all)
    select a.n_name as nation_name, coalesce(a.l_returnflag, '-') as items_flag, n as orders_count, revenue as orders_revenue, coalesce(q, 0) as items_quantity
    from a join b on a.n_name is not distinct from b.n_name and a.l_returnflag is not distinct from b.l_returnflag""")
def explore_join(t):
    d = S.semantic_query(orders_explore(t), ["nation.name", "items.flag"], ["orders.count", "orders.revenue", "items.quantity"],
                         "customer.c_custkey is not null or customer.c_custkey is null")
    return d.na.fill("-", ["items_flag"]).na.fill(0.0, ["items_quantity"])


@query("measure_types", """
    select o_orderstatus as orders_status, count(*)::bigint as orders_count, sum(o_totalprice::decimal(18,2))::double as orders_revenue,
        sum(o_totalprice::decimal(18,2))::double / count(*) as orders_average, min(o_totalprice) as orders_first, max(o_totalprice) as orders_largest,
        count(distinct o_custkey)::bigint as orders_buyers from orders group by 1""")
def measure_types(t):
    return S.semantic_query(orders_explore(t), ["orders.status"], [f"orders.{m}" for m in ("count", "revenue", "average", "first", "largest", "buyers")])


@query("filtered_measure", """
    select o_orderpriority as orders_priority, sum(o_totalprice::decimal(18,2)) filter (o_orderstatus = 'F')::double as orders_finished_revenue,
        count(*) filter (o_orderstatus = 'F')::bigint as orders_finished, count(*)::bigint as orders_count from orders group by 1""")
def filtered_measure(t):
    return S.semantic_query(orders_explore(t), ["orders.priority"], ["orders.finished_revenue", "orders.finished", "orders.count"])


@query("derived_measure", """
    select o_orderpriority as orders_priority, sum(o_totalprice::decimal(18,2)) filter (o_orderstatus = 'F')::double / nullif(sum(o_totalprice::decimal(18,2))::double, 0) as finished_share
    from orders group by 1""")
def derived_measure(t):
    d = S.semantic_query(orders_explore(t), ["orders.priority"], ["orders.finished_revenue", "orders.revenue"])
    return d.select("orders_priority", F.try_divide("orders_finished_revenue", "orders_revenue").alias("finished_share"))


def _fanned(t):
    j = t.orders.join(t.lineitem.select("l_orderkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("l_returnflag", "o_orderkey", money("o_totalprice").alias("price"))


_SYM = """with o as (select distinct l_returnflag, o_orderkey, o_totalprice::decimal(18,2) as p from orders join lineitem on o_orderkey = l_orderkey) """


@query("symmetric_sum", _SYM + "select l_returnflag, sum(p)::double as total, count(*)::bigint as n from o group by 1")
def symmetric_sum(t):
    return S.symmetric(_fanned(t), ["l_returnflag"], "o_orderkey", "price").select("l_returnflag", "total", "n")


@query("symmetric_avg", _SYM + "select l_returnflag, sum(p)::double / count(*) as average from o group by 1")
def symmetric_avg(t):
    return S.symmetric(_fanned(t), ["l_returnflag"], "o_orderkey", "price").select("l_returnflag", "average")


@query("period_over_period", """
    with p as (select case when o_orderdate::date > date '2000-01-01' and o_orderdate::date <= date '2000-12-31' then 'Selected'
            when o_orderdate::date > date '1999-01-02' - 1 and o_orderdate::date <= date '2000-01-01' then 'Previous' else 'Not' end as period, o_orderpriority, o_totalprice from orders),
    g as (select o_orderpriority, sum(o_totalprice::decimal(18,2)) filter (period = 'Selected')::double as selected,
        sum(o_totalprice::decimal(18,2)) filter (period = 'Previous')::double as previous from p group by 1)
    select *, (selected - previous) / nullif(previous, 0) as change from g""")
def period_over_period(t):
    label = S.period_label(F.to_date("o_orderdate"), "2000-12-31", 365)
    d = t.orders.select("o_orderpriority", money("o_totalprice").alias("p"), label.alias("period"))
    one = lambda k: F.sum(F.when(F.col("period") == k, F.col("p"))).cast("double")
    g = d.groupBy("o_orderpriority").agg(one("Selected").alias("selected"), one("Previous").alias("previous"))
    return g.withColumn("change", F.try_divide(F.col("selected") - F.col("previous"), F.col("previous")))


@query("dynamic_timeframe", """
    select 'month' as grain, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as period, count(*)::bigint as n from orders group by 2
    union all select 'year', strftime(date_trunc('year', o_orderdate), '%Y-%m-%d'), count(*)::bigint from orders group by 2""")
def dynamic_timeframe(t):
    def by(grain):
        period = F.date_format(F.date_trunc(grain, "o_orderdate"), "yyyy-MM-dd")
        return t.orders.groupBy(period.alias("period")).agg(F.count("*").alias("n")).select(F.lit(grain).alias("grain"), "period", "n")
    return by("month").unionByName(by("year"))


@query("case_dimension", """
    select case when o_totalprice >= 400000 then 'A' when o_totalprice >= 200000 then 'B' else 'C' end as orders_band, count(*)::bigint as orders_count from orders group by 1""")
def case_dimension(t):
    return S.semantic_query(orders_explore(t), ["orders.band"], ["orders.count"])


@query("yesno_dimension", "select o_totalprice > 300000 as orders_is_large, count(*)::bigint as orders_count from orders group by 1")
def yesno_dimension(t):
    return S.semantic_query(orders_explore(t), ["orders.is_large"], ["orders.count"])


@query("scorecard", "select count(*)::bigint as orders_count, sum(o_totalprice::decimal(18,2))::double as orders_revenue from orders")
def scorecard(t):
    return S.semantic_query(orders_explore(t), [], ["orders.count", "orders.revenue"])


@query("trend_series", """
    with d as (select unnest(generate_series((select min(o_orderdate) from orders where o_totalprice > 450000), (select max(o_orderdate) from orders where o_totalprice > 450000), interval 1 day)) as day)
    select strftime(day, '%Y-%m-%d') as day, count(o_orderkey)::bigint as n from d left join orders on o_orderdate = day and o_totalprice > 450000 group by 1""")
def trend_series(t):
    daily = t.orders.where("o_totalprice > 450000").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return S.date_spine(daily, "day", ["n"]).withColumn("day", F.col("day").cast("string"))


@query("breakdown_share", """
    with s as (select nullif(o_orderpriority, '4-NOT SPECIFIED') as priority, count(*)::bigint as n from orders group by 1)
    select priority, n, n::double * 100 / (select sum(n) from s where priority is not null)::double as share from s where priority is not null""")
def breakdown_share(t):
    p = F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("priority")
    d = t.orders.select(p).where("priority is not null").groupBy("priority").agg(F.count("*").alias("n"))
    return S.with_share(d, "n", "share")


@query("aggregate_awareness", """
    select o_orderstatus as status, sum(o_totalprice::decimal(18,2))::double as revenue, count(*)::bigint as n, true as from_rollup from orders group by 1""")
def aggregate_awareness(t):
    base = t.orders.select(F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").alias("buyer"),
                           money("o_totalprice").alias("revenue"), F.lit(1).alias("n"))
    monthly = base.groupBy("month", "status").agg(F.sum("revenue").alias("revenue"), F.sum("n").alias("n"))
    reg = S.Rollups()
    reg.register({"month", "status"}, {"revenue", "n"}, overwrite(monthly, scratch(t.spark, "monthly")))
    d, used = reg.answer(base, ["status"], ["revenue", "n"])
    return d.select("status", F.col("revenue").cast("double").alias("revenue"), "n", F.lit(used).alias("from_rollup"))
