"""Window functions, QUALIFY and newest-row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators.windows import keyed_window, latest_per_key, top_per_key
from carryover.plans.registry import query

def _orders(t):
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )


@query("win_row_number", """
    select o_custkey, o_orderkey,
           row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::bigint as rn
    from orders""")
def win_row_number(t):
    d = _orders(t).select("o_custkey", "o_orderkey", "o_orderdate")
    out = keyed_window(d, ["o_custkey"], ["o_orderdate", "o_orderkey"], row_number="rn")
    return out.select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("win_rank", """
    select o_orderstatus, o_orderkey,
           rank() over (partition by o_orderstatus order by o_orderdate)::bigint as rnk,
           dense_rank() over (partition by o_orderstatus order by o_orderdate)::bigint as dense
    from orders""")
def win_rank(t):
    d = _orders(t).select("o_orderstatus", "o_orderkey", "o_orderdate")
    out = keyed_window(d, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], rank="rnk", dense_rank="dense")
    return out.select("o_orderstatus", "o_orderkey", F.col("rnk").cast("long").alias("rnk"),
                      F.col("dense").cast("long").alias("dense"))


@query("win_running_total", """
    select o_custkey, o_orderkey,
           sum(o_totalprice::decimal(18,2)) over (partition by o_custkey order by o_orderdate, o_orderkey
               rows unbounded preceding)::double as running_total
    from orders""")
def win_running_total(t):
    out = keyed_window(_orders(t), ["o_custkey"], ["o_orderdate", "o_orderkey"],
                       running_sum={"running_total": "price"})
    return out.select("o_custkey", "o_orderkey", F.col("running_total").cast("double").alias("running_total"))


@query("win_lag_lead", """
    select event_type, event_id,
           coalesce(lag(event_id) over w, -1) as prev_id, coalesce(lead(event_id) over w, -1) as next_id
    from events window w as (partition by event_type order by ts, event_id)""")
def win_lag_lead(t):
    d = t.events.select("event_type", "event_id", "ts")
    out = keyed_window(d, ["event_type"], ["ts", "event_id"],
                       lag={"prev_id": "event_id"}, lead={"next_id": "event_id"})
    return out.select("event_type", "event_id", F.coalesce("prev_id", F.lit(-1)).alias("prev_id"),
                      F.coalesce("next_id", F.lit(-1)).alias("next_id"))


@query("win_frames", """
    select o_orderstatus, o_orderkey,
           sum(o_totalprice::decimal(18,2)) over w::double as run_sum,
           max(o_totalprice::decimal(18,2)) over w::double as run_max,
           (sum(o_totalprice::decimal(18,2)) over w)::double / (count(*) over w) as run_avg,
           'supported' as frame
    from orders window w as (partition by o_orderstatus order by o_orderdate, o_orderkey
                             rows between unbounded preceding and current row)""")
def win_frames(t):
    out = keyed_window(_orders(t), ["o_orderstatus"], ["o_orderdate", "o_orderkey"],
                       running_sum={"run_sum": "price"}, running_max={"run_max": "price"},
                       running_avg={"run_avg": "price"})
    return out.select("o_orderstatus", "o_orderkey", F.col("run_sum").cast("double").alias("run_sum"),
                      F.col("run_max").cast("double").alias("run_max"), "run_avg",
                      F.lit("supported").alias("frame"))


@query("qualify_topn", """
    select o_custkey, o_orderkey, o_totalprice from orders
    qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3""")
def qualify_topn(t):
    d = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per_key(d, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("latest_per_key", """
    select user_id, event_id, event_type, value from events
    qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def latest(t):
    d = t.events.select("user_id", "event_id", "event_type", "value", "ts")
    return latest_per_key(d, ["user_id"], ["ts", "event_id"]).drop("ts")
