"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions import canonical as C
from carryover.functions import scalars as S
from carryover.plans.registry import query


def text(c, fmt="yyyy-MM-dd"):
    return F.date_format(c, fmt)


@query("date_cast", "select event_id, strftime(ts::date, '%Y-%m-%d') as d from events")
def date_cast(t):
    return t.events.select("event_id", F.to_date("ts").cast("string").alias("d"))


@query("date_arith", """
    select o_orderkey, strftime(o_orderdate::date + 10, '%Y-%m-%d') as plus10, strftime(o_orderdate::date - 3, '%Y-%m-%d') as minus3,
        strftime(o_orderdate + interval 1 month, '%Y-%m-%d') as next_month,
        strftime(o_orderdate + interval 36 hour, '%Y-%m-%d %H:%M:%S') as plus36h from orders""")
def date_arith(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.date_add(d, 10).cast("string").alias("plus10"), F.date_sub(d, 3).cast("string").alias("minus3"),
        F.add_months(d, 1).cast("string").alias("next_month"),
        text(F.col("o_orderdate") + F.expr("interval 36 hours"), "yyyy-MM-dd HH:mm:ss").alias("plus36h"))


@query("date_diff", """
    select l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate::date, l_shipdate::date)::bigint as days
    from lineitem join orders on l_orderkey = o_orderkey""")
def date_diff(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))


@query("date_timeframes", """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as time, strftime(ts, '%Y-%m-%d') as date,
        strftime(ts, '%Y-%m') as month, strftime(ts, '%Y') as year, strftime(date_trunc('quarter', ts), '%Y-%m-%d') as quarter from events""")
def date_timeframes(t):
    return t.events.select(
        "event_id", text("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), text("ts").alias("date"),
        text("ts", "yyyy-MM").alias("month"), text("ts", "yyyy").alias("year"),
        text(F.date_trunc("quarter", "ts")).alias("quarter"))


@query("time_bin", """
    select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as bin, event_type, count(*)::bigint as n from events group by all""")
def time_bin(t):
    w = F.window("ts", "1 hour").alias("w")
    return t.events.groupBy(w, "event_type").agg(F.count("*").alias("n")).select(
        text("w.start", "yyyy-MM-dd HH:mm:ss").alias("bin"), "event_type", "n")


@query("parse_date_safe", """
    select o_orderkey, coalesce(strftime(try_strptime(raw, '%Y%m%d'), '%Y-%m-%d'), 'invalid') as d from (
        select o_orderkey, case when o_orderstatus = 'P' then '19991345' else strftime(o_orderdate, '%Y%m%d') end as raw from orders)""")
def parse_date_safe(t):
    raw = F.when(F.col("o_orderstatus") == "P", "19991345").otherwise(text("o_orderdate", "yyyyMMdd"))
    return t.orders.select("o_orderkey", F.coalesce(S.parse_date_safe("%Y%m%d", raw).cast("string"), F.lit("invalid")).alias("d"))


@query("array_concat", """
    select vec_id, len(list_concat(embedding, embedding))::bigint as n, list_concat(embedding, embedding)[1]::double as first_x,
        list_concat(embedding, embedding)[len(embedding) + 1]::double as middle_x from embeddings""")
def array_concat(t):
    d = t.embeddings.select("vec_id", "embedding", F.concat("embedding", "embedding").alias("c"))
    return d.select("vec_id", F.size("c").cast("long").alias("n"), F.col("c")[0].cast("double").alias("first_x"),
                    F.element_at("c", F.size("embedding") + 1).cast("double").alias("middle_x"))


@query("array_length", """
    select vec_id, coalesce(len(case when label > 0 then embedding end), -1)::bigint as n from embeddings""")
def array_length(t):
    arr = F.when(F.col("label") > 0, F.col("embedding"))
    return t.embeddings.select("vec_id", F.coalesce(F.when(arr.isNotNull(), F.size(arr)), F.lit(-1)).cast("long").alias("n"))


@query("struct_access", """
    select s.k as k, s.n as name, s.geo.nation as nation from (
        select {'k': c_custkey, 'n': c_name, 'geo': {'nation': c_nationkey}} as s from customer)""")
def struct_access(t):
    s = F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.struct(F.col("c_nationkey").alias("nation")).alias("geo"))
    return t.customer.select(s.alias("s")).select(F.col("s.k").alias("k"), F.col("s.n").alias("name"), F.col("s.geo.nation").alias("nation"))


@query("net_host", """
    select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, regexp_extract(url, '^([a-z]+):', 1) as scheme,
        regexp_extract(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '([^.]+\\.[^.]+)$', 1) as domain from pages""")
def net_host(t):
    u = F.col("url")
    return t.pages.select("page_id", S.net_host(u).alias("host"), S.net_scheme(u).alias("scheme"), S.reg_domain(u).alias("domain"))


@query("geo_distance", """
    with c as (select c_custkey as id, c_acctbal::decimal(18,2)::double / 250 as lat, (c_nationkey * 13 - 160)::double as lon from customer)
    select id, floor(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(48.85 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.85))
        * pow(sin(radians(2.35 - lon) / 2), 2)))) / 1000)::bigint as km from c""")
def geo_distance(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 250).alias("lat"),
                          (F.col("c_nationkey") * 13 - 160).cast("double").alias("lon"))
    km = S.haversine_m(F.col("lat"), F.col("lon"), F.lit(48.85), F.lit(2.35)) / 1000
    return c.select("id", F.floor(km).alias("km"))


@query("json_extract", """
    select event_id, json_extract_string(props, '$.k') as k, (json_extract_string(props, '$.k'))::bigint % 10 as digit from events""")
def json_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"),
                           (F.try_variant_get(F.parse_json("props"), "$.k", "long") % 10).alias("digit"))


@query("decimal_canonical", """
    select o_orderkey, case when contains(x, '.') then regexp_replace(regexp_replace(x, '0+$', ''), '\\.$', '') else x end as canonical,
        o_orderpriority as passed_through
    from (select o_orderkey, o_totalprice::decimal(18,2)::varchar as x, o_orderpriority from orders)""")
def decimal_canonical(t):
    return t.orders.select("o_orderkey", C.canonical_number(C.money("o_totalprice").cast("string")).alias("canonical"),
                           C.canonical_number(F.col("o_orderpriority")).alias("passed_through"))


@query("count_coerce", """
    select doc_id, coalesce(case when regexp_full_match(x, '[0-9]+') then x::bigint end, -1) as n from (
        select doc_id, case when lang = 'en' then n_chars::varchar when lang = 'de' then '-' || n_chars
            when lang = 'fr' then 'true' else n_chars || '.5' end as x from documents)""")
def count_coerce(t):
    n = F.col("n_chars").cast("string")
    x = (F.when(F.col("lang") == "en", n).when(F.col("lang") == "de", F.concat(F.lit("-"), n))
         .when(F.col("lang") == "fr", "true").otherwise(F.concat(n, F.lit(".5"))))
    return t.documents.select("doc_id", F.coalesce(S.count_coerce(x), F.lit(-1)).alias("n"))


@query("leaf_segment", """
    select page_id, regexp_extract(rtrim(split_part(url, '?', 1), '/'), '([^/]*)$', 1) as leaf,
        regexp_extract(url, '://([^/?#]+)', 1) as after_scheme from pages""")
def leaf_segment(t):
    base = F.split_part("url", F.lit("?"), F.lit(1))
    return t.pages.select("page_id", S.leaf_segment(base).alias("leaf"),
                          F.regexp_extract("url", "://([^/?#]+)", 1).alias("after_scheme"))


@query("sha256_short", "select c_custkey, substr(sha256(c_name), 1, 12) as digest from customer")
def sha256_short(t):
    return t.customer.select("c_custkey", C.sha256_short(F.col("c_name")).alias("digest"))
