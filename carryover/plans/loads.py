"""Scans, sinks and load patterns, each written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions import paths
from carryover.functions.canonical import money
from carryover.operators.dml import upsert_by_priority, upsert_latest
from carryover.plans.registry import query
from carryover.session import scratch
from carryover.sources import sinks


@query("scan_formats", """
    select f.fmt, count(*)::bigint as n, sum(o_totalprice::decimal(18,2))::double as total, max(strftime(o_orderdate, '%Y-%m-%d')) as last
    from orders, (values ('csv'), ('json'), ('orc'), ('parquet'), ('table')) f(fmt) group by 1""")
def scan_formats(t):
    d = t.orders
    out = None
    for fmt in ("csv", "json", "orc", "parquet", "table"):
        path, opts = scratch(t.spark, f"fmt_{fmt}"), {}
        if fmt == "csv":
            opts = {"header": "true", "sep": ";", "quote": '"'}
        if fmt == "table":
            # A table name bound to files: the catalog holds the location, the data stays shared.
            name = "scan_formats_" + path.rsplit("-", 1)[1]
            d.write.parquet(path)
            t.spark.read.schema(d.schema).parquet(path).createOrReplaceTempView(name)
            back = t.spark.table(name)
        else:
            d.write.format(fmt).options(**opts).save(path)
            back = sinks.read_back(d, path, fmt, **opts)
        one = back.agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"),
                       F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last")).select(F.lit(fmt).alias("fmt"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("wildcard_scan", """
    select year(o_orderdate)::varchar as table_suffix, count(*)::bigint as n, sum(o_totalprice::decimal(18,2))::double as total
    from orders where year(o_orderdate) between 1996 and 1998 group by 1""")
def wildcard_scan(t):
    base = scratch(t.spark, "orders_by_year")
    t.orders.withColumn("yr", F.year("o_orderdate")).write.partitionBy("yr").parquet(base)
    d = sinks.wildcard_scan(t.spark, f"{base}/yr=*", t.orders.schema, r"yr=([0-9]+)", "1996", "1998")
    return d.groupBy("table_suffix").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"))


@query("partition_scan", """
    select l_orderkey, l_partkey, l_linenumber, l_extendedprice from lineitem where l_returnflag = 'R'
    order by l_extendedprice desc, l_orderkey, l_partkey, l_linenumber limit 100""")
def partition_scan(t):
    base = scratch(t.spark, "lineitem_by_flag")
    t.lineitem.write.partitionBy("l_returnflag").parquet(base)
    d = t.spark.read.schema(t.lineitem.schema).parquet(base).where("l_returnflag = 'R'")
    return d.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_linenumber").limit(100).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


@query("json_event_ingest", """
    select event_id, case when event_type = 'error' then -1 else (json_extract_string(props, '$.k'))::bigint end as k,
        event_type = 'error' as quarantined, true as stamped from events""")
def json_event_ingest(t):
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), "props")).otherwise(F.col("props"))
    d = sinks.parse_json_events(t.events.select("event_id", raw.alias("raw")), "raw", "k bigint")
    return d.select("event_id", F.coalesce("k", F.lit(-1)).alias("k"), F.col("_bad").isNotNull().alias("quarantined"),
                    F.col("_ingestion_time").isNotNull().alias("stamped"))


@query("estate_upsert", """
    select source_id, origin, size from (
      select p_partkey as source_id, 'import' as origin, p_size * 2 as size from part where p_brand < 'Brand#2' union all
      select p_partkey, 'base', p_size from part where not p_brand < 'Brand#2')""")
def estate_upsert(t):
    base = t.part.select(F.col("p_partkey").alias("source_id"), F.lit("base").alias("origin"), F.col("p_size").alias("size"))
    new = t.part.where("p_brand < 'Brand#2'").select(
        F.col("p_partkey").alias("source_id"), F.lit("import").alias("origin"), (F.col("p_size") * 2).alias("size"))
    return upsert_by_priority([base, new], ["source_id"])


@query("sink_overwrite", "select * from customer")
def sink_overwrite(t):
    path = scratch(t.spark, "customer")
    sinks.overwrite(t.customer.withColumn("c_acctbal", F.lit(0.0)), path)  # stale copy to be replaced
    return sinks.overwrite(t.customer, path)


@query("sink_append", """
    select o_orderstatus, count(*)::bigint as n, sum(o_totalprice::decimal(18,2))::double as total from orders group by 1""")
def sink_append(t):
    path = scratch(t.spark, "orders_append")
    for status in ("F", "O", "P", "P"):  # the last run is retried
        sinks.append_run(t.orders.where(F.col("o_orderstatus") == status), path, f"run-{status}")
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"))


@query("sink_partitioned", """
    select year(o_orderdate)::bigint as year, month(o_orderdate)::bigint as month, count(*)::bigint as n from orders group by all""")
def sink_partitioned(t):
    path = scratch(t.spark, "orders_ym")
    d = t.orders.withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    # One writer per (month, slice): few files per folder, and a busy month still has many writers.
    d.repartition("year", "month", F.pmod("o_orderkey", F.lit(4))).write.partitionBy("year", "month").parquet(path)
    back = t.spark.read.schema(d.schema).parquet(path)
    return back.groupBy(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month")).agg(F.count("*").alias("n"))


@query("load_timestamped", """
    select o_orderstatus, count(*)::bigint as n, '2024-03-01 06:00:00' as _load_timestamp from orders group by 1""")
def load_timestamped(t):
    agg = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    d = sinks.load_timestamped(agg, "2024-03-01 06:00:00")
    return d.withColumn("_load_timestamp", F.date_format("_load_timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("load_incremental_watermark", """
    select strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') as watermark, count(*)::bigint as n, count(distinct o_orderkey)::bigint as keys,
        sum(o_totalprice::decimal(18,2))::double as total from orders""")
def load_incremental_watermark(t):
    path, state = scratch(t.spark, "inc"), scratch(t.spark, "inc_state")
    for until in ("1996-12-31", "1999-06-30", "1999-06-30", None):  # the second bound runs twice
        mark = sinks.incremental_load(t.orders, "o_orderdate", path, state, "orders", until)
    return t.spark.read.parquet(path).agg(
        F.lit(mark).alias("watermark"), F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"),
        F.sum(money("o_totalprice")).cast("double").alias("total"))


@query("load_watermark_fractions", "select max(ts)::varchar as watermark, count(*)::bigint as n, count(distinct event_id)::bigint as keys from events")
def load_watermark_fractions(t):
    path, state = scratch(t.spark, "inc"), scratch(t.spark, "inc_state")
    middle = t.events.agg(F.percentile("event_id", 0.5).cast("long").alias("m")).scalar()
    until = t.events.where(F.col("event_id") == middle).agg(F.max("ts").cast("string")).first()[0]
    for bound in (until, until, None, None):  # each run is retried
        mark = sinks.incremental_load(t.events, "ts", path, state, "events", bound)
    return t.spark.read.parquet(path).agg(F.lit(mark).alias("watermark"), F.count("*").alias("n"), F.count_distinct("event_id").alias("keys"))


@query("load_merge_incremental", """
    with base as (select user_id, event_id, value, ts from events where ts < timestamp '2024-01-10'
                  qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
    fresh as (select user_id, event_id, value, ts from events where ts >= timestamp '2024-01-10'
              qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
    select user_id, event_id, value from fresh union all
    select user_id, event_id, value from base where user_id not in (select user_id from fresh)""")
def load_merge_incremental(t):
    from carryover.operators.windows import latest_per_key
    d = t.events.select("user_id", "event_id", "value", "ts")
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    base = latest_per_key(d.where(F.col("ts") < cut), ["user_id"], ["ts", "event_id"])
    return upsert_latest(base, d.where(F.col("ts") >= cut), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("materialize_models", """
    with stg as (select o_custkey, o_totalprice::decimal(18,2) as price from orders where o_orderstatus <> 'P'),
    cust as (select o_custkey, sum(price) as v, count(*) as n from stg group by 1)
    select c_mktsegment, sum(v)::double as v, sum(n)::bigint as n from cust join customer on o_custkey = c_custkey group by 1""")
def materialize_models(t):
    models = [
        sinks.Model("mart", "select c_mktsegment, cast(sum(v) as double) as v, sum(n) as n from {cust} join {customer} "
                    "on o_custkey = c_custkey group by 1", "table", ["cust"]),
        sinks.Model("cust", "select o_custkey, sum(price) as v, count(*) as n from {stg} group by 1", "incremental",
                    ["stg"], ["o_custkey"], ["n"]),
        sinks.Model("stg", "select o_custkey, cast(o_totalprice as decimal(18,2)) as price from {live}", "view", ["live"]),
        sinks.Model("live", "select * from {orders} where o_orderstatus <> 'P'", "ephemeral"),
    ]
    return sinks.materialize_models(t.spark, models, scratch(t.spark, "models"), {"orders": t.orders, "customer": t.customer})["mart"]


@query("materialized_rollup", """
    select strftime(o_orderdate, '%Y-%m') as bucket, o_orderstatus, count(*)::bigint as n,
        sum(o_totalprice::decimal(18,2))::double as revenue from orders group by all""")
def materialized_rollup(t):
    path = scratch(t.spark, "rollup")
    month = F.date_format("o_orderdate", "yyyy-MM")
    aggs = [F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("revenue")]
    # First refresh sees a table that still lacks the partial orders of 2001.
    early = t.orders.where("not (o_orderstatus = 'P' and year(o_orderdate) = 2001)")
    sinks.refresh_rollup(early, path, month, ["o_orderstatus"], aggs)
    changed = [f"2001-{m:02d}" for m in range(1, 13)]
    return sinks.refresh_rollup(t.orders, path, month, ["o_orderstatus"], aggs, changed)


@query("storage_path_map", """
    with p as (select page_id, case page_id % 6 when 0 then regexp_replace(url, '^https?', 'gs') when 1 then regexp_replace(url, '^https?', 'hdfs')
        when 2 then regexp_replace(url, '^https?', 's3a') when 3 then regexp_replace(url, '^https?://', 'abfss://box@')
        when 4 then regexp_replace(url, '^https?', 's3') else url end as path from pages)
    select page_id, path, case split_part(path, '://', 1) when 'gs' then 'transform' when 'abfss' then 'transform'
          when 'hdfs' then 'redesign' when 's3' then 'redesign' when 's3a' then 'redesign' else 'unknown' end as compatibility,
        regexp_extract(path, '^[a-z0-9]+://([^/@]+)', 1) as bucket,
        case when path like 'gs://%' then '/Shortcuts/gcs_' || regexp_extract(path, '^gs://([^/]+)', 1) || '/' ||
          regexp_extract(path, '^gs://[^/]+/(.*)$', 1) else '' end as target from p""")
def storage_path_map(t):
    u, k = F.col("url"), F.pmod("page_id", F.lit(6))
    swap = lambda s: F.regexp_replace(u, "^https?", s)
    path = (F.when(k == 0, swap("gs")).when(k == 1, swap("hdfs")).when(k == 2, swap("s3a"))
            .when(k == 3, F.regexp_replace(u, "^https?://", "abfss://box@")).when(k == 4, swap("s3")).otherwise(u))
    d = t.pages.select("page_id", path.alias("path"))
    m = d.withColumn("m", paths.map_path(F.col("path")))
    return m.select("page_id", "path", F.col("m.compatibility").alias("compatibility"),
                    paths.path_parts(F.col("path"))[1].alias("bucket"), F.col("m.target").alias("target"))


@query("report_tables", """
    select fmt, n_name, n from (select n_name, count(*)::bigint as n from customer join nation on c_nationkey = n_nationkey group by 1),
        (values ('csv'), ('json'), ('parquet')) f(fmt)""")
def report_tables(t):
    counts = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    out = None
    for fmt in ("csv", "json", "parquet"):
        d = sinks.write_report(counts, scratch(t.spark, f"report_{fmt}"), ["n_name"], fmt, single_file=True).select(F.lit(fmt).alias("fmt"), "*")
        out = d if out is None else out.unionByName(d)
    return out
