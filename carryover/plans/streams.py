"""Streaming queries over the event table, each run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions.canonical import money
from carryover.operators.windows import latest_per_key
from carryover.plans.registry import query
from carryover.session import scratch
from carryover.sources.sinks import parse_json_events
from carryover.streaming import operators as S

FMT = "yyyy-MM-dd HH:mm:ss"


def stream(t, **options):
    return S.events_stream(t.spark, f"{t.root}/events*.parquet", t.events.schema, **options)


def finish(t, df, name, mode="append"):
    path = scratch(t.spark, name)
    S.run_to_files(df, path, path + "-ckpt", mode)
    return t.spark.read.schema(df.schema).parquet(path)


def finish_windows(t, build, name):
    """Run ``build(stream)`` over all input, then once more to emit the windows still open."""
    path, ends = scratch(t.spark, name), scratch(t.spark, f"{name}-end")
    src = S.with_end(stream(t), ends)
    df = build(src)
    S.run_to_files(df, path, path + "-ckpt")
    S.mark_end(src, ends)
    S.run_to_files(df, path, path + "-ckpt")
    return t.spark.read.schema(df.schema).parquet(path)


@query("stream_ingest", """
    select event_id, case when event_type = 'error' then -1 else (json_extract_string(props, '$.k'))::bigint end as k,
        event_type = 'error' as quarantined, true as stamped from events""")
def stream_ingest(t):
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), "props")).otherwise(F.col("props"))
    d = finish(t, parse_json_events(stream(t).select("event_id", raw.alias("raw")), "raw", "k bigint"), "ingest")
    return d.select("event_id", F.coalesce("k", F.lit(-1)).alias("k"), F.col("_bad").isNotNull().alias("quarantined"), F.col("_ingestion_time").isNotNull().alias("stamped"))


@query("stream_hourly_counts", """
    with w as (select date_trunc('hour', ts) as s, date_trunc('hour', ts) + interval 1 hour as "end", event_type, count(*)::bigint as n from events group by all)
    select strftime(s, '%Y-%m-%d %H:%M:%S') as start, event_type, n from w""")
def stream_hourly_counts(t):
    d = finish_windows(t, lambda e: S.windowed(e, "ts", "1 hour", "1 hour", None, ["event_type"], [F.count("*").alias("n")]), "hourly")
    return d.select(F.date_format("start", FMT).alias("start"), "event_type", "n")


@query("stream_tumbling_sum", """
    with w as (select time_bucket(interval 10 minute, ts) as s, time_bucket(interval 10 minute, ts) + interval 10 minute as "end", sum(value::decimal(18,2))::double as total from events group by all)
    select strftime(s, '%Y-%m-%d %H:%M:%S') as start, total from w""")
def stream_tumbling_sum(t):
    d = finish_windows(t, lambda e: S.windowed(e, "ts", "1 hour", "10 minutes", None, [], [F.sum(money("value")).alias("total")]), "tumbling")
    return d.select(F.date_format("start", FMT).alias("start"), F.col("total").cast("double").alias("total"))


@query("stream_filter", "select event_id, user_id, value from events where event_type = 'purchase' and value > 10")
def stream_filter(t):
    return finish(t, stream(t).where("event_type = 'purchase' and value > 10").select("event_id", "user_id", "value"), "filter")


@query("stream_dedupe", "select event_id, user_id, event_type from events")
def stream_dedupe(t):
    """The source is read twice, as after a redelivery; each event passes once."""
    twice = stream(t).unionByName(stream(t)).select("event_id", "user_id", "event_type", "ts")
    return finish(t, S.dedupe(twice, "ts", "1 hour", ["event_id"]), "dedupe").select("event_id", "user_id", "event_type")


@query("stream_idempotent_sink", "select event_type, count(*)::bigint as n, sum(value::decimal(18,2))::double as total from events group by 1")
def stream_idempotent_sink(t):
    """Two runs from scratch send every batch twice; the stored result is that of one."""
    path = scratch(t.spark, "idem")
    for run in ("a", "b"):
        S.run_batches(stream(t), S.idempotent_sink(path), f"{path}-ckpt-{run}")
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(money("value")).cast("double").alias("total"))


@query("stream_late_data", """
    with w as (select date_trunc('hour', ts) as s, date_trunc('hour', ts) + interval 1 hour as "end", count(*)::bigint as n from events group by all)
    select strftime(s, '%Y-%m-%d %H:%M:%S') as start, n, true as late_dropped from w""")
def stream_late_data(t):
    """On-time events run first; then the oldest half arrives again, behind the watermark."""
    src, path, ends = scratch(t.spark, "late_src"), scratch(t.spark, "late"), scratch(t.spark, "late-end")
    t.events.write.parquet(src)
    events = S.with_end(S.events_stream(t.spark, src, t.events.schema), ends)
    d = S.windowed(events, "ts", "1 hour", "1 hour", None, [], [F.count("*").alias("n")])
    S.run_to_files(d, path, path + "-ckpt")
    edge = t.events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2")).scalar()
    t.events.where(F.col("ts") < edge).write.mode("append").parquet(src)
    q = S.run_to_files(d, path, path + "-ckpt")
    S.mark_end(events, ends)
    S.run_to_files(d, path, path + "-ckpt")
    out = t.spark.read.schema(d.schema).parquet(path)
    return out.select(F.date_format("start", FMT).alias("start"), "n", F.lit(S.dropped_rows(q) > 0).alias("late_dropped"))


@query("stream_sliding", """
    with w as (select s, s + interval 1 hour as "end", count(*)::bigint as n from (
        select unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as s from events) group by all)
    select strftime(s, '%Y-%m-%d %H:%M:%S') as start, n from w""")
def stream_sliding(t):
    d = finish_windows(t, lambda e: S.windowed(e, "ts", "1 hour", "1 hour", "30 minutes", [], [F.count("*").alias("n")]), "sliding")
    return d.select(F.date_format("start", FMT).alias("start"), "n")


@query("stream_session", """
    with e as (select user_id, ts, case when ts - lag(ts) over w <= interval 2 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, fresh rows unbounded preceding) as sid from e),
    g as (select user_id, min(ts) as a, max(ts) + interval 2 hour as "end", count(*)::bigint as n from s group by user_id, sid)
    select user_id, strftime(a, '%Y-%m-%d %H:%M:%S') as start, n from g""")
def stream_session(t):
    d = finish_windows(t, lambda e: S.sessions(e, "ts", "1 hour", "2 hours", ["user_id"], [F.count("*").alias("n")]), "session")
    return d.select("user_id", F.date_format("start", FMT).alias("start"), "n")


@query("stream_state", """
    select user_id, count(*)::bigint as events, sum(value::decimal(18,2))::double as total, max(value) as peak from events group by 1""")
def stream_state(t):
    """Running state per user, kept by a state function with a timer; rows are combined per task
    and batch before they reach it. No user is idle for two years."""
    own = S.state_session(t.spark)
    events = S.events_stream(own, f"{t.root}/events*.parquet", t.events.schema).withColumn("cents", money("value") * 100)
    d = S.running_totals(events, "user_id", "ts", "cents", "value", "1 hour", 730 * 86_400_000)
    path = scratch(t.spark, "state")
    S.run_batches(d, S.idempotent_sink(path), path + "-ckpt", "update")
    last = latest_per_key(t.spark.read.parquet(path), ["key"], ["batch_id"])
    return last.select(F.col("key").alias("user_id"), "events", (F.col("total") / 100).alias("total"), "peak")


@query("stream_trigger_checkpoint", """
    select event_type, count(*)::bigint as n, count(distinct event_id)::bigint as ids from events group by 1""")
def stream_trigger_checkpoint(t):
    """One file per trigger, stopped after the first half and started again."""
    src, path = scratch(t.spark, "trig_src"), scratch(t.spark, "trig")
    edge = t.events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2")).scalar()
    t.events.where(F.col("ts") < edge).write.parquet(src)
    d = S.events_stream(t.spark, src, t.events.schema, maxFilesPerTrigger="1").select("event_id", "event_type")
    S.run_to_files(d, path, path + "-ckpt")
    t.events.where(F.col("ts") >= edge).write.mode("append").parquet(src)
    S.run_to_files(d, path, path + "-ckpt")
    out = t.spark.read.schema(d.schema).parquet(path)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("retention", "select event_id, value from events where ts >= timestamp '2024-04-05 00:00:00' - interval 90 day")
def retention(t):
    return S.retained(t.events, "ts", "2024-04-05 00:00:00", 90).select("event_id", "value")


@query("stream_cdc_apply", """
    with base as (select c_custkey as id, c_mktsegment as state, c_acctbal as value from customer),
    ch as (select user_id as id, event_type as state, value, case when event_type = 'error' then 'delete' else 'update' end as op from events
        qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
    select coalesce(ch.id, base.id) as id, coalesce(ch.state, base.state) as state, coalesce(ch.value, base.value) as value
    from base full join ch on base.id = ch.id where coalesce(op, '') <> 'delete'""")
def stream_cdc_apply(t):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state"), F.col("c_acctbal").alias("value"))
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    ch = stream(t).select(F.col("user_id").alias("id"), F.col("event_type").alias("state"), "value", op.alias("op"), "ts", "event_id")
    path = scratch(t.spark, "cdc")
    S.run_batches(ch, S.cdc_sink(path, ["id"], ["ts", "event_id"]), path + "-ckpt")
    return S.cdc_table(base, path, ["id"], ["ts", "event_id"])


@query("stream_static_enrich", """
    select event_id, coalesce(c_mktsegment, 'unknown') as segment from events left join customer on user_id = c_custkey""")
def stream_static_enrich(t):
    ref = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    d = S.enrich(stream(t), ref, "user_id").select("event_id", F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"))
    return finish(t, d, "enrich")
