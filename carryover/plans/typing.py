"""Type mapping, casting and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators import reshape, typemap
from carryover.plans.registry import query
from carryover.sources.estate import COLUMNS_SQL, TYPE_CASE_SQL, estate_columns


def _case(pairs, other):
    return f"case {TYPE_CASE_SQL['norm']} " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs) + f" else '{other}' end"


@query("type_map", COLUMNS_SQL + f"""
    select source_id, path, data_type, {TYPE_CASE_SQL['target']} as target_type, {TYPE_CASE_SQL['compat']} as compatibility,
        {_case(typemap.WAREHOUSE_TYPES, 'none')} as warehouse_type,
        case when {TYPE_CASE_SQL['compat']} = 'unsupported' then '{typemap.UNKNOWN_TYPE_NOTE}' else {_case(typemap.TYPE_NOTES, '')} end as note from estate_columns""")
def type_map(t):
    return typemap.map_types(estate_columns(t)).select("source_id", "path", "data_type", "target_type", "compatibility", "warehouse_type", "note")


@query("type_findings", COLUMNS_SQL + f""", m as (select source_id, path, {TYPE_CASE_SQL['norm']} as source_type,
        {TYPE_CASE_SQL['compat']} as c from estate_columns)
    select source_id, source_type, string_agg(path, ', ' order by path) as paths,
        case c when 'redesign' then 'WARN' else 'FAIL' end as severity,
        case c when 'redesign' then 'TYPE_REDESIGN' else 'TYPE_UNSUPPORTED' end as code
    from m where c in ('redesign', 'unsupported') group by source_id, source_type, c""")
def type_findings(t):
    return typemap.type_findings(typemap.map_types(estate_columns(t)))


@query("cast_to_target", """
    select o_orderkey, o_totalprice::decimal(18,9)::double as o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate,
        o_orderstatus, o_custkey::double as o_custkey from orders""")
def cast_to_target(t):
    d = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_custkey")
    out = typemap.cast_to_target(d, {"o_orderkey": "INTEGER", "o_totalprice": "NUMERIC(18,2)", "o_orderdate": "DATETIME",
                                     "o_orderstatus": "STRING", "o_custkey": "FLOAT64"})
    return out.withColumns({"o_totalprice": F.col("o_totalprice").cast("double"),
                            "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd")})


@query("decimal_fit_profile", """
    select 'price' as "column", count(*)::bigint as n, count_if(x >= 1e20)::bigint as no_fit_38_18, count_if(x >= 1e29)::bigint as no_fit_38_9
        from (select o_totalprice * 1e15 as x from orders)
    union all select 'scaled', count(*), count_if(y >= 1e20), count_if(y >= 1e29) from (select o_totalprice * 1e24 as y from orders)""")
def decimal_fit_profile(t):
    d = t.orders.select((F.col("o_totalprice") * 1e15).alias("price"), (F.col("o_totalprice") * 1e24).alias("scaled"))
    return typemap.decimal_fit(d, ["price", "scaled"])


@query("string_length_profile", """
    with x as (select 'text' as "column", length(text)::bigint as len from documents union all select 'lang', length(lang) from documents
               union all select 'source', length(source) from documents)
    select "column", max(len)::bigint as max_len, sum(len)::double / count(*) as avg_len, count(*)::bigint as n,
        quantile_cont(len, 0.5)::double as p_len from x group by 1""")
def string_length_profile(t):
    return typemap.string_lengths(t.documents, ["text", "lang", "source"], 0.5)


@query("civil_vs_instant", """
    select event_type, count(*)::bigint as n, count_if((ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' <> ts)::bigint as would_shift,
        strftime(max((ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') as last_utc,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_civil from events group by 1""")
def civil_vs_instant(t):
    civil = F.col("ts").cast("timestamp_ntz")
    utc = F.to_utc_timestamp(civil.cast("timestamp"), "America/New_York").cast("timestamp_ntz")
    d = t.events.select("event_type", civil.alias("civil"), utc.alias("utc"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return d.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("utc") != F.col("civil")).alias("would_shift"),
        F.date_format(F.max("utc"), fmt).alias("last_utc"), F.date_format(F.max("civil"), fmt).alias("last_civil"))


@query("flatten_struct", """
    select o_orderkey as id, o_custkey as customer_key, o_orderpriority as meta_priority, o_orderstatus as meta_state_code from orders""")
def flatten_struct(t):
    nested = t.orders.select(
        F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key")).alias("customer"),
        F.struct(F.col("o_orderpriority").alias("priority"), F.struct(F.col("o_orderstatus").alias("code")).alias("state")).alias("meta"))
    return reshape.flatten_struct(nested)


@query("array_to_child", """
    select vec_id, coalesce(generate_subscripts(e, 1) - 1, -1) as ordinal, unnest(e)::double as item
    from (select vec_id, case when label > 0 then embedding end as e from embeddings) where e is not null
    union all select vec_id, -1, -99.0 from embeddings where not label > 0""")
def array_to_child(t):
    d = t.embeddings.select("vec_id", F.when(F.col("label") > 0, F.col("embedding")).alias("e"))
    return reshape.array_to_child(d, ["vec_id"], "e").select(
        "vec_id", F.coalesce(F.col("ordinal").cast("long"), F.lit(-1)).alias("ordinal"),
        F.coalesce(F.col("item").cast("double"), F.lit(-99.0)).alias("item"))


@query("range_split", """
    select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as start, case when o_orderstatus = 'F' then
        strftime(o_orderdate::date + 30, '%Y-%m-%d') else 'open' end as "end" from orders""")
def range_split(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    end = F.when(F.col("o_orderstatus") == "F", day(F.date_add(F.to_date("o_orderdate"), 30))).otherwise("UNBOUNDED")
    d = t.orders.select("o_orderkey", F.concat(F.lit("["), day("o_orderdate"), F.lit(", "), end, F.lit(")")).alias("r"))
    lo, hi = typemap.range_split(F.col("r"))
    return d.select("o_orderkey", lo.alias("start"), F.coalesce(hi, F.lit("open")).alias("end"))


@query("json_bronze_silver", """
    select event_id, props as raw, (json_extract_string(props, '$.k'))::bigint as k, value from events""")
def json_bronze_silver(t):
    bronze = t.events.select("event_id", "props", "value")
    return bronze.select("event_id", F.col("props").alias("raw"),
                         F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"), "value")


@query("interval_parts", """
    select l_orderkey, l_partkey, l_linenumber, (l_linenumber * 12 + l_quantity::bigint % 12)::bigint as months, l_quantity::bigint as days,
        ((l_linenumber::bigint * 3600 + 90) * 1000000 + 250000)::double as micros_d, ((l_linenumber::bigint * 3600 + 90) * 1000000 + 250000)::bigint as micros from lineitem""")
def interval_parts(t):
    q = F.col("l_quantity").cast("long")
    text = F.concat(F.col("l_linenumber"), F.lit("-"), q % 12, F.lit(" "), q, F.lit(" "), F.col("l_linenumber"), F.lit(":1:30.25"))
    d = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", text.alias("i"))
    months, days, micros = typemap.interval_parts(F.col("i"))
    return d.select("l_orderkey", "l_partkey", "l_linenumber", months.alias("months"), days.alias("days"), micros.alias("micros"),
                    micros.cast("double").alias("micros_d"))


@query("nested_flag", COLUMNS_SQL + f"""
    select source_id, bool_or(mode = 'REPEATED' or {TYPE_CASE_SQL['norm']} in ('ARRAY', 'STRUCT', 'JSON')) as nested from estate_columns group by 1""")
def nested_flag(t):
    d = estate_columns(t).withColumn("ty", typemap.normal_type(F.col("data_type")))
    hit = (F.col("mode") == "REPEATED") | F.col("ty").isin("ARRAY", "STRUCT", "JSON")
    return d.groupBy("source_id").agg(F.bool_or(hit).alias("nested"))
