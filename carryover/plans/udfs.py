"""User-function queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from carryover.operators import aggregates as A
from carryover.operators import functions_ext as U
from carryover.plans.registry import query
from carryover.plans.scans import SCRIPTS_SQL, scripts


@query("sql_udf", """
    select l_orderkey, l_partkey, l_linenumber, l_extendedprice::decimal(18,2) * (1 - l_discount::decimal(18,2)) * 1.0 = l_extendedprice::decimal(18,2) as full_price,
        (l_extendedprice::decimal(18,2) * (1 - l_discount::decimal(18,2)))::double as net from lineitem""")
def sql_udf(t):
    U.sql_function(t.spark, "net_price", "price double, discount double", "decimal(38,4)", "cast(price as decimal(18,2)) * (1 - cast(discount as decimal(18,2)))")
    t.lineitem.createOrReplaceTempView("sql_udf_lineitem")
    return t.spark.sql("""select l_orderkey, l_partkey, l_linenumber, net_price(l_extendedprice, l_discount) = cast(l_extendedprice as decimal(18,2)) as full_price,
        cast(net_price(l_extendedprice, l_discount) as double) as net from sql_udf_lineitem""")


# What the script functions returned for these inputs when they were recorded (fixed values); the last is wrong.
RECORDED = [("reverse", "a b", "b a"), ("reverse", "", ""), ("reverse", "straße", "eßarts"), ("trim", "  x y ", "x y"), ("trim", "x", "x"),
            ("hash_id", "abc", "ba7816bf8f01cfea"), ("hash_id", "", "e3b0c44298fc1c14"), ("reverse", "once", "wrong")]


@query("js_udf_port", """
    select c_custkey, reverse(c_name) as reversed, trim('  ' || c_mktsegment || ' ') as trimmed, substr(sha256(c_name), 1, 16) as hashed, 7::bigint as passed, 1::bigint as failed from customer""")
def js_udf_port(t):
    """The ports over a table, beside how many recorded cases they meet."""
    port = U.SCRIPT_PORTS
    cases = t.spark.createDataFrame(RECORDED, "port string, input string, expected string")
    checked = reduce(lambda a, b: a.unionByName(b), [U.port_check(cases.where(F.col("port") == p), p) for p in port])
    met = checked.agg(F.count_if("matches").alias("passed"), F.count_if(~F.col("matches")).alias("failed"))
    d = t.customer.select("c_custkey", port["reverse"](F.col("c_name")).alias("reversed"),
                          port["trim"](F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("trimmed"), port["hash_id"](F.col("c_name")).alias("hashed"))
    return d.withColumns({c: met.select(c).scalar() for c in ("passed", "failed")})


@query("remote_fn_batch", "select doc_id, lang || ':' || length(source) as answer from documents")
def remote_fn_batch(t):
    """A stand-in answers for the remote endpoint."""
    d = t.documents.select("doc_id", F.concat_ws("|", "lang", "source").alias("request"))
    answer = lambda rows: [f"{r.split('|', 1)[0]}:{len(r.split('|', 1)[1])}" for r in rows]
    return U.remote_function(d, "request", "answer", "string", answer, 200).select("doc_id", "answer")


@query("custom_udaf", """
    select l_returnflag, l_linestatus, round((sum(l_extendedprice::decimal(18,2) * l_quantity::decimal(18,2)) / sum(l_quantity::decimal(18,2)))::double, 6) as price,
        round((sum(l_extendedprice::decimal(18,2) * l_extendedprice::decimal(18,2))::double / pow(sum(l_extendedprice::decimal(18,2))::double, 2)), 12) as concentration
    from lineitem group by all""")
def custom_udaf(t):
    d = A.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], {"price": "l_extendedprice", "quantity": "l_quantity"},
                    price=A.exact_weighted_mean("price", "quantity"), concentration=A.exact_concentration("price"))
    return d.select("l_returnflag", "l_linestatus", F.round("price", 6).alias("price"), F.round("concentration", 12).alias("concentration"))


@query("sequence_mean", "select vec_id, round(list_sum(embedding::double[]) / len(embedding), 9) as mean from embeddings")
def sequence_mean(t):
    return t.embeddings.select("vec_id", F.round(U.sequence_mean(F.col("embedding")), 9).alias("mean"))


@query("table_fn", SCRIPTS_SQL + " select id, position, md5(statement) as statement from parts")
def table_fn(t):
    U.register_splitter(t.spark)
    return t.spark.sql("select id, cast(position as bigint) as position, md5(statement) as statement from split_statements(table({scripts}))", scripts=scripts(t))
