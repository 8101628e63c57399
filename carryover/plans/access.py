"""Access-control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions.canonical import pseudonym
from carryover.operators import access as X
from carryover.plans.registry import query


@query("row_filter", """
    select 'analyst' as principal, c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')
    union all select 'regional', c_custkey, c_mktsegment from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)""")
def row_filter(t):
    who = lambda d, p: d.select(F.lit(p).alias("principal"), "c_custkey", "c_mktsegment")
    policies = {"analyst": ["BUILDING", "MACHINERY"]}
    a = who(X.row_filter(t.customer, "c_mktsegment", policies, "analyst"), "analyst")
    none = who(X.row_filter(t.customer, "c_mktsegment", policies, "stranger"), "stranger")
    grants = t.nation.where("n_regionkey = 2").select(F.lit("regional").alias("principal"), F.col("n_nationkey").alias("value"))
    r = who(X.row_filter_by_grants(t.customer, "c_nationkey", grants, "regional"), "regional")
    return a.unionByName(none).unionByName(r)


@query("column_access", "select c_custkey, 'hidden' as c_name, c_mktsegment from customer")
def column_access(t):
    d = X.column_access(t.customer, {"c_name": "pii", "c_acctbal": "finance", "c_nationkey": "finance"}, set())
    d = X.column_access(d, {"c_acctbal": "finance", "c_nationkey": "finance"}, {"pii"}, "drop")
    return d.na.fill("hidden", ["c_name"])


@query("data_masking", """
    select c_custkey, substr(sha256(c_name), 1, 12) as c_name, repeat('*', length(c_mktsegment) - 4) || right(c_mktsegment, 4) as c_mktsegment,
        true as balance_hidden from customer""")
def data_masking(t):
    d = X.masked(t.customer, {"c_name": "hash", "c_mktsegment": "last4", "c_acctbal": "null"})
    return d.select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").isNull().alias("balance_hidden"))


@query("authorized_view", "select c_mktsegment, count(*)::bigint as n from customer where c_acctbal >= 0 group by 1")
def authorized_view(t):
    v = X.authorized_view(t.customer, ["c_custkey", "c_mktsegment"], F.col("c_acctbal") >= 0, "customer_public")
    return v.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("grants_audit", """
    select c_custkey as policy_id, case when c_mktsegment = 'BUILDING' then c_name || '@example.com' else 'group:' || c_mktsegment end as grantee
    from customer where c_mktsegment in ('BUILDING', 'MACHINERY')""")
def grants_audit(t):
    mail = F.concat("c_name", F.lit("@example.com"))
    second = (F.when(F.col("c_mktsegment") == "BUILDING", mail)
              .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("group:"), "c_mktsegment")).otherwise(pseudonym(mail)))
    return X.audit_grantees(t.customer.select(F.col("c_custkey").alias("policy_id"), F.array(pseudonym(F.col("c_name")), second).alias("grantees")))


@query("attribute_grant", """
    select o_orderkey, coalesce(case when substr(o_orderpriority, 1, 1) in ('1', '2') then o_totalprice end, -1) as o_totalprice from orders""")
def attribute_grant(t):
    d = X.attribute_grant(t.orders, "o_totalprice", F.substring("o_orderpriority", 1, 1), ["1", "2"])
    return d.select("o_orderkey", F.coalesce("o_totalprice", F.lit(-1.0)).alias("o_totalprice"))
