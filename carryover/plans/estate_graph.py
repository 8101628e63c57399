"""Lineage queries over the derived estate."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators import graph as G
from carryover.plans.registry import query
from carryover.sources.estate import CYCLIC_SQL, EDGES_SQL, estate_edges, estate_objects

# Levels and leftovers in SQL: the level of a node is its longest path from a root.
WAVES_SQL = """,
    inner_edges as (select child, parent from {edges} where parent in (select source_id from estate_objects)),
    walk(id, wave) as (select source_id, 1 from estate_objects union
        select e.child, w.wave + 1 from walk w join inner_edges e on e.parent = w.id),
    waves as (select id, max(wave)::bigint as wave from walk group by 1)"""

# Behind a cycle: what can be reached from a two-node loop.
STUCK_SQL = CYCLIC_SQL + """,
    inner_edges as (select child, parent from cyclic_edges where parent in (select source_id from estate_objects)),
    stuck(id) as (select a.child from inner_edges a join inner_edges b on a.child = b.parent and a.parent = b.child
        union select e.child from stuck s join inner_edges e on e.parent = s.id),
    walk(id, wave) as (select source_id, 1 from estate_objects where source_id not in (select id from stuck) union
        select e.child, w.wave + 1 from walk w join inner_edges e on e.parent = w.id and e.child not in (select id from stuck)),
    waves as (select id, max(wave)::bigint as wave, false as stuck from walk group by 1 union all
        select id, (select max(wave) + 1 from walk), true from stuck)"""


def nodes(t):
    return estate_objects(t).select(F.col("source_id").alias("id"))


@query("waves", EDGES_SQL + WAVES_SQL.format(edges="estate_edges") + " select id, wave, false as stuck from waves")
def waves(t):
    return G.waves(nodes(t), estate_edges(t))


@query("cycles", STUCK_SQL + " select id, wave, case when stuck then 'cycle_or_unresolved_dependency' else '' end as reason from waves")
def cycles(t):
    d = G.waves(nodes(t), estate_edges(t, cyclic=True))
    return d.select("id", "wave", F.when(F.col("stuck"), "cycle_or_unresolved_dependency").otherwise("").alias("reason"))


STREAM_SEEDS_SQL = """(kind in ('stream', 'pubsub_topic') or source_id in (select source_id from estate_properties where name = 'streaming' and value = 'true'))"""
CONSUMERS_SQL = f""",
    consumers(id) as (select e.child from estate_edges e join estate_objects o on e.parent = o.source_id where {STREAM_SEEDS_SQL}
        union select e.child from consumers c join estate_edges e on e.parent = c.id)"""


def stream_seeds(objects):
    hot = F.col("kind").isin("stream", "pubsub_topic") | F.coalesce(F.try_element_at("properties", F.lit("streaming")) == "true", F.lit(False))
    return objects.where(hot).select(F.col("source_id").alias("id"))


@query("stream_consumers", EDGES_SQL + CONSUMERS_SQL + " select id from consumers")
def stream_consumers(t):
    o = estate_objects(t)
    return G.downstream(stream_seeds(o), estate_edges(t))


@query("external_deps", EDGES_SQL + """
    select child as id, parent as dependency, 'External dependency ' || parent || ' required by ' || child as message,
        'external_dependency' as reason from estate_edges where parent not in (select source_id from estate_objects)""")
def external_deps(t):
    d = G.external_deps(nodes(t), estate_edges(t))
    return d.select(F.col("child").alias("id"), F.col("parent").alias("dependency"),
                    F.concat(F.lit("External dependency "), "parent", F.lit(" required by "), "child").alias("message"),
                    F.lit("external_dependency").alias("reason"))


def _seed(objects):
    return objects.where("kind = 'dataform_workflow' and properties['discovery_incomplete'] = 'true'").select(F.col("source_id").alias("id"))


@query("taint_propagation", STUCK_SQL + """,
    seeds as (select o.source_id as id from estate_objects o join estate_properties p using (source_id)
        where kind = 'dataform_workflow' and p.name = 'discovery_incomplete' and value = 'true' and source_id not in (select id from stuck)),
    tainted(id) as (select id from seeds union select e.child from tainted c join inner_edges e on e.parent = c.id
        where e.child not in (select id from stuck))
    select id, case when id in (select id from seeds) then 'incomplete_dataform_compilation' else 'depends_on_incomplete_dataform_compilation' end as reason
    from tainted""")
def taint_propagation(t):
    e = estate_edges(t, cyclic=True)
    w = G.waves(nodes(t), e)
    seeds = _seed(estate_objects(t)).withColumns({"direct": F.lit("incomplete_dataform_compilation"),
                                                  "derived": F.lit("depends_on_incomplete_dataform_compilation")})
    return G.taint(seeds, e, w.where("not stuck"))


@query("wave_dependencies", EDGES_SQL + WAVES_SQL.format(edges="estate_edges") + """
    select distinct c.wave as wave, p.wave as depends_on from inner_edges e join waves c on e.child = c.id join waves p on e.parent = p.id where p.wave < c.wave""")
def wave_dependencies(t):
    e = estate_edges(t)
    return G.wave_dependencies(G.waves(nodes(t), e), e)


# A target and up to two reasons per component, enough to exercise the rollup.
_ITEMS_SQL = EDGES_SQL + WAVES_SQL.format(edges="estate_edges") + """,
    items as (select source_id as id, wave, case when k % 3 = 0 then 'manual' when k % 3 = 1 then 'warehouse' else 'data_pipeline' end as target,
        (case when size_bytes is null then 1 else 0 end + case when kind in ('security_policy', 'bqml_model') then 1 else 0 end) as reasons
        from estate_objects join waves on id = source_id),
    msgs as (select child as id, count(distinct parent) as m from estate_edges where parent not in (select source_id from estate_objects) group by 1),
    roll as (select wave, count(*)::bigint as items, count_if(reasons > 0)::bigint as manual_reviews, sum(reasons + coalesce(m, 0))::bigint as blockers,
        count_if(target in ('manual', 'data_pipeline')) as heavy from items left join msgs using (id) group by 1),
    rollup_ as (select wave, items, manual_reviews, blockers, case when blockers > 0 then 'blocked' else 'ready_for_review' end as status,
        case when items + blockers + heavy >= 12 then 'XL' when items + blockers + heavy >= 7 then 'L' when items + blockers + heavy >= 3 then 'M' else 'S' end as effort_band
        from roll)"""


def _rollup(t):
    e, o = estate_edges(t), estate_objects(t)
    w = G.waves(nodes(t), e)
    k = F.col("k") % 3
    items = w.join(o, w.id == o.source_id).select(
        "id", "wave", F.when(k == 0, "manual").when(k == 1, "warehouse").otherwise("data_pipeline").alias("target"),
        F.array_compact(F.array(F.when(F.col("size_bytes").isNull(), "missing_required_evidence"),
                                F.when(F.col("kind").isin("security_policy", "bqml_model"), "incompatible_mapping"))).alias("reasons"))
    ext = G.external_deps(nodes(t), e).select(F.col("child").alias("id"), F.col("parent").alias("message"))
    return w, e, G.wave_rollup(items, ext)


@query("wave_rollup", _ITEMS_SQL + " select * from rollup_")
def wave_rollup(t):
    return _rollup(t)[2]


@query("wave_approval", _ITEMS_SQL + """,
    deps as (select distinct c.wave as wave, p.wave as depends_on from inner_edges e join waves c on e.child = c.id join waves p on e.parent = p.id where p.wave < c.wave),
    bad(w) as (select wave from rollup_ where status <> 'ready_for_review' union select deps.wave from bad join deps on depends_on = w)
    select wave, 'cannot approve a ' || status || ' wave' as error from rollup_ where status <> 'ready_for_review'
    union all select distinct wave, 'dependency waves are not approved' from deps where depends_on in (select w from bad)
    union all select (select max(wave) + 5 from rollup_), 'not in the plan'
    union all select 1, 'more than one decision'""")
def wave_approval(t):
    """Every wave is approved, one of them twice, and one that does not exist."""
    w, e, roll = _rollup(t)
    from carryover.session import settle
    roll = settle(roll, "rollup")
    every = roll.select("wave")
    extra = roll.agg((F.max("wave") + 5).alias("wave")).unionByName(roll.agg(F.lit(1).cast("long").alias("wave")))
    decisions = every.unionByName(extra).select("wave", F.lit("approved").alias("decision"), F.lit("board").alias("owner"))
    return G.apply_decisions(roll, G.wave_dependencies(w, e), decisions)[1]


@query("ref_graph_check", CYCLIC_SQL + """,
    inner_edges as (select child, parent from cyclic_edges where parent in (select source_id from estate_objects)),
    up(id, above) as (select child, parent from inner_edges union select u.id, e.parent from up u join inner_edges e on e.child = u.above)
    select child as id, parent as ref, 'missing_model' as problem from cyclic_edges where parent not in (select source_id from estate_objects)
    union all select id, '', 'cycle' from up where id = above""")
def ref_graph_check(t):
    e = estate_edges(t, cyclic=True)
    missing = G.external_deps(nodes(t), e).select(F.col("child").alias("id"), F.col("parent").alias("ref"), F.lit("missing_model").alias("problem"))
    loops = G.on_cycle(G.inside(nodes(t), e)).select("id", F.lit("").alias("ref"), F.lit("cycle").alias("problem"))
    return missing.unionByName(loops)


@query("lineage_export", EDGES_SQL + """
    select 'node' as type, source_id as id, kind as detail from estate_objects union all select 'edge', child, parent from estate_edges""")
def lineage_export(t):
    n = estate_objects(t).select(F.lit("node").alias("type"), F.col("source_id").alias("id"), F.col("kind").alias("detail"))
    e = estate_edges(t).select(F.lit("edge").alias("type"), F.col("child").alias("id"), F.col("parent").alias("detail"))
    return n.unionByName(e).orderBy("type", "id", "detail")


@query("lineage_edges", """
    with q as (select o_orderkey as id, case o_orderstatus when 'F' then 'p1.sales.orders' when 'O' then 'sales.returns' else 'stock' end as a,
        'ref.c' || (o_custkey % 50) as b from orders)
    select id, case length(a) - length(replace(a, '.', '')) when 0 then 'home.main.' || a when 1 then 'home.' || a else a end as ref from q
    union select id, 'home.' || b from q""")
def lineage_edges(t):
    from carryover.operators.sqlscan import table_references
    a = F.when(F.col("o_orderstatus") == "F", "`p1.sales.orders`").when(F.col("o_orderstatus") == "O", "sales.returns").otherwise("stock")
    sql = F.concat(F.lit("WITH w AS (SELECT 'FROM fake.t' AS s FROM "), a, F.lit(") -- from old.t\nSELECT * FROM w JOIN ref.c"),
                   F.col("o_custkey") % 50, F.lit(" USING (id)"))
    d = t.orders.select(F.col("o_orderkey").alias("id"), sql.alias("sql"))
    return table_references(d, "id", "sql", project="home", dataset="main")
