"""Fixed points over a dependency table: waves, cycles, downstream closures.

``nodes(id)`` and ``edges(child, parent)`` stay DataFrames. Loops go by path doubling: round k
joins a table of who is exactly ``2 ** k`` edges away, so a graph of a thousand levels takes
ten rounds. Where such a table would outgrow the edges (hubs of hubs), waves fall back to
peeling level by level, and closures to sweeps over the tables they have; the results are the
same. Rounds are written to the shared folder and their counters observed on the way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.session import settle, settle_counted

MAX_ROUNDS = 10_000
#: Both sides of a loop's joins are as large as the graph. Spark would broadcast those whose files
#: are below its limit, many times their size in memory, through the driver and in every round.
SHUFFLED = "merge"
#: A table of far pairs may have so many times the edges, or so many rows if that is more.
GROWTH, ROOMY = 8, 1 << 20


def inside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends belong to the estate."""
    ids = nodes.select("id").hint(SHUFFLED)
    e = edges.join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")
    return e.join(ids.withColumnRenamed("id", "child"), "child", "left_semi").select("child", "parent").distinct()


def external_deps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies that are not part of the estate."""
    return edges.join(nodes.select(F.col("id").alias("parent")).hint(SHUFFLED), "parent", "left_anti").select("child", "parent").distinct()


def peel(edges: DataFrame, tip: str, base: str) -> tuple[list[DataFrame], DataFrame]:
    """Remove nodes without open edges, level by level.

    Returns the edges removed in each round and the edges that never come free. An edge
    goes in the round after its ``base`` node has no edge left of its own.
    """
    rounds: list[DataFrame] = []
    left = settle(edges.select(tip, base), "peel")
    free = left.select(F.col(base).alias("_id")).distinct().join(left.select(F.col(tip).alias("_id")), "_id", "left_anti")
    for _ in range(MAX_ROUNDS):
        marked = left.join(free.select(F.col("_id").alias(base), F.lit(True).alias("_hit")), base, "left")
        marked, n = settle_counted(marked.select(tip, base, F.coalesce("_hit", F.lit(False)).alias("_hit")), "peel",
                                   hit=F.count_if(F.col("_hit")), left=F.count_if(~F.col("_hit")))
        if n["hit"] == 0:
            return rounds, left
        gone, left = marked.where("_hit").select(tip, base), marked.where("not _hit").select(tip, base)
        rounds.append(gone)
        if n["left"] == 0:
            return rounds, left
        free = gone.select(F.col(tip).alias("_id")).distinct().join(left.select(F.col(tip).alias("_id")), "_id", "left_anti")
    raise RuntimeError("the graph is deeper than the round limit")


class Steps:
    """Edges and, as far as they are asked for, the pairs 2, 4, 8, ... edges apart."""

    def __init__(self, edges: DataFrame):
        first, n = settle_counted(edges.select("child", "parent").distinct(), "steps", n=F.count(F.lit(1)))
        self.at, self.rows, self.limit = [first], [n["n"]], max(GROWTH * n["n"], ROOMY)

    def grow(self) -> bool:
        """Join the farthest pairs with themselves, unless that makes too many: the product of
        degrees says so before."""
        far, pairs = self.at[-1], self.rows[-1] ** 2
        if pairs > self.limit:
            above, below = far.groupBy("child").agg(F.count(F.lit(1)).alias("_a")), far.groupBy("parent").agg(F.count(F.lit(1)).alias("_b"))
            pairs = above.join(below.hint(SHUFFLED), F.col("child") == F.col("parent")).agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0
        if pairs > self.limit:
            return False
        low, high = far.select("child", F.col("parent").alias("_mid")), far.select(F.col("child").alias("_mid"), "parent")
        more, n = settle_counted(low.join(high.hint(SHUFFLED), "_mid").select("child", "parent").distinct(), "steps", n=F.count(F.lit(1)))
        self.at.append(more)
        self.rows.append(n["n"])
        return True


def levels(ids: DataFrame, steps: Steps) -> DataFrame:
    """``id, level, stuck``: the longest way up from each node, in edges; without an end (on or
    behind a cycle) the node is stuck. By peeling if the far pairs are too many.

    After round k a level is exact below ``2 ** (k + 1) - 1`` and held there. A node of a finite
    level has one of every lower level above it; so if the value below the bound is missing,
    all that are held at it have no end.
    """
    k, d = 0, ids.select("id", F.lit(0).cast("long").alias("level"))
    while True:
        far = d.join(steps.at[k].select(F.col("parent").alias("id"), "child").hint(SHUFFLED), "id").select(F.col("child").alias("id"), (F.col("level") + (1 << k)).alias("level"))
        held = (2 << k) - 1
        d, n = settle_counted(d.unionByName(far).groupBy("id").agg(F.max("level").alias("level")), "levels",
                              held=F.count_if(F.col("level") >= held), last=F.max(F.when(F.col("level") < held, F.col("level") + 1)))
        if not n["held"] or n["last"] < held:
            return d.withColumn("stuck", F.col("level") >= held)
        if not steps.grow():
            return settle(peeled(ids, steps.at[0]), "levels")
        k += 1


def peeled(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``levels``, by peeling."""
    rounds, left = peel(edges, "child", "parent")
    # A node follows the round that removed the last of its edges.
    gone = [g.select(F.col("child").alias("id"), F.lit(i + 1).cast("long").alias("level")) for i, g in enumerate(rounds)]
    level = reduce(lambda a, b: a.unionByName(b), gone, ids.select("id", F.lit(0).cast("long").alias("level"))).groupBy("id").agg(F.max("level").alias("level"))
    stuck = left.select(F.col("child").alias("id")).distinct().withColumn("stuck", F.lit(True))
    return level.join(stuck, "id", "left").na.fill(False, ["stuck"])


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, wave, stuck``: a node is ready when everything it depends on inside the
    estate is done. Nodes on or behind a cycle never get ready; all of them share the
    wave after the last one."""
    ids = nodes.select("id").distinct()
    d = levels(ids, Steps(inside(nodes, edges)))
    last = d.agg(F.coalesce(F.max(F.when(~F.col("stuck"), F.col("level") + 1)), F.lit(0)) + 1).scalar()
    return d.select("id", F.when(F.col("stuck"), last).otherwise(F.col("level") + 1).cast("long").alias("wave"), "stuck")


def reach(start: DataFrame, steps: Steps) -> DataFrame:
    """The rows of ``start(id, ...)`` and all below them; further columns travel along.

    Round k adds what is ``2 ** k`` edges below; if that is nothing, nothing lies farther.
    """
    keys = start.columns

    def below(d: DataFrame, e: DataFrame) -> DataFrame:
        down = d.withColumnRenamed("id", "parent").join(e.hint(SHUFFLED), "parent").withColumnRenamed("child", "id").select(*keys)
        return d.unionByName(down).distinct()

    seen, now = settle_counted(start.distinct(), "reached", n=F.count(F.lit(1)))
    k, room = 0, True
    while True:
        had = now["n"]
        # without room for farther pairs, a round is a sweep over all there are
        grown = below(seen, steps.at[k]) if room else reduce(below, reversed(steps.at), seen)
        seen, now = settle_counted(grown, "reached", n=F.count(F.lit(1)))
        if now["n"] == had:
            return seen
        if room:
            k += 1
            room = k < len(steps.at) or steps.grow()


def downstream(seeds: DataFrame, edges: DataFrame, include_seeds: bool = False) -> DataFrame:
    """Everything that depends on a seed, directly or not.

    Further columns of ``seeds`` are labels that travel along: several closures over the
    same edges then take one loop instead of one each.
    """
    steps = Steps(edges)
    keys = ["id", *[c for c in seeds.columns if c != "id"]]
    own = seeds.select(*keys)
    if include_seeds:
        return reach(own, steps)
    return reach(own.withColumnRenamed("id", "parent").join(steps.at[0].hint(SHUFFLED), "parent").withColumnRenamed("child", "id").select(*keys), steps)


def _core(edges: DataFrame) -> Steps:
    """Edges between nodes that are on a cycle or between two: what trimming from both ends leaves."""
    steps = Steps(edges)
    for _ in range(2 if steps.rows[0] else 0):
        e = steps.at[0]
        ids = e.select(F.col("child").alias("id")).unionByName(e.select(F.col("parent").alias("id"))).distinct()
        stuck = levels(ids, steps).where("stuck").select("id")
        # behind a cycle first; then, with the edges turned round, before one
        steps = Steps(e.join(stuck.withColumnRenamed("id", "child"), "child", "left_semi").join(stuck.withColumnRenamed("id", "parent"), "parent", "left_semi")
                      .select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    return steps


def strong_components(edges: DataFrame) -> DataFrame:
    """``id, component``: the nodes on cycles, and for each the largest one it shares a cycle
    with (or itself).

    After trimming, each node takes the largest id above it as its colour. A node has the
    colour of its component's largest node exactly if no larger one reaches that; so the nodes
    of a colour that its own node depends on are a component. They go, and what is left is
    trimmed and coloured again.
    """
    steps, found = _core(edges), []
    while steps.rows[0]:
        left, k, room = steps.at[0], 0, True
        ids = left.select(F.col("child").alias("id")).distinct()
        colour, n = ids.withColumn("colour", F.col("id")), {"changed": 1}
        while n["changed"]:
            n = {"changed": 0}
            for e in [steps.at[k]] if room else steps.at:
                more = colour.join(e.select(F.col("parent").alias("id"), "child").hint(SHUFFLED), "id").select(F.col("child").alias("id"), "colour", F.lit(False).alias("_own"))
                best = colour.withColumn("_own", F.lit(True)).unionByName(more).groupBy("id").agg(F.max("colour").alias("colour"), F.max(F.when(F.col("_own"), F.col("colour"))).alias("_had"))
                best, got = settle_counted(best, "colours", changed=F.count_if(F.col("colour") != F.col("_had")))
                colour, n = best.select("id", "colour"), {"changed": n["changed"] + got["changed"]}
            if room and n["changed"]:
                k += 1
                room = k < len(steps.at) or steps.grow()
        of = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"_{end}"))
        same = settle(left.join(of("child").hint(SHUFFLED), "child").join(of("parent").hint(SHUFFLED), "parent").where("_child = _parent").select("child", "parent"), "coloured")
        turned = same.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
        members = reach(colour.where("id = colour").select("id", F.col("colour").alias("component")), Steps(turned))
        size = members.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
        loops = same.where("child = parent").select(F.col("child").alias("id"), F.lit(True).alias("_loop"))
        found.append(members.join(size, "component").join(loops, "id", "left").where("_size > 1 or _loop").select("id", "component"))
        out = members.select("id")
        rest = same.join(out.withColumnRenamed("id", "child"), "child", "left_anti").join(out.withColumnRenamed("id", "parent"), "parent", "left_anti").select("child", "parent")
        steps = _core(rest)
    if not found:
        return edges.select(F.col("child").alias("id"), F.col("child").alias("component")).limit(0)
    return reduce(lambda a, b: a.unionByName(b), found)


def on_cycle(edges: DataFrame) -> DataFrame:
    """Nodes that depend on themselves."""
    return strong_components(edges).select("id")


def taint(seeds: DataFrame, edges: DataFrame, ordered: DataFrame) -> DataFrame:
    """``id, reason`` of tainted nodes. ``seeds``: id, direct, derived. A seed keeps its
    direct reason, what depends on it gets the derived one; only nodes that were put in
    order carry a taint on. All kinds of taint travel in one loop."""
    e = edges.join(ordered.select(F.col("id").alias("child")).hint(SHUFFLED), "child", "left_semi")
    s = seeds.join(ordered.select("id").hint(SHUFFLED), "id", "left_semi").select("id", "direct", "derived").distinct()
    reached = downstream(s, e, include_seeds=True)
    mark = s.withColumn("_seed", F.lit(True))
    return reached.join(mark.hint(SHUFFLED), ["id", "direct", "derived"], "left").select(
        "id", F.when(F.col("_seed"), F.col("direct")).otherwise(F.col("derived")).alias("reason"))


def wave_dependencies(waves_: DataFrame, edges: DataFrame) -> DataFrame:
    """Earlier waves each wave depends on; pairs are reduced to distinct waves map-side."""
    w = waves_.select("id", "wave")
    j = (edges.join(w.select(F.col("id").alias("child"), "wave"), "child")
         .join(w.select(F.col("id").alias("parent"), F.col("wave").alias("depends_on")), "parent"))
    return j.where("depends_on < wave").select("wave", "depends_on").distinct()


def effort_band(score: Column) -> Column:
    return F.when(score >= 12, "XL").when(score >= 7, "L").when(score >= 3, "M").otherwise("S")


HEAVY_TARGETS = ["manual", "data_pipeline", "eventstream"]


def wave_rollup(items: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Per wave: size, reviews, blockers, status and effort. ``items``: id, wave, target,
    reasons; ``unresolved``: id, message. Counts only, so no wave is held in one row."""
    msgs = unresolved.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("_msgs"))
    d = items.join(msgs, "id", "left").na.fill(0, ["_msgs"])
    g = d.groupBy("wave").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.size("reasons") > 0).alias("manual_reviews"),
        F.sum(F.size("reasons") + F.col("_msgs")).cast("long").alias("blockers"),
        F.count_if(F.col("target").isin(HEAVY_TARGETS)).alias("heavy"))
    score = F.col("items") + F.col("blockers") + F.col("heavy")
    return g.select("wave", "items", "manual_reviews", "blockers",
                    F.when(F.col("blockers") > 0, "blocked").otherwise("ready_for_review").alias("status"),
                    effort_band(score).alias("effort_band"))


def apply_decisions(rollup: DataFrame, deps: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Review decisions, all or nothing. ``decisions``: wave, decision, owner.

    Returns (waves with approval status, errors). An approval is valid when its wave is
    ready and every wave it depends on has a valid approval; that is a taint of the wave
    graph by the waves that are not validly approved by themselves.
    """
    dup = decisions.groupBy("wave").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        "wave", F.lit("more than one decision").alias("error"))
    unknown = decisions.join(rollup.select("wave"), "wave", "left_anti").select("wave", F.lit("not in the plan").alias("error")).distinct()
    # With two decisions for a wave the later one counts; that is an error anyway.
    d = rollup.join(decisions.groupBy("wave").agg(F.max("decision").alias("decision"), F.max("owner").alias("owner")), "wave", "left")
    approved = F.coalesce(F.col("decision") == "approved", F.lit(False))
    not_ready = d.where(approved & (F.col("status") != "ready_for_review")).select(
        "wave", F.concat(F.lit("cannot approve a "), "status", F.lit(" wave")).alias("error"))
    bad = d.where(~(approved & (F.col("status") == "ready_for_review"))).select(F.col("wave").alias("id"))
    edges = deps.select(F.col("wave").alias("child"), F.col("depends_on").alias("parent"))
    spoiled = downstream(bad, edges, include_seeds=True).distinct()
    open_dep = deps.join(spoiled.select(F.col("id").alias("depends_on")), "depends_on", "left_semi").select("wave").distinct()
    unapproved = d.where(approved).join(open_dep, "wave", "left_semi").select("wave", F.lit("dependency waves are not approved").alias("error"))
    errors = settle(dup.unionByName(unknown).unionByName(not_ready).unionByName(unapproved), "errors")
    clean = errors.agg(F.count(F.lit(1)) == 0).scalar()
    out = d.withColumn("approval", F.when(clean & F.col("decision").isNotNull(), F.col("decision")).otherwise("pending"))
    return out.drop("decision", "owner"), errors
