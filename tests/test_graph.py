
import random

import pytest

from carryover.operators import graph as G


def frames(spark, ids, edges):
    return (spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "child string, parent string"))


def levels(d):
    return {r.id: (r.wave, r.stuck) for r in d.collect()}


def test_table_then_view(spark):
    n, e = frames(spark, ["t", "v"], [("v", "t"), ("v", "outside")])
    assert levels(G.waves(n, e)) == {"t": (1, False), "v": (2, False)}
    assert [(r.child, r.parent) for r in G.external_deps(n, e).collect()] == [("v", "outside")]


def test_cycle_and_what_is_behind_it_share_the_last_wave(spark):
    n, e = frames(spark, ["x", "y", "a", "b", "c"], [("y", "x"), ("a", "b"), ("b", "a"), ("c", "b")])
    assert levels(G.waves(n, e)) == {"x": (1, False), "y": (2, False), "a": (3, True), "b": (3, True), "c": (3, True)}
    assert {r.id for r in G.on_cycle(G.inside(n, e)).collect()} == {"a", "b"}


def test_no_edges(spark):
    n, e = frames(spark, ["a", "b"], [("a", "gone")])
    assert levels(G.waves(n, e)) == {"a": (1, False), "b": (1, False)}


def test_all_on_one_cycle(spark):
    n, e = frames(spark, ["a", "b"], [("a", "b"), ("b", "a")])
    assert levels(G.waves(n, e)) == {"a": (1, True), "b": (1, True)}


def test_random_graph_respects_every_edge(spark):
    r = random.Random(2)
    edges = [(f"n{i}", f"n{r.randrange(i)}") for i in range(1, 60) for _ in range(2)]
    n, e = frames(spark, [f"n{i}" for i in range(60)], edges)
    w = {k: v[0] for k, v in levels(G.waves(n, e)).items()}
    assert all(w[c] > w[p] for c, p in edges)
    assert all(w[i] == 1 or any(w[p] == w[i] - 1 for c, p in edges if c == i) for i in w)


def test_a_node_between_two_cycles_is_on_none(spark):
    _, e = frames(spark, ["a"], [("a", "b"), ("b", "a"), ("c", "b"), ("d", "c"), ("d", "e"), ("e", "d"), ("s", "s"), ("t", "s"), ("a", "z")])
    assert {r.id: r.component for r in G.strong_components(e).collect()} == {"a": "b", "b": "b", "d": "e", "e": "e", "s": "s"}
    assert G.strong_components(e.where("child = 'c'")).count() == 0


def components_of(edges):
    """Who reaches whom and back, by closure."""
    reach = {n: {p for c, p in edges if c == n} for e in edges for n in e}
    for _ in reach:
        for n in reach:
            reach[n] = reach[n].union(*(reach[m] for m in reach[n]))
    return {n: max(m for m in reach[n] if n in reach[m]) for n in reach if n in reach[n]}, reach


@pytest.mark.parametrize("roomy", [True, False])
def test_random_graphs_with_cycles(spark, monkeypatch, roomy):
    """Against closure by hand; without room for far pairs the other ways are taken."""
    if not roomy:
        monkeypatch.setattr(G, "GROWTH", 0)
        monkeypatch.setattr(G, "ROOMY", 1)
    r = random.Random(7)
    for size, count in ((14, 18),):
        edges = [(f"n{r.randrange(size):02}", f"n{r.randrange(size):02}") for _ in range(count)] + [("n00", "n01"), ("n01", "n02"), ("n02", "n00")]
        n, e = frames(spark, [f"n{i:02}" for i in range(size)], edges)
        want, above = components_of(edges)
        assert {x.id: x.component for x in G.strong_components(e).collect()} == want
        w = levels(G.waves(n, e))
        assert {i for i, (_, stuck) in w.items() if stuck} == {i for i in w if i in want or above.get(i, set()) & set(want)}
        assert all(w[c][0] > w[p][0] for c, p in edges if not w[c][1])
        assert {x.id for x in G.downstream(n.where("id = 'n01'"), e).collect()} == {i for i in above if "n01" in above[i]}


def test_a_thousand_steps(spark):
    """A chain of a thousand steps with a cycle at its end takes a round per doubling."""
    edges = [(f"n{i}", f"n{i - 1}") for i in range(1, 1000)] + [("x", "y"), ("y", "z"), ("z", "x"), ("x", "n999")]
    n, e = frames(spark, [f"n{i}" for i in range(1000)] + ["x", "y", "z"], edges)
    rounds = []
    grow = G.Steps.grow
    G.Steps.grow = lambda self: rounds.append(1) or grow(self)
    try:
        w = levels(G.waves(n, e))
        assert w["n999"] == (1000, False) and w["x"] == (1001, True) and len(rounds) <= 12
        rounds.clear()
        assert G.downstream(n.where("id = 'n0'"), e).count() == 1002 and len(rounds) <= 12
    finally:
        G.Steps.grow = grow


def test_downstream_and_taint(spark):
    n, e = frames(spark, ["ext", "t", "v", "free"], [("t", "ext"), ("v", "t")])
    seeds = spark.createDataFrame([("ext",)], "id string")
    assert {r.id for r in G.downstream(seeds, e).collect()} == {"t", "v"}
    two = spark.createDataFrame([("ext", "direct", "depends"), ("t", "own", "after")], "id string, direct string, derived string")
    got = sorted((r.id, r.reason) for r in G.taint(two, e, n).collect())
    assert got == [("ext", "direct"), ("t", "depends"), ("t", "own"), ("v", "after"), ("v", "depends")]
    assert {r.id for r in G.taint(two, e, n.where("id <> 't'")).collect()} == {"ext"}


def test_downstream_of_a_cycle_ends(spark):
    _, e = frames(spark, ["a"], [("a", "b"), ("b", "a"), ("c", "a")])
    assert {r.id for r in G.downstream(spark.createDataFrame([("a",)], "id string"), e).collect()} == {"a", "b", "c"}


def test_decisions_are_all_or_nothing(spark):
    roll = spark.createDataFrame([(1, "ready_for_review"), (2, "ready_for_review"), (3, "blocked"), (4, "ready_for_review")], "wave long, status string")
    deps = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "wave long, depends_on long")

    def run(*ds):
        d = spark.createDataFrame([(w, x, "o") for w, x in ds], "wave long, decision string, owner string")
        out, err = G.apply_decisions(roll, deps, d)
        return {r.wave: r.approval for r in out.collect()}, sorted((r.wave, r.error) for r in err.collect())

    ok, err = run((1, "approved"), (2, "approved"), (3, "deferred"))
    assert err == [] and ok == {1: "approved", 2: "approved", 3: "deferred", 4: "pending"}
    ok, err = run((2, "approved"))
    assert set(ok.values()) == {"pending"} and err == [(2, "dependency waves are not approved")]
    _, err = run((1, "approved"), (1, "rejected"), (9, "approved"), (3, "approved"))
    assert (1, "more than one decision") in err and (9, "not in the plan") in err and (3, "cannot approve a blocked wave") in err


def test_rollup_bands(spark):
    items = spark.createDataFrame([("a", 1, "manual", ["x"]), ("b", 1, "warehouse", [])] + [(f"c{i}", 2, "data_pipeline", []) for i in range(6)] + [("d", 3, "warehouse", [])],
                                  "id string, wave long, target string, reasons array<string>")
    un = spark.createDataFrame([("a", "m1"), ("a", "m1")], "id string, message string")
    got = {r.wave: (r.blockers, r.status, r.effort_band) for r in G.wave_rollup(items, un).collect()}
    assert got == {1: (2, "blocked", "M"), 2: (0, "ready_for_review", "XL"), 3: (0, "ready_for_review", "S")}


def test_no_round_sends_a_table_through_the_driver(spark, monkeypatch):
    plans, real = [], G.settle_counted

    def watched(df, name, **counts):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return real(df, name, **counts)

    monkeypatch.setattr(G, "settle_counted", watched)
    nodes = spark.range(20).selectExpr("concat('n', id) as id")
    edges = spark.range(1, 20).selectExpr("concat('n', id) as child", "concat('n', id div 2) as parent")
    assert G.waves(nodes, edges).count() == 20
    assert G.downstream(nodes.where("id = 'n1'"), edges).count() == 18
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
