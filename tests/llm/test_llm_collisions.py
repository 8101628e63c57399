import math

import numpy as np
import pytest

from carryover.llm import collisions as C
from carryover.llm.vectors import units

RND = np.random.default_rng(3)
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, m, least=0.95):
    """Links and components, pair by pair."""
    u = units(np.asarray(m))
    linked = (u @ u.T >= least) & ~np.eye(len(u), dtype=bool)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(linked, low, np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return {i: (int(linked[k].sum()), int(low[k]), bool(low[k] == i)) for k, i in enumerate(ids)}
        low = new


def found(df, **more):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in C.near_duplicates(df, **more).collect()}


def at_cosine(u, cos):
    """A vector at this cosine from each row."""
    v = RND.standard_normal(u.shape)
    v -= np.einsum("ij,ij->i", u, v)[:, None] * u
    return cos * u + math.sqrt(1 - cos * cos) * units(v)


@pytest.mark.parametrize("shift", [0.0, 0.5])
def test_recall_by_cosine(spark, shift):
    """Pairs just above the threshold, also where all vectors lean one way."""
    base = units(RND.standard_normal((3000, 48)) + shift)
    for cos in (0.9501, 0.98):
        two = np.concatenate([base, at_cosine(base, cos)]).astype(np.float32)
        got = found(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(two)], SCHEMA))
        u = units(two)
        close = np.einsum("ij,ij->i", u[:3000], u[3000:]) >= 0.95
        hit = np.array([got[3000 + i][1] <= i for i in range(3000)])
        assert hit[close].mean() >= (0.985 if cos < 0.96 else 0.998)
    assert sum(n for n, _, _ in got.values()) >= 2 * close.sum() * 0.998


def test_each_pair_meets_once():
    u = units(RND.standard_normal((300, 32)))
    p = C.project(np.concatenate([u, at_cosine(u, 0.96)]))
    counts = np.stack([np.bincount(c + 128, minlength=256) for c in p.T[:C.DEEPEST].astype(int)])
    lines = C.fit_lines(0.95, 0.99, C.LEAF * 64, counts)
    assert len(lines.cuts) == 6 and 0 < lines.need < C.LINES
    row, leaf, foreign = C.visits(p, lines)
    met = {}
    for x in np.unique(leaf):
        at = np.flatnonzero(leaf == x)
        assert len(set(row[at])) == len(at)
        for i in at:
            for j in at[row[at] > row[i]]:
                if not foreign[i] & foreign[j]:
                    met[row[i], row[j]] = met.get((row[i], row[j]), 0) + 1
    assert set(met.values()) == {1}
    assert sum((i, i + 300) in met for i in range(300)) >= 290


@pytest.mark.parametrize("leaf,block", [(1024, 8192), (64, 40)])
def test_groups_equal_brute_force(spark, monkeypatch, leaf, block):
    """One group of a third of all rows, small ones, copies of one vector; leaves cut in blocks."""
    monkeypatch.setattr(C, "LEAF", leaf)
    monkeypatch.setattr(C, "BLOCK", block)
    single = units(RND.standard_normal((700, 64)))
    hot = at_cosine(np.repeat(single[:1], 350, axis=0), 0.996)
    few = at_cosine(np.repeat(single[1:40], 3, axis=0), 0.995)
    same = np.repeat(single[40:41], 60, axis=0)
    m = np.concatenate([single, hot, few, same]).astype(np.float32)
    ids = RND.permutation(len(m)).tolist()
    got = found(spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, m, strict=True)], SCHEMA).repartition(5))
    assert got == brute(ids, m)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 0.0]
    rows = [(1, v, 1), (1, v, 1), (2, [2.0, 4.0, 6.0], 2), (3, None, 3), (4, [0.0, 0.0], 4), (5, [], 5), (6, [1.0, None, 3.0], 6),
            (7, [1.0, math.nan, 3.0], 7), (8, [1.0, math.inf, 3.0], 8), (None, v, 9), (9, [-1.0, -2.0, -3.0, -0.0], None), (10, [1e30, 2e30, 3e30], 1)]
    df = spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA + ", cls string, n string, leaf string, vec string, n_links string")
    got = sorted(tuple(r) for r in C.near_duplicates(df).filter("vec_id is not null").collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), *alone, (10, 3, 1, False)]
    assert [tuple(r) for r in C.near_duplicates(df).filter("vec_id is null").collect()] == [(None, 0, None, None)]
    assert C.near_duplicates(df.limit(0)).count() == 0


def test_doubles_and_a_chain(spark):
    """Doubles whose squares overflow; a chain is one component although its ends do not link."""
    step = [[math.cos(a) * 1e200, math.sin(a) * 1e200] for a in np.arange(6) * 0.3]
    got = found(spark.createDataFrame([(i, v) for i, v in enumerate(step)], "vec_id long, embedding array<double>"))
    assert got == brute(range(6), np.array(step)) and got[5] == (1, 0, False)
