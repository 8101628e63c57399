import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from carryover.llm import negatives as N
from carryover.llm.vectors import packed

RND = np.random.default_rng(8)
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=10):
    """Every anchor against every row, in Python integers."""
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows]
    out = []
    for a, v, y in {(i, tuple(v), y) for i, v, y in rows if i % 100 == 0}:
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(p * q for p, q in zip(v, w)))), i, z) for i, w, z in rows)
        for s, i in [(-s, i) for s, i, z in scored if z == y and i != a][:positives]:
            fits = [(-t, j) for t, j, z in scored if z != y and 30 * s <= -100 * t <= 90 * s][:negatives]
            out += [(a, i, k, j, s, t) for k, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in N.mine_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"), **more).collect())


def table(n, d, scale=1.0, labels=4):
    m = RND.standard_normal((n, d)) * scale + 0.3 * scale * RND.standard_normal((1, d))
    return [(i, v.tolist(), int(y)) for i, v, y in zip(range(n), m, RND.integers(0, labels, n), strict=True)]


@pytest.mark.parametrize("d,scale", [(64, 0.1), (7, 1.0), (100, 0.01), (20, 1e6)])
def test_equals_brute_force(spark, d, scale):
    rows = table(700, d, scale)
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_blocks_and_ties(spark, monkeypatch):
    """Several anchor blocks and row blocks; coarse values, so that most scores tie."""
    monkeypatch.setattr(N, "ANCHORS", 3)
    monkeypatch.setattr(N, "ROWS", 50)
    monkeypatch.setattr(N, "STEP", 100)
    rows = [(i, RND.integers(-1, 2, 6).tolist(), int(RND.integers(0, 3))) for i in range(900)]
    rows = [(i, [float(x) for x in v], y) for i, v, y in rows]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_bounds_hold():
    a, b = (N.Summaries(np.floor(RND.standard_normal((50, 64)) * s)) for s in (300, 2e9))
    i, j = np.divmod(np.arange(2500), 50)
    true = (a.x @ b.x.T)
    low, high = N.dense_bounds(a, b)
    l2, h2 = N.pair_bounds(a, b, i, j)
    assert (low <= true).all() and (true <= high).all()
    assert (l2 <= true[i, j]).all() and (true[i, j] <= h2).all()
    assert (h2 - l2).sum() < (high - low).sum()


def test_odd_rows(spark):
    v = [0.5, 0.25, 0.125]
    rows = [(0, v, 1), (0, v, 1), (1, [0.5, 0.25], 1), (2, v, 1), (2, v, 1), (3, [0.3, 0.1, 0.0], 2), (4, [0.2, 0.2, 0.2, 9.0], 2), (5, [-0.5, 0.0, 0.0], 2),
            (100, [0.0, 0.0, 0.0], 3), (200, [1e300, -1e300, 0.0], 4), (201, [1e300, 0.0, 0.0], 4), (300, v, 5)]
    junk = [(6, None, 1), (7, [], 1), (8, [0.1, None, 0.1], 1), (9, [math.nan, 0.0, 0.0], 1), (10, [math.inf, 0.0, 0.0], 1), (11, v, None), (None, v, 1), (400, v, None)]
    df = spark.createDataFrame([(*r, *"xxxx") for r in rows + junk], SCHEMA + ", cls string, a string, scores string, rank string")
    big = 2**31
    held = [(i, [min(max(math.floor(256 * x), -big), big - 1) / 256 for x in w], y) for i, w, y in rows]
    assert mined(df) == brute(held)
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id is null")) == []
    assert mined(df, positives=1, negatives=1) == brute(held, 1, 1)


def offered(whole, anchors, bands):
    """The lists of a cell whose anchors are the first rows, past which all rows are led."""
    ids, labels = np.arange(len(whole)), np.arange(len(whole)) % 3
    made = lambda n: [pa.array(ids[:n]), pa.array(labels[:n]), pa.array(ids[:n]), packed([(ids[:n], whole[:n])], n)]
    cell = N.Cell(pa.table([*made(anchors), pa.array([None] * anchors, pa.list_(pa.int64())), pa.array([bands] * anchors, pa.list_(pa.list_(pa.int64())))],
                           names=["_id", "label", "cls", "vec", "scores", "bands"]))
    lists = [N.Lists(anchors, 4) for _ in range(max(1, cell.bands))]
    for a in range(0, len(whole), 700):
        cell.offer(pa.RecordBatch.from_arrays(made(len(whole)), names=["_id", "label", "cls", "vec"]).slice(a, 700), lists)
    for x in lists:
        x.settle()
    return [list(zip(x.slot.tolist(), x.score.tolist(), x.id.tolist(), strict=True)) for x in lists]


@pytest.mark.parametrize("most", [90, 1 << 12, 1 << 22, 1 << 30])
@pytest.mark.parametrize("bands", [None, [[-(1 << 62), 1 << 62], [3, 1 << 40], [9, 2]]])
def test_scores_at_once_and_behind_bounds_are_the_same(monkeypatch, most, bands):
    whole = np.random.default_rng(most).integers(-most, most, (1500, 32)).astype(np.int32)
    got = []
    for dense, again in ((2.0, 0), (0.0, 15), (N.DENSE, N.AGAIN)):
        monkeypatch.setattr(N, "DENSE", dense)
        monkeypatch.setattr(N, "AGAIN", again)
        got.append(offered(whole, 40, bands))
    exact = whole[:40].astype(object) @ whole.T.astype(object)
    for k, (low, high) in enumerate(bands or [(-(1 << 63), 1 << 63)]):
        for a in range(40):
            fits = [(-s, j) for j, s in enumerate(exact[a]) if low <= s <= high and ((a % 3 == j % 3) and a != j if bands is None else a % 3 != j % 3)]
            assert [(s, j) for x, s, j in got[0][k] if x == a] == [(-s, j) for s, j in sorted(fits)[:4]]
    assert got[0] == got[1] == got[2]


def test_vectors_that_no_bound_tells_apart_are_not_scored_pair_by_pair(monkeypatch):
    pairs, real = [], N.exact
    monkeypatch.setattr(N, "exact", lambda a, b, i, j: pairs.append(len(i)) or real(a, b, i, j))
    offered(np.random.default_rng(1).integers(-100, 100, (1500, 32)).astype(np.int32), 40, [[-(1 << 62), 1 << 62]])
    assert sum(pairs) < 40 * 1500 / 10
