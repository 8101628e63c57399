import math
import random
from fractions import Fraction

import numpy as np
import pytest

from carryover.operators import aggregates as A

RND = random.Random(4)


def mean(rows):
    rows = [(Fraction(v), Fraction(w)) for v, w in rows if v is not None and w is not None and math.isfinite(v) and math.isfinite(w)]
    total = sum(w for _, w in rows)
    return float(sum(v * w for v, w in rows) / total) if total else None


def share(values):
    values = [Fraction(v) for v in values if v is not None and math.isfinite(v)]
    return float(sum(v * v for v in values) / sum(values) ** 2) if sum(values) else None


def run(df, keys):
    d = A.aggregate(df, keys, {"v": "x", "w": "y"}, mean=A.exact_weighted_mean("v", "w"), share=A.exact_concentration("v"))
    return {tuple(r)[:len(keys)]: (r["mean"], r["share"]) for r in d.collect()}


@pytest.mark.parametrize("held", [A.HELD, 3])
def test_equals_exact_arithmetic(spark, monkeypatch, held):
    """A hot key, null keys, values of all sizes that cancel out; no digit is lost."""
    monkeypatch.setattr(A, "HELD", held)
    size = lambda: RND.choice([1.005, -2.004, 1e16, -1e16, 1e-9, 3.0, None, math.nan, math.inf, RND.gauss(0, 1e6)])
    rows = [(RND.choice(["hot"] * 8 + ["a", "b", None]), RND.choice([1, None]), size(), RND.choice([1.0, 0.1, 2.5, None, 1e-3])) for _ in range(4000)]
    rows += [("zero", 1, 5.0, 0.0), ("none", 1, None, 1.0), ("two", 1, 1.005, 1.0), ("two", 1, 2.004, 1.0)]
    got = run(spark.createDataFrame(rows, "part string, k int, x double, y double").withColumnRenamed("part", "state").repartition(7), ["state", "k"])
    keys = {r[:2] for r in rows}
    assert got.keys() == keys
    for k in keys:
        mine = [r[2:] for r in rows if r[:2] == k]
        assert got[k] == (mean(mine), share([v for v, _ in mine]))
    assert got["two", 1][0] == 1.5045


def test_one_group_and_no_rows(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "x double, y double")
    assert run(d, []) == {(): (1.75, 5 / 9)}
    assert run(d.limit(0).selectExpr("1 as k", "x", "y"), ["k"]) == {}


def test_sums_of_extremes():
    v = np.array([5e-324, 1e308, -1e308, 5e-324, 2.0**60, 1.0, -(2.0**60)])
    assert A.exact_sums(v, np.zeros(7, np.int64), 1) == [int(sum(Fraction(x) for x in v) * 2**A.UNIT)]
