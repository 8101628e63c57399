import random

import pytest
from conftest import rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carryover.operators.windows import cut_keys, keyed_window, latest_per_key, segment, top_per_key


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows; order values tie; some amounts are null."""
    r = random.Random(5)
    data = []
    for i in range(3000):
        key = "hot" if r.random() < 0.66 else f"k{r.randrange(40)}"
        data.append((key, r.randrange(300), i, None if r.random() < 0.1 else r.randrange(100)))
    r.shuffle(data)
    return spark.createDataFrame(data, "key string, day int, id int, amount long").repartition(5).cache()


def test_matches_plain_window(skewed):
    got = keyed_window(
        skewed, ["key"], ["day", "id"], row_number="rn", rank="rk", dense_rank="dr",
        running_sum={"rs": "amount"}, running_avg={"ra": "amount"}, running_max={"rm": "amount"},
        lag={"prev": "amount"}, lead={"nxt": "id"})
    w = W.partitionBy("key").orderBy("day", "id")
    wr, wf = W.partitionBy("key").orderBy("day"), w.rowsBetween(W.unboundedPreceding, 0)
    want = skewed.select(
        "*", F.row_number().over(w).alias("rn"), F.rank().over(wr).alias("rk"), F.dense_rank().over(wr).alias("dr"),
        F.sum("amount").over(wf).alias("rs"), F.avg("amount").over(wf).alias("ra"), F.max("amount").over(wf).alias("rm"),
        F.lag("amount").over(w).alias("prev"), F.lead("id").over(w).alias("nxt"))
    assert rows(got) == rows(want)


def test_hot_key_is_cut(skewed):
    d = segment(skewed, ["key"], ["day", "id"], 16)
    by = {r.key: r.n for r in d.groupBy("key").agg(F.count_distinct("_seg").alias("n")).collect()}
    assert by["hot"] >= 8 and max(r["count"] for r in d.groupBy("_seg").count().collect()) < 3000 / 16 * 2
    assert {k for k, n in by.items() if n > 1} <= {r[0] for r in cut_keys(d, ["key"]).collect()}


@pytest.mark.parametrize("parts", [2, 7, 40])
def test_one_key_one_day_and_nulls(spark, parts):
    """All rows of a key on one day, a null key, null days: ranks go on across segments."""
    data = [("a", 5, i, i % 7) for i in range(400)] + [(None, i // 50, i, None) for i in range(400, 700)] + [("b", None if i % 2 else 1, i, 1) for i in range(700, 900)]
    d = spark.createDataFrame(data, "key string, day int, id int, amount long")
    got = keyed_window(d, ["key"], ["day", "id"], row_number="rn", rank="rk", dense_rank="dr", running_sum={"rs": "amount"}, lag={"p": "id"}, lead={"n": "id"}, parts=parts)
    w, wr = W.partitionBy("key").orderBy("day", "id"), W.partitionBy("key").orderBy("day")
    want = d.select("*", F.row_number().over(w).alias("rn"), F.rank().over(wr).alias("rk"), F.dense_rank().over(wr).alias("dr"),
                    F.sum("amount").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("rs"), F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("n"))
    assert rows(got) == rows(want)


def test_top_and_latest(skewed):
    top = top_per_key(skewed, ["key"], [F.desc("day"), F.desc("id")], 1)
    assert rows(top) == rows(latest_per_key(skewed, ["key"], ["day", "id"]))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
