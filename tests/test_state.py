import datetime as dt

from pyspark.sql import functions as F

from carryover.session import scratch
from carryover.streaming import operators as S

DAY = 86_400_000


def test_running_totals_expire_and_resume(spark):
    """State is dropped after the idle time, a restart goes on where the last run ended, and
    the session of the caller keeps its state store."""
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    own = S.state_session(spark)
    src, out = scratch(spark, "rows"), scratch(spark, "out")
    kind = "who string, ts timestamp_ntz, cents long, value double"

    def run(*rows):
        spark.createDataFrame([(w, dt.datetime(2024, 1, day), c, v) for w, day, c, v in rows], kind).coalesce(1).write.mode("append").parquet(src)
        d = S.running_totals(S.events_stream(own, src, spark.read.parquet(src).schema), "who", "ts", "cents", "value", "1 hour", 5 * DAY)
        q = S.run_batches(d, S.idempotent_sink(out), out + "-ckpt", "update")
        return q.lastProgress.stateOperators[0].numRowsTotal

    def newest():
        d = spark.read.parquet(out)
        return {r.key: tuple(r)[1:] for r in d.groupBy("key").agg(F.max_by(F.struct("events", "total", "peak", "closed"), "batch_id").alias("r")).select("key", "r.*").collect()}

    few = run(("a", 1, 10, 1.5), ("a", 2, 20, None), ("b", 2, 5, 7.0), (None, 2, 1, 1.0))
    assert newest() == {"a": (2, 30, 1.5, False), "b": (1, 5, 7.0, False), None: (1, 1, 1.0, False)}
    assert run(("b", 6, 5, 9.0), ("c", 6, 1, None)) > few
    assert newest()["b"] == (2, 10, 9.0, False) and newest()["c"] == (1, 1, None, False)
    run(("c", 20, 1, 2.0))
    left = run(("c", 21, 1, 2.0))
    got = newest()
    assert got["a"] == (2, 30, 1.5, True) and got["b"] == (2, 10, 9.0, True) and got["c"][0] <= 3 and not got["c"][3]
    assert left <= few
    run(("a", 22, 7, 1.0))
    assert newest()["a"] == (1, 7, 1.0, False)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store
