"""Structured Streaming operators: typed ingest, windows, deduplication, exactly-once sinks.

Every query keeps its state in a checkpoint below the shared folder, so a restart goes on
where the last commit ended. Sinks key their output by batch, which makes a replay harmless.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from carryover.operators.dml import apply_changes
from carryover.operators.lookups import broadcast_if_small
from carryover.operators.windows import latest_per_key
from carryover.sources.sinks import overwrite_partitions


def events_stream(spark: SparkSession, path: str, schema, time: str = "ts", **options) -> DataFrame:
    """File stream with an instant event time (watermarks need one, and the zone is UTC)."""
    d = spark.readStream.schema(schema).options(**options).parquet(path)
    return d.withColumn(time, F.col(time).cast("timestamp"))


END_OF_INPUT = "9999-12-01 00:00:00"


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """A stream that can be told that its input has ended (see ``mark_end``)."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def mark_end(stream: DataFrame, folder: str, time: str = "ts") -> None:
    """Add one row, null but for a time behind all others: the next run of the query moves its
    watermark there and emits every window that was still open. The row's own windows stay open."""
    spark = stream.sparkSession
    row = [F.lit(END_OF_INPUT if f.name == time else None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*row).write.mode("append").parquet(folder)


def run_to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger):
    """Run until all available input is done; returns the finished query."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start(path))
    q.awaitTermination()
    return q


def run_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    q = df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed(df: DataFrame, time: str, lateness: str, width: str, slide: str | None, keys: list[str], aggs: list) -> DataFrame:
    """Tumbling or sliding windows behind a watermark; partial aggregates meet per window."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = df.withWatermark(time, lateness).groupBy(w.alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c != "w"])


def sessions(df: DataFrame, time: str, lateness: str, gap: str, keys: list[str], aggs: list) -> DataFrame:
    """Session windows. Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    where some keys are very busy: sessions are then merged per task first."""
    g = df.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c != "w"])


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose state store has timers; the caller's session
    keeps its settings. Streams that use ``running_totals`` have to be read by it."""
    own = spark.newSession()
    for k, v in {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                 "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(k, v)
    return own


def _reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a key folded to one per task and Arrow batch, before anything is shuffled."""
    for f in frames:
        yield f.groupby("key", as_index=False, dropna=False).agg(ts=("ts", "max"), events=("events", "sum"), total=("total", "sum"), peak=("peak", "max"))


class Totals(StatefulProcessor):
    """Running totals of a key, with a timer that is set anew whenever the key is seen."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("totals", "events bigint, total bigint, peak double, seen bigint")

    def _row(self, key: tuple, s: tuple, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "events": [s[0]], "total": [s[1]], "peak": [s[2]], "closed": [closed]}).astype({"peak": "float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had = self.state.get() if self.state.exists() else None
        events, total, peak, seen = had or (0, 0, None, None)
        for f in rows:
            events, total = events + int(f["events"].sum()), total + int(f["total"].sum())
            top, last = f["peak"].max(), f["ts"].max()
            peak = peak if pd.isna(top) else float(top) if peak is None else max(peak, float(top))
            if not pd.isna(last):
                last = int(pd.Timestamp(last).value // 1_000_000)
                seen = last if seen is None else max(seen, last)
        if had and had[3] is not None and had[3] != seen:
            self.handle.deleteTimer(had[3] + self.idle)
        if seen is not None:
            self.handle.registerTimer(seen + self.idle)
        self.state.update((events, total, peak, seen))
        yield self._row(key, (events, total, peak), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            s = self.state.get()
            self.state.clear()
            yield self._row(key, s, True)

    def close(self) -> None:
        pass


def running_totals(stream: DataFrame, key: str, time: str, amount: str, peak: str, lateness: str, idle_ms: int) -> DataFrame:
    """``key, events, total, peak, closed``: an update for each key of a batch, totals since it
    was first seen. ``amount`` is a whole number of the smallest unit, so sums are exact.

    A key that has not been seen for ``idle_ms`` of event time is emitted once more as closed,
    and its state is removed; seen again, it starts from nothing.
    """
    kind = stream.schema[key].dataType.simpleString()
    d = stream.select(F.col(key).alias("key"), F.col(time).alias("ts"), F.lit(1).cast("long").alias("events"),
                      F.coalesce(F.col(amount).cast("long"), F.lit(0)).alias("total"), F.col(peak).cast("double").alias("peak"))
    few = d.mapInPandas(_reduced, f"key {kind}, ts timestamp, events long, total long, peak double").withWatermark("ts", lateness)
    return few.groupBy("key").transformWithStateInPandas(Totals(idle_ms), f"key {kind}, events long, total long, peak double, closed boolean", "Update", "EventTime")


def dedupe(df: DataFrame, time: str, lateness: str, keys: list[str]) -> DataFrame:
    return df.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def idempotent_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Store a batch under its id; the same batch sent again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        overwrite_partitions(batch.withColumn("batch_id", F.lit(batch_id)), path, ["batch_id"])

    return write


def cdc_sink(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """Store the newest change per key of each batch under the batch id.

    A batch writes only what it changed, however large the table is; the same batch sent
    again replaces itself.
    """
    store = idempotent_sink(path)
    return lambda batch, batch_id: store(latest_per_key(batch, keys, order), batch_id)


def cdc_table(base: DataFrame, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The table with all stored changes applied; write the result to start a new base."""
    return apply_changes(base, base.sparkSession.read.parquet(path), keys, order)


def enrich(stream: DataFrame, static: DataFrame, on, how: str = "left") -> DataFrame:
    """Stream to reference table; the table is broadcast only while its estimate is small."""
    return stream.join(broadcast_if_small(static), on, how)


def retained(df: DataFrame, time: str, now: str, days: int = 90) -> DataFrame:
    """Rows inside the retention period before a given moment."""
    edge = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return df.where(F.col(time) >= edge)


def dropped_rows(query) -> int:
    """State-operator rows a query dropped because they were behind the watermark.

    Spark keeps the progress of the newest batches only (``numRecentProgressUpdates``); a query
    with more batches than that is an error here, not a count that leaves some out.
    """
    total = 0
    if len(query.recentProgress) >= int(SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates")):
        raise ValueError("older batches are no longer kept; raise spark.sql.streaming.numRecentProgressUpdates")
    for p in query.recentProgress:
        ops = p["stateOperators"] if isinstance(p, dict) or hasattr(p, "__getitem__") else p.stateOperators
        total += sum(int(o["numRowsDroppedByWatermark"] if isinstance(o, dict) else o.numRowsDroppedByWatermark) for o in ops)
    return total
