"""Session defaults and the shared scratch area."""

from __future__ import annotations

import contextlib
import gc
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession

_round = itertools.count()


def build_session(app: str = "carryover", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, ANSI, AQE)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="carryover-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{os.getpid()}-{next(_round)}-{uuid.uuid4().hex[:8]}"


_passing: list[list[str]] = []


def settle(df: DataFrame, name: str = "stage", keep: bool = False) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Cuts the lineage of an iterative job in a way that outlives lost executors, and
    gives the next round exact file sizes to plan its joins with. Inside ``passing_scratch``
    the folder goes at its end, unless it is to be kept.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    scope = len(_passing) - 1 - keep
    if scope >= 0:
        _passing[scope].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``settle`` writes inside, once the block is done or has failed. A result
    that leaves the block must be settled with ``keep``: it would read what is gone."""
    _passing.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _passing.pop():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that no DataFrame needs any more. By itself it does so
    when the driver's heap happens to fill up, while a job of many stages fills the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle_counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict[str, int]]:
    """``settle`` that also returns aggregates taken while the rows are written, so a loop
    knows when to stop without a second job."""
    obs = Observation(f"{name}-{next(_round)}")
    out = settle(df.observe(obs, *[c.alias(k) for k, c in counts.items()]), name)
    got = obs.get
    return out, {k: got.get(k) or 0 for k in counts}


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a plain scan that has fewer splits than the cluster has cores, so that
    heavy expressions on its rows run everywhere. A large scan has enough splits and is
    left alone: this never shuffles big data."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if splits >= cores else scan.repartition(cores, *keys)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
