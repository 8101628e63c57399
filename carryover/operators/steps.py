"""Names, ordered steps and loops over DataFrames: the script side of a migration."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.session import settle_counted

MAX_ROUNDS = 10_000


class NameMap:
    """Three-part names resolved to DataFrames; missing parts take the defaults."""

    def __init__(self, frames: dict[str, DataFrame], project: str, dataset: str):
        self.frames, self.project, self.dataset = frames, project, dataset

    def full(self, name: str) -> str:
        parts = name.strip("`").split(".")
        if len(parts) == 1:
            parts = [self.project, self.dataset, *parts]
        elif len(parts) == 2:
            parts = [self.project, *parts]
        return ".".join(parts)

    def resolve(self, name: str) -> DataFrame:
        full = self.full(name)
        if full not in self.frames:
            raise KeyError(f"{full} is not registered")
        return self.frames[full]


def run_statements(spark: SparkSession, steps: list[tuple[str, str]], views: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Run ``(view, sql)`` steps in order; each sees the results of the ones before it.

    Statements name frames with ``{name}`` so two runs never share a temp view. The first
    failing step stops the run and is named in the error.
    """
    frames = dict(views)
    for i, (name, sql) in enumerate(steps):
        try:
            frames[name] = spark.sql(sql, **frames)
        except Exception as e:
            raise RuntimeError(f"statement {i + 1} ({name}) failed") from e
    return frames


def with_fallback(main: Callable[[], DataFrame], fallback: Callable[[Exception], DataFrame]) -> DataFrame:
    """``BEGIN .. EXCEPTION``: build and analyse a step, else run its handler."""
    try:
        df = main()
        df.schema  # noqa: B018  analysis errors surface here
        return df
    except Exception as e:  # noqa: BLE001
        return fallback(e)


def recursive_union(anchor: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``WITH RECURSIVE .. UNION ALL``: the anchor, then what ``step`` makes of the round before,
    until a round has no rows. Rounds are written to the shared folder, so neither their number
    nor their rows are bound by what Spark's own recursion allows (100 rounds, a million rows)."""
    rounds: list[DataFrame] = []
    now, n = settle_counted(anchor, "recursion", n=F.count(F.lit(1)))
    while n["n"] and len(rounds) < MAX_ROUNDS:
        rounds.append(now)
        now, n = settle_counted(step(now), "recursion", n=F.count(F.lit(1)))
    if n["n"]:
        raise RuntimeError("the recursion is deeper than the round limit")
    return reduce(DataFrame.union, rounds, now)
