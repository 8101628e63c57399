"""Window functions that stay parallel when one key holds much of the table.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here the table is cut by
range into segments along (key, order): a large key is spread over as many segments as its
share of the table, however its order values are spread. Each segment is windowed on its own,
and the carry-over (rows, sums, last and first values of the segments before and after) is
added for keys that lie in more than one, of which a segment has two at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carryover.session import settle, shuffle_width


def segment(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_seg``, rising along ``keys`` and ``order``; written once and read back,
    so that a row's segment is the same for all who ask."""
    parts = parts or shuffle_width(df.sparkSession)
    return settle(df.repartitionByRange(parts, *keys, *order).withColumn("_seg", F.spark_partition_id()), "segments")


def cut_keys(segmented: DataFrame, keys: list[str]) -> DataFrame:
    """The last key of each segment: only these can go on in the next. One row per segment."""
    return segmented.groupBy("_seg").agg(F.max(F.struct(*keys)).alias("_k")).select(*[F.col(f"_k.{k}").alias(f"_c_{k}") for k in keys]).distinct()


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])


def keyed_window(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    row_number: str | None = None,
    rank: str | None = None,
    dense_rank: str | None = None,
    rank_on: list[str] | None = None,
    running_sum: dict[str, str] | None = None,
    running_avg: dict[str, str] | None = None,
    running_max: dict[str, str] | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Row number, ranks, running totals and neighbours per key, ascending by ``order``.

    ``order`` must be total within a key. Ranks compare ``rank_on`` (default: the first order
    column), which has to be a prefix of ``order``. Dicts map output name to input column.
    """
    rank_on = rank_on or order[:1]
    if rank_on != order[:len(rank_on)]:
        raise ValueError("rank_on has to be a prefix of order")
    running_sum, running_avg, running_max = dict(running_sum or {}), running_avg or {}, running_max or {}
    lag, lead = lag or {}, lead or {}
    for out, c in running_avg.items():
        running_sum[f"_s_{out}"] = c

    d = segment(df, keys, order, parts)
    part = [*keys, "_seg"]
    w = W.partitionBy(*part).orderBy(*order)
    wr = W.partitionBy(*part).orderBy(*rank_on)
    wf = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    cols: dict[str, Column] = {"_rn": F.row_number().over(w)}
    if rank:
        cols["_rk"] = F.rank().over(wr)
    if dense_rank:
        cols["_dr"] = F.dense_rank().over(wr)
    for out, c in running_sum.items():
        cols[f"_rs_{out}"] = F.sum(c).over(wf)
    for out, c in running_avg.items():
        cols[f"_rc_{out}"] = F.count(c).over(wf)
    for out, c in running_max.items():
        cols[f"_rm_{out}"] = F.max(c).over(wf)
    for out, c in lag.items():
        cols[f"_lg_{out}"] = F.lag(c).over(w)
    for out, c in lead.items():
        cols[f"_ld_{out}"] = F.lead(c).over(w)
    if lead:
        cols["_last"] = F.lead(F.lit(1)).over(w).isNull()
    local = d.withColumns(cols)

    # One row per segment of a key that is cut: at most two per segment.
    value, at = F.struct(*rank_on), F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")]
    if rank:
        aggs.append(F.max("_rk").alias("_nk"))
    if dense_rank:
        aggs.append(F.max("_dr").alias("_nd"))
    for out, c in running_sum.items():
        aggs.append(F.sum(c).alias(f"_t_{out}"))
    for out, c in running_avg.items():
        aggs.append(F.count(c).alias(f"_c_{out}"))
    for out, c in running_max.items():
        aggs.append(F.max(c).alias(f"_m_{out}"))
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(c).alias(o) for o, c in lag.items()]), at).alias("_tail"))
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(c).alias(o) for o, c in lead.items()]), at).alias("_head"))
    cut = cut_keys(d, keys)  # one row per segment: safe to broadcast
    segs = local.join(F.broadcast(cut), _same([F.col(k) for k in keys], [F.col(f"_c_{k}") for k in keys]), "left_semi").groupBy(*part).agg(*aggs)
    wo = W.partitionBy(*keys).orderBy("_seg")
    before = wo.rowsBetween(W.unboundedPreceding, -1)
    prior = F.lag("_hi").over(wo)
    segs = segs.withColumns({"_prior": prior, "_cont": F.when(F.col("_lo").eqNullSafe(prior) & prior.isNotNull(), 1).otherwise(0), "_o_n": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    offs = [F.col("_o_n")]
    if rank:
        # The rank of a segment's last value, unless all of it goes on from the segment before.
        fresh = F.when(~F.col("_hi").eqNullSafe(F.col("_prior")) | F.col("_prior").isNull(), F.col("_nk") + F.col("_o_n"))
        segs = segs.withColumn("_fresh", fresh)
        offs += [F.col("_prior"), F.last("_fresh", ignorenulls=True).over(before).alias("_o_rk")]
    if dense_rank:
        offs.append((F.coalesce(F.sum("_nd").over(before), F.lit(0)) - F.sum("_cont").over(wo.rowsBetween(W.unboundedPreceding, 0))).alias("_o_nd"))
    for out in running_sum:
        offs.append(F.sum(f"_t_{out}").over(before).alias(f"_o_{out}"))
    for out in running_avg:
        offs.append(F.coalesce(F.sum(f"_c_{out}").over(before), F.lit(0)).alias(f"_oc_{out}"))
    for out in running_max:
        offs.append(F.max(f"_m_{out}").over(before).alias(f"_om_{out}"))
    if lag:
        offs.append(F.lag("_tail").over(wo).alias("_prev"))
    if lead:
        offs.append(F.lead("_head").over(wo).alias("_next"))
    carry = segs.select(*[F.col(c).alias(f"_k_{c}") for c in part], *offs)
    joined = local.join(F.broadcast(carry), _same([F.col(c) for c in part], [F.col(f"_k_{c}") for c in part]), "left")

    shift = F.coalesce(F.col("_o_n"), F.lit(0))
    final: dict[str, Column] = {}
    if row_number:
        final[row_number] = F.col("_rn") + shift
    if rank:
        goes_on = F.col("_prior").isNotNull() & value.eqNullSafe(F.col("_prior"))
        final[rank] = F.when(goes_on, F.col("_o_rk")).otherwise(F.col("_rk") + shift)
    if dense_rank:
        final[dense_rank] = F.col("_dr") + F.coalesce(F.col("_o_nd"), F.lit(0))
    for out in running_sum:
        have, add = F.col(f"_rs_{out}"), F.col(f"_o_{out}")
        final[out] = F.when(add.isNull(), have).when(have.isNull(), add).otherwise(have + add)
    for out in running_avg:
        n = F.col(f"_rc_{out}") + F.coalesce(F.col(f"_oc_{out}"), F.lit(0))
        final[out] = F.try_divide(final[f"_s_{out}"].cast("double"), n)
        del final[f"_s_{out}"]
    for out in running_max:
        final[out] = F.greatest(f"_rm_{out}", f"_om_{out}")
    for out in lag:
        final[out] = F.when(F.col("_rn") == 1, F.col(f"_prev.{out}")).otherwise(F.col(f"_lg_{out}"))
    for out in lead:
        final[out] = F.when(F.col("_last"), F.col(f"_next.{out}")).otherwise(F.col(f"_ld_{out}"))
    return joined.select(*df.columns, *[c.alias(n) for n, c in final.items()])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key. Spark trims each map task to ``n`` rows per key first
    (WindowGroupLimit), so a hot key never travels whole."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key as a partially aggregated max, with no sort and no window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
