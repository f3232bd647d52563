"""Keyed next/previous values that survive skewed keys.

A plain ``lead(...) OVER (PARTITION BY cpu ORDER BY idx)`` sends every row
of a CPU to one task; with ~160 CPUs (or one hot pid holding a third of the
trace) that task never finishes at scale.  Instead each key is cut into idx
blocks:

1. the window runs per ``(key, block)`` -- bounded partitions;
2. a small *carry* table holds one row per ``(key, block)`` (first or last
   value of the block); a window over the carry table (partitioned by key,
   a few rows per block) moves it to the neighbouring block;
3. the carry is joined back on ``(key, block)``.  The main side is already
   hash-partitioned on those columns by the window's exchange, so only the
   carry table is shuffled again; AQE turns the join into a broadcast when
   the carry table turns out small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.expr import quoted

BLK = "_tt_blk"


def _block(order: str, block_rows: int) -> Column:
    return F.floor(quoted(order) / F.lit(int(block_rows))).cast("bigint")


def next_in_group(df: DataFrame, keys: list, values: dict, order: str = "idx",
                  block_rows: int = 1 << 22, member: Column | None = None,
                  use_next: dict | None = None) -> DataFrame:
    """Add ``out = value of the next row of the same key group``.

    ``values`` maps output name -> source column name.  The last row of a group
    keeps its own value.  ``member`` (optional) restricts the groups to rows
    where it is true; other rows keep their own value.  ``use_next`` (optional)
    maps an output name to a condition: rows failing it keep their own value.
    Per-column ``lead`` / ``min_by`` keep every aggregation buffer primitive, so
    the carry aggregate is hash-based with map-side partial aggregation.
    """
    src = list(dict.fromkeys(values.values()))
    tmp = {c: f"_tt_v{i}" for i, c in enumerate(src)}
    gkeys = list(keys)
    base = df.withColumn(BLK, _block(order, block_rows))
    if member is not None:
        base = base.withColumn("_tt_m", F.coalesce(member, F.lit(False)))
        gkeys = gkeys + ["_tt_m"]
    part = [quoted(k) for k in gkeys]
    w = Window.partitionBy(*part, F.col(BLK)).orderBy(quoted(order))
    nexts = {"_tt_nxo": F.lead(quoted(order), 1).over(w)}
    nexts.update({f"_tt_nx_{tmp[c]}": F.lead(quoted(c), 1).over(w) for c in src})
    with_next = base.withColumns(nexts)

    firsts = (base.groupBy(*part, F.col(BLK))
                  .agg(F.min(quoted(order)).alias("_tt_fo"),
                       *[F.min_by(quoted(c), quoted(order)).alias(f"_tt_f_{tmp[c]}") for c in src]))
    wc = Window.partitionBy(*part).orderBy(F.col(BLK))
    carry = firsts.select(*part, F.col(BLK), F.lead("_tt_fo", 1).over(wc).alias("_tt_cxo"),
                          *[F.lead(f"_tt_f_{tmp[c]}", 1).over(wc).alias(f"_tt_cx_{tmp[c]}") for c in src])
    joined = with_next.join(carry, on=gkeys + [BLK], how="left")
    outs = {}
    for out, c in values.items():
        nxt = (F.when(F.col("_tt_nxo").isNotNull(), F.col(f"_tt_nx_{tmp[c]}"))
                .when(F.col("_tt_cxo").isNotNull(), F.col(f"_tt_cx_{tmp[c]}"))
                .otherwise(quoted(c)))
        if member is not None:
            nxt = F.when(F.col("_tt_m"), nxt).otherwise(quoted(c))
        if use_next and out in use_next:
            nxt = F.when(F.coalesce(use_next[out], F.lit(False)), nxt).otherwise(quoted(c))
        outs[out] = nxt
    drop = [BLK, "_tt_nxo", "_tt_cxo"] + [f"_tt_nx_{tmp[c]}" for c in src] + \
        [f"_tt_cx_{tmp[c]}" for c in src] + (["_tt_m"] if member is not None else [])
    return joined.withColumns(outs).drop(*drop)


def last_non_null_in_group(df: DataFrame, keys: list, value: Column, out: str,
                           order: str = "idx", block_rows: int = 1 << 22) -> DataFrame:
    """Add ``out`` = latest non-NULL ``value`` at or before the row in its key group."""
    base = df.withColumn(BLK, _block(order, block_rows)).withColumn("_tt_val", value)
    w = (Window.partitionBy(*[quoted(k) for k in keys], F.col(BLK)).orderBy(quoted(order))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = base.withColumn("_tt_in", F.last("_tt_val", ignorenulls=True).over(w))
    # every block gets a carry row, also blocks without a non-NULL value
    has = F.col("_tt_val").isNotNull()
    lasts = (base.groupBy(*[quoted(k) for k in keys], F.col(BLK))
                 .agg(F.max_by(F.when(has, F.col("_tt_val")), F.when(has, quoted(order)))
                       .alias("_tt_blast")))
    wc = (Window.partitionBy(*[quoted(k) for k in keys]).orderBy(F.col(BLK))
                .rowsBetween(Window.unboundedPreceding, -1))
    carry = lasts.withColumn("_tt_prev", F.last("_tt_blast", ignorenulls=True).over(wc)).drop("_tt_blast")
    joined = within.join(carry, on=list(keys) + [BLK], how="left")
    return (joined.withColumn(out, F.coalesce(F.col("_tt_in"), F.col("_tt_prev")))
                  .drop(BLK, "_tt_val", "_tt_in", "_tt_prev"))


def running_max_by_time(df: DataFrame, keys: list, value: Column, out: str,
                        time_col: str = "timestamp", order: str = "idx",
                        block_rows: int = 1 << 22) -> DataFrame:
    """Add ``out`` = max of ``value`` over rows of the key with time <= the row's
    time (peers with an equal time included, as in a RANGE frame).

    Blocks are idx blocks (time-ordered trace).  Besides the maximum of all
    earlier blocks, the carry brings the values that later blocks of the key
    hold at this block's last time: rows of one time may span any number of
    blocks.  ``value`` is NULL for most rows; only the others are aggregated.
    """
    base = df.withColumn(BLK, _block(order, block_rows)).withColumn("_tt_val", value)
    part = [quoted(k) for k in keys]
    w = (Window.partitionBy(*part, F.col(BLK)).orderBy(quoted(time_col))
               .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    within = base.withColumn("_tt_in", F.max("_tt_val").over(w))
    blocks = base.groupBy(*part, F.col(BLK)).agg(F.min(quoted(time_col)).alias("_tt_t0"), F.max(quoted(time_col)).alias("_tt_t1"))
    held = base.where(F.col("_tt_val").isNotNull()).select(*part, F.col(BLK), quoted(time_col).alias("_tt_t"), "_tt_val")
    tops = held.groupBy(*part, F.col(BLK)).agg(F.max("_tt_val").alias("_tt_bmax"))
    on = list(keys) + [BLK]
    # values at a block's first time, over all blocks that begin at that time
    first = (held.join(blocks, on).where("_tt_t = _tt_t0").groupBy(*part, F.col("_tt_t0").alias("_tt_t1"))
                 .agg(F.max("_tt_val").alias("_tt_next")))
    wc = Window.partitionBy(*part).orderBy(F.col(BLK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = (blocks.join(tops, on, "left").withColumn("_tt_prev", F.max("_tt_bmax").over(wc))
                   .join(first, list(keys) + ["_tt_t1"], "left").select(*on, "_tt_t1", "_tt_prev", "_tt_next"))
    joined = within.join(carry, on=list(keys) + [BLK], how="left")
    peer = F.when(F.col("_tt_t1") == quoted(time_col), F.col("_tt_next"))
    best = F.greatest(F.col("_tt_in"), F.col("_tt_prev"), peer)
    return joined.withColumn(out, best).drop(BLK, "_tt_val", "_tt_in", "_tt_prev", "_tt_next", "_tt_t1")
