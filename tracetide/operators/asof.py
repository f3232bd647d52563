"""As-of lookups: for each probe row, the nearest candidate row of the same
equality group whose key lies after (``next``) or before (``prev``) the
probe's key.

Plan: probes and candidates are unioned and ordered by key inside each
equality group; a *running* ``last(..., ignorenulls)`` frame picks the
nearest candidate (running frames are O(1) per row, unlike frames that
extend to UNBOUNDED FOLLOWING).  To keep one hot group, or one hot key, out of
a single task, the rows -- probes and candidates -- are cut into blocks on
the full sort order (key, kind, id) with bounds from a sample of all rows;
the nearest candidate of the neighbouring blocks comes from a small carry
table joined back on ``(group, block)``.  No pairs are ever enumerated.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..config import conf_int
from .order import bucket_column

SAMPLE_PER_BLOCK = 32     # target sampled rows per block
PARALLEL_ROWS = 1 << 19   # above this, use at least one block per task slot


def _row_blocks(rows: DataFrame, cols: list, block_rows: int, seed: int = 11) -> list:
    """Sorted block bounds on the full sort order of all rows (empty: one block)."""
    n = rows.count()
    nb = int(math.ceil(n / block_rows))
    if n > PARALLEL_ROWS:  # spread medium inputs over all task slots
        nb = max(nb, rows.sparkSession.sparkContext.defaultParallelism)
    if nb <= 1:
        return []
    keys = rows.select(*cols).where(F.col(cols[0]).isNotNull())
    got = sorted(tuple(r) for r in keys.sample(False, min(1.0, SAMPLE_PER_BLOCK * nb / n), seed).collect())
    return sorted({got[(i * len(got)) // nb] for i in range(1, nb)}) if got else []


def _key_type(probes: DataFrame, probe_key: str, cands: DataFrame, cand_key: str) -> str:
    kinds = {isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
             for df, c in ((probes, probe_key), (cands, cand_key))}
    return "bigint" if kinds == {True} else "double"


def asof(probes: DataFrame, cands: DataFrame, eq: list, probe_key: str, cand_key: str,
         cand_idx: str, direction: str, strict: bool, out: str, probe_id: str,
         block_rows: int | None = None, out_key: str | None = None, differ: tuple | None = None) -> DataFrame:
    """Add ``out`` (candidate ``cand_idx`` or NULL), and its key as ``out_key``, to ``probes``.

    ``differ``: (probe column, candidate column) that must not be equal; NULL and
    NaN differ from everything.  Beside the nearest candidate the scan keeps the nearest
    one of another value, and so does the carry.

    ``eq``: list of (probe column, candidate column) equality pairs.
    ``direction='next'``: smallest (key, idx) with key > (>=) probe key;
    ``direction='prev'``: largest key < (<=) probe key, ties -> smallest idx.
    ``probe_id`` must be unique per probe row.
    """
    block_rows = block_rows or conf_int(probes.sparkSession, "tracetide.block.rows")
    gcols = [f"_tt_g{i}" for i in range(len(eq))]
    ktype = _key_type(probes, probe_key, cands, cand_key)
    # probe rows carry their own columns through the window (no join back)
    row = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    of_value = (lambda c: [c.cast(cands.schema[differ[1]].dataType).alias("_tt_v")]) if differ else lambda c: []
    P = probes.select(F.col(probe_id).cast("bigint").alias("_tt_pid"), *of_value(F.lit(None)),
                      *[F.col(a).alias(g) for (a, _), g in zip(eq, gcols)],
                      F.col(probe_key).cast(ktype).alias("_tt_k"),
                      F.lit(None).cast("bigint").alias("_tt_ci"), row.alias("_tt_row"))
    row_type = P.schema["_tt_row"].dataType
    C = cands.select(F.lit(None).cast("bigint").alias("_tt_pid"), *of_value(F.col(differ[1]) if differ else None),
                     *[F.col(b).alias(g) for (_, b), g in zip(eq, gcols)],
                     F.col(cand_key).cast(ktype).alias("_tt_k"),
                     F.col(cand_idx).cast("bigint").alias("_tt_ci"),
                     F.lit(None).cast(row_type).alias("_tt_row"))
    # tie order between a probe and candidates with the same key
    if direction == "next":
        cand_first = strict        # strict: equal keys are not "after" the probe
        cand_tag, probe_tag = (0, 1) if cand_first else (1, 0)
        # reversed scan: nearest following candidate is the last one seen
        order = [F.col("_tt_k").desc(), F.col("_tt_tag").desc(), F.col("_tt_ci").desc_nulls_first()]
    elif direction == "prev":
        cand_first = not strict
        cand_tag, probe_tag = (0, 1) if cand_first else (1, 0)
        order = [F.col("_tt_k").asc(), F.col("_tt_tag").asc(), F.col("_tt_ci").desc_nulls_last()]
    else:
        raise ValueError(direction)
    P = P.withColumn("_tt_tag", F.lit(probe_tag))
    C = C.withColumn("_tt_tag", F.lit(cand_tag))
    U = P.unionByName(C)
    # the place among rows of equal key and kind: probes by id, candidates as the window takes them
    tie = F.coalesce("_tt_pid", F.col("_tt_ci") if direction == "next" else -F.col("_tt_ci"))
    U = U.withColumn("_tt_tie", tie)
    cut = ["_tt_k", "_tt_tag", "_tt_tie"]
    bounds = _row_blocks(U.select(*cut), cut, block_rows) or None
    U = U.withColumn("_tt_blk", bucket_column(U, bounds, cut) if bounds else F.lit(0)).drop("_tt_tie")
    cand = F.when(F.col("_tt_ci").isNotNull(), F.struct(F.col("_tt_k").alias("k"), F.col("_tt_ci").alias("i"), *([F.col("_tt_v").alias("v")] if differ else [])))
    w = (Window.partitionBy(*gcols, "_tt_blk").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if differ:
        hits = _two_of_different_value(U, cand, gcols, order, bounds is not None, direction)
        x = F.col("_tt_row")[differ[0]]
        same = F.col("_tt_hit.v").eqNullSafe(x) & x.isNotNull() & ~F.isnan(x.cast("double"))
        hits = hits.withColumn("_tt_hit", F.when(same, F.col("_tt_other")).otherwise(F.col("_tt_hit")))
        return hits.select("_tt_row.*", F.col("_tt_hit.i").alias(out), *([F.col("_tt_hit.k").alias(out_key)] if out_key else []))
    U = U.withColumn("_tt_hit", F.last(cand, ignorenulls=True).over(w))
    hits = U.where(F.col("_tt_pid").isNotNull())
    if bounds is not None:
        # nearest candidate of the neighbouring non-empty blocks
        if direction == "next":
            edge = F.min(F.struct(F.col("_tt_k").alias("k"), F.col("_tt_ci").alias("i")))
            wc = (Window.partitionBy(*gcols).orderBy(F.col("_tt_blk").desc())
                        .rowsBetween(Window.unboundedPreceding, -1))
        else:
            edge = F.max_by(F.struct(F.col("_tt_k").alias("k"), F.col("_tt_ci").alias("i")),
                            F.struct(F.col("_tt_k"), -F.col("_tt_ci")))
            wc = (Window.partitionBy(*gcols).orderBy(F.col("_tt_blk").asc())
                        .rowsBetween(Window.unboundedPreceding, -1))
        edges = (U.where(F.col("_tt_ci").isNotNull()).groupBy(*gcols, "_tt_blk")
                  .agg(edge.alias("_tt_edge")))
        # blocks without candidates still need the carry of their neighbours
        probe_blocks = hits.select(*gcols, "_tt_blk").distinct()
        all_blocks = probe_blocks.unionByName(edges.select(*gcols, "_tt_blk")).distinct()
        carry = (all_blocks.join(edges, on=gcols + ["_tt_blk"], how="left")
                 .withColumn("_tt_carry", F.last("_tt_edge", ignorenulls=True).over(wc))
                 .select(*gcols, "_tt_blk", "_tt_carry"))
        hits = (hits.join(carry, on=gcols + ["_tt_blk"], how="left")
                    .withColumn("_tt_hit", F.coalesce(F.col("_tt_hit"), F.col("_tt_carry"))))
    return hits.select("_tt_row.*", F.col("_tt_hit.i").alias(out), *([F.col("_tt_hit.k").alias(out_key)] if out_key else []))


def _running_two(rows: DataFrame, cand, part: list, order: list) -> DataFrame:
    """Add _tt_hit, the last candidate up to each row, and _tt_other, the last one of another value than that."""
    to_here = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_tt_cand", cand).withColumn("_tt_before", F.last("_tt_cand", ignorenulls=True).over(before))
    # where the value changes, the candidate before is the other one until the next change
    changed = F.col("_tt_cand").isNotNull() & ~F.col("_tt_cand.v").eqNullSafe(F.col("_tt_before.v"))
    rows = rows.withColumn("_tt_other", F.last(F.when(changed, F.col("_tt_before")), ignorenulls=True).over(to_here))
    return rows.withColumn("_tt_hit", F.coalesce("_tt_cand", "_tt_before")).drop("_tt_cand", "_tt_before")


def _two_of_different_value(U: DataFrame, cand, gcols: list, order: list, blocked: bool, direction: str) -> DataFrame:
    """The probe rows of ``U`` with the nearest candidate and the nearest one of another value.

    The pair of a block is two rows, so the pairs of all blocks before are the same
    scan over two rows for each block.
    """
    part = [*gcols, "_tt_blk"]
    U = _running_two(U, cand, part, order)
    hits = U.where(F.col("_tt_pid").isNotNull())
    if not blocked:
        return hits
    # the pair at the end of each block, in the order of the scan: the other one, then the nearest
    two = F.struct(F.col("_tt_other").alias("o"), F.col("_tt_hit").alias("h"))
    last = F.min_by(two, F.struct("_tt_k", "_tt_ci")) if direction == "next" else F.max_by(two, F.struct(F.col("_tt_k"), -F.col("_tt_ci")))
    ends = U.where(F.col("_tt_ci").isNotNull()).groupBy(*part).agg(last.alias("_tt_last"))
    pair = [F.struct(F.lit(n).alias("n"), F.col("_tt_last")[c].alias("c")) for n, c in enumerate(("o", "h"))]
    ends = ends.select(*part, F.explode(F.array(*pair)).alias("_tt_e"))
    ends = ends.where("_tt_e.c is not null").select(*part, F.col("_tt_e.n").alias("_tt_n"), F.col("_tt_e.c").alias("_tt_c"))
    asking = hits.select(*part).distinct().select(*part, F.lit(-1).alias("_tt_n"), F.lit(None).cast(ends.schema["_tt_c"].dataType).alias("_tt_c"))
    turn = F.col("_tt_blk").desc() if direction == "next" else F.col("_tt_blk").asc()
    carry = _running_two(ends.unionByName(asking), F.col("_tt_c"), gcols, [turn, F.col("_tt_n").asc()])
    carry = carry.where("_tt_n = -1").select(*part, F.col("_tt_hit").alias("_tt_c1"), F.col("_tt_other").alias("_tt_c2"))
    hits = hits.join(carry, on=part, how="left")
    # the block's own run comes first; what the block lacks comes from the blocks before
    from_carry = F.when(F.col("_tt_hit").isNull() | ~F.col("_tt_c1.v").eqNullSafe(F.col("_tt_hit.v")), F.col("_tt_c1")).otherwise(F.col("_tt_c2"))
    other = F.when(F.col("_tt_hit").isNull(), F.col("_tt_c2")).otherwise(F.coalesce("_tt_other", from_carry))
    return hits.withColumn("_tt_other", other).withColumn("_tt_hit", F.coalesce("_tt_hit", "_tt_c1"))


def group_extreme(probes: DataFrame, cands: DataFrame, eq: list, cand_key: str, cand_idx: str,
                  which: str, out: str, probe_bound: str | None = None,
                  bound_op: str | None = None, out_key: str | None = None, differ: tuple | None = None) -> DataFrame:
    """argmin / argmax over all candidates of the probe's equality group,
    optionally kept only if it satisfies ``cand_key <bound_op> probe_bound``.

    ``differ`` as in :func:`asof`."""
    if differ:
        return _extreme_of_different_value(probes, cands, eq, cand_key, cand_idx, which, out, out_key or "_tt_key", differ)
    gcols = [f"_tt_g{i}" for i in range(len(eq))]
    ktype = _key_type(cands, cand_key, cands, cand_key) if probe_bound is None \
        else _key_type(probes, probe_bound, cands, cand_key)
    k, i = F.col(cand_key).cast(ktype), F.col(cand_idx).cast("bigint")
    if which == "min":
        agg = F.min(F.struct(k.alias("k"), i.alias("i")))
    else:
        agg = F.max_by(F.struct(k.alias("k"), i.alias("i")), F.struct(k, -i))
    if eq:
        best = (cands.select(*[F.col(b).alias(g) for (_, b), g in zip(eq, gcols)], k.alias("_k"), i.alias("_i"))
                .groupBy(*gcols).agg((F.min(F.struct(F.col("_k").alias("k"), F.col("_i").alias("i"))) if which == "min"
                                      else F.max_by(F.struct(F.col("_k").alias("k"), F.col("_i").alias("i")),
                                                    F.struct(F.col("_k"), -F.col("_i")))).alias("_tt_best")))
        staged = probes.select("*", *[F.col(a).alias(g) for (a, _), g in zip(eq, gcols)])
        staged = staged.join(best, on=gcols, how="left").drop(*gcols)
        best_col = F.col("_tt_best")
    else:
        best_col = cands.select(agg).scalar()
        staged = probes.withColumn("_tt_best", best_col)
        best_col = F.col("_tt_best")
    hit = best_col["i"]
    if probe_bound is not None:
        ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
               ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        hit = F.when(ops[bound_op](best_col["k"], F.col(probe_bound).cast(ktype)), hit)
    staged = staged.withColumn(out, hit)
    if out_key:
        staged = staged.withColumn(out_key, F.when(F.col(out).isNotNull(), F.col("_tt_best")["k"]))
    return staged.drop("_tt_best")


def _extreme_of_different_value(probes: DataFrame, cands: DataFrame, eq: list, cand_key: str, cand_idx: str, which: str,
                                out: str, out_key: str, differ: tuple) -> DataFrame:
    """The best row of each value, of these the first two of a group: one of them differs from the probe's value."""
    x, v = differ
    ktype = _key_type(cands, cand_key, cands, cand_key)
    gcols = [f"_tt_g{i}" for i in range(len(eq))]
    keyed = cands.select(*[F.col(b).alias(g) for (_, b), g in zip(eq, gcols)], F.col(v).alias("_tt_v"), F.col(cand_key).cast(ktype).alias("_k"),
                         F.col(cand_idx).cast("bigint").alias("_i"))
    row = F.struct(F.col("_k").alias("k"), F.col("_i").alias("i"))
    best = F.min(row) if which == "min" else F.max_by(row, F.struct(F.col("_k"), -F.col("_i")))
    keyed = keyed.groupBy(*gcols, "_tt_v").agg(best.alias("_b"))
    order = Window.partitionBy(*gcols).orderBy(F.col("_b.k").asc() if which == "min" else F.col("_b.k").desc(), F.col("_b.i").asc())
    keyed = keyed.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    nth = lambda n, c: F.max(F.when(F.col("_n") == n, c))
    two = [nth(1, F.col("_b")).alias("first"), nth(1, F.col("_tt_v")).alias("value"), nth(2, F.col("_b")).alias("second")]
    if eq:
        staged = probes.select("*", *[F.col(a).alias(g) for (a, _), g in zip(eq, gcols)])
        staged = staged.join(keyed.groupBy(*gcols).agg(F.struct(*two).alias("_tt_two")), on=gcols, how="left").drop(*gcols)
    else:
        staged = probes.withColumn("_tt_two", keyed.agg(F.struct(*two).alias("_tt_two")).scalar())
    same = F.col("_tt_two.value").eqNullSafe(F.col(x)) & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    staged = staged.withColumn("_tt_hit", F.when(same, F.col("_tt_two.second")).otherwise(F.col("_tt_two.first")))
    return staged.withColumn(out, F.col("_tt_hit.i")).withColumn(out_key, F.col("_tt_hit.k")).drop("_tt_two", "_tt_hit")
