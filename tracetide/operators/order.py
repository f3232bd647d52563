"""Order-sensitive operators without a single-partition window.

* :func:`with_position` -- dense 0-based position by a sort key (WIN7).
  Rows are cut into range buckets whose bounds come from a bounded sample
  (taken on the full composite key, so ties of a hot key value are split
  by idx); each bucket is numbered by ``row_number`` and shifted by the
  prefix count of the smaller buckets (a tiny table, one value per bucket).
  When the frame holds at most ``tracetide.bucket.rows`` rows a single
  bucket is used; the count proves the bound.
* :func:`rank` (argsort of argsort) and :func:`argsort` (WIN4, WIN5).
* :func:`rolling` -- trailing-window sum / mean / median (WIN1-3) by
  position blocks with a halo of the previous ``w`` rows.  Sum and mean use
  exact decimal prefix sums, so a 32 000-row window costs O(1) per row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..config import conf_int, materialize
from ..functions.expr import decimal_exact, kind_of, quoted

SAMPLE_PER_BUCKET = 32   # target sampled keys per bucket
PARALLEL_ROWS = 1 << 19  # above this, use at least one bucket per task slot


def _count_le(bcols: list, kcols: list) -> np.ndarray:
    """Per row: number of (lexicographically sorted) bounds <= the row's key."""
    b0, k0 = bcols[0], kcols[0]
    if len(bcols) == 1:
        return np.searchsorted(b0, k0, side="right")
    lo = np.searchsorted(b0, k0, side="left")
    hi = np.searchsorted(b0, k0, side="right")
    out = lo.copy()
    tie = hi > lo
    if tie.any():
        for a, b in set(zip(lo[tie].tolist(), hi[tie].tolist())):
            sel = tie & (lo == a) & (hi == b)
            out[sel] = a + _count_le([c[a:b] for c in bcols[1:]], [k[sel] for k in kcols[1:]])
    return out


JVM_BOUNDS = 64  # up to this many bounds: bucket = count of bounds <= key, JVM-side


def bucket_column(df: DataFrame, bounds: list, cols: list):
    """Number of (lexicographically sorted) bounds <= the row's key."""
    if len(bounds) <= JVM_BOUNDS:
        types = [df.schema[c].dataType for c in cols]
        if len(cols) == 1:
            arr = F.array(*[F.lit(b[0]).cast(types[0]) for b in bounds])
            key = quoted(cols[0])
        else:
            arr = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, types))])
                            for b in bounds])
            key = F.struct(*[quoted(c).alias(f"k{i}") for i, c in enumerate(cols)])
        return F.size(F.filter(arr, lambda b: b <= key)).cast("int")
    return _bucket_udf(bounds, len(cols))(*[quoted(c) for c in cols])


def _bucket_udf(bounds: list, ncols: int):
    """Vectorised 'number of bounds <= key' for composite sort keys."""
    bcols = [np.array([b[i] for b in bounds]) for i in range(ncols)]

    @F.pandas_udf(T.IntegerType())
    def bucket(*cols: pd.Series) -> pd.Series:
        return pd.Series(_count_le(bcols, [c.to_numpy() for c in cols]).astype("int32"))

    return bucket


def with_position(df: DataFrame, order_cols: list, out: str = "pos",
                  bucket_rows: int | None = None, seed: int = 17,
                  checkpoint: bool = True, group: str | None = None) -> DataFrame:
    """Add ``out``: dense 0-based position of each row ordered by ``order_cols``
    (within each value of ``group`` when given; ``group`` is a low-cardinality
    tag such as a pipeline number: its value counts are collected).

    ``order_cols`` must be non-NULL and (together, per group) unique, e.g.
    ``[key, "idx"]``.  The input is checkpointed first (``checkpoint=True``):
    the count, the sample, the bucket counts and the numbering then all read
    it instead of recomputing the upstream plan.
    """
    bucket_rows = bucket_rows or conf_int(df.sparkSession, "tracetide.bucket.rows")
    keys = ([group] if group else []) + list(order_cols)
    cols = [quoted(c) for c in keys]
    if checkpoint:
        df = materialize(df)
    slots = df.sparkSession.sparkContext.defaultParallelism
    sizes = None
    if group:
        sizes = sorted((r[0], int(r[1])) for r in df.groupBy(quoted(group)).count().collect())
        n = sum(c for _, c in sizes)
        if sizes and max(c for _, c in sizes) <= bucket_rows and (n <= PARALLEL_ROWS or 2 * len(sizes) >= slots):
            # every group fits one ordering task, and there are enough of them
            w = Window.partitionBy(quoted(group)).orderBy(*[quoted(c) for c in order_cols])
            return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    else:
        n = df.count()
    nb = int(math.ceil(n / bucket_rows))
    if n > PARALLEL_ROWS:  # spread medium frames over all task slots
        nb = max(nb, slots)
    if nb <= 1:
        # proven bound: at most bucket_rows rows in the single ordering task
        w = Window.partitionBy(quoted(group) if group else F.lit(0)).orderBy(
            *[quoted(c) for c in order_cols])
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    target = SAMPLE_PER_BUCKET * nb
    frac = min(1.0, target / n)
    # about SAMPLE_PER_BUCKET keys for each bucket of bucket_rows rows, from all partitions alike
    sample = df.select(*cols).sample(withReplacement=False, fraction=frac, seed=seed).collect()
    skeys = sorted(tuple(r) for r in sample)
    bounds = []
    for i in range(1, nb):
        b = skeys[min(len(skeys) - 1, (i * len(skeys)) // nb)]
        if not bounds or b != bounds[-1]:
            bounds.append(b)
    staged = df.withColumn("_tt_bkt", bucket_column(df, bounds, keys))
    counts = dict(staged.groupBy("_tt_bkt").count().collect())
    offsets, acc = [], 0
    for b in range(len(bounds) + 1):
        offsets.append(acc)
        acc += int(counts.get(b, 0))
    w = Window.partitionBy("_tt_bkt").orderBy(*cols)
    pos = F.element_at(F.lit(offsets), F.col("_tt_bkt") + 1) + F.row_number().over(w) - 1
    if group:
        # global position over (group, key) minus the rows of smaller groups
        starts, acc = [], 0
        for g, c in sizes:
            starts += [F.lit(g), F.lit(acc)]
            acc += int(c)
        pos = pos - F.element_at(F.create_map(*starts), quoted(group))
    return staged.withColumn(out, pos.cast("bigint")).drop("_tt_bkt")


def _valid(df: DataFrame, key: str) -> Column:
    c = quoted(key)
    ok = c.isNotNull()
    if kind_of(df.schema[key].dataType) == "float":
        ok = ok & ~F.isnan(c)
    return ok


def rank(df: DataFrame, key: str, out: str, order: str = "idx", group: str | None = None,
         **kw) -> DataFrame:
    """0-based rank by (key, order) among rows with a valid key (within
    ``group``); others -1.  Equals ``argsort(argsort(key))`` when the key has
    no NaN.
    """
    # one ordering pass over all rows, those without a valid key last
    late, safe = "_tt_late", "_tt_key"
    ok = _valid(df, key)
    zero = F.lit(0).cast(df.schema[key].dataType)
    keyed = df.withColumn(late, (~ok).cast("int")).withColumn(safe, F.when(ok, quoted(key)).otherwise(zero))
    placed = with_position(keyed, [late, safe, order], out, group=group, **kw)
    return placed.withColumn(out, F.when(F.col(late) == 0, F.col(out)).otherwise(F.lit(-1)).cast("bigint")).drop(late, safe)


def argsort(df: DataFrame, key: str, out: str, order: str = "idx", group: str | None = None,
            **kw) -> DataFrame:
    """``out`` at the j-th row (in ``order``) = position of the j-th smallest key.

    Positions are counted among rows with a valid key; NaN/NULL rows get -1.
    Ties are broken by ``order`` (stable).
    """
    df = materialize(df)  # read by both orderings and by the join
    ok = _valid(df, key)
    g = [quoted(group).alias("_tt_g")] if group else [F.lit(0).alias("_tt_g")]
    v = df.where(ok).select(quoted(order).alias("_tt_o"), quoted(key).alias("_tt_k"), *g)
    v = with_position(v, ["_tt_o"], "_tt_pos", group="_tt_g", **kw)
    v = with_position(materialize(v), ["_tt_k", "_tt_o"], "_tt_rank", checkpoint=False,
                      group="_tt_g", **kw)
    by_rank = v.select(F.col("_tt_g").alias("_tt_g2"), F.col("_tt_rank").alias("_tt_j"),
                       F.col("_tt_pos").alias("_tt_src"))
    at_pos = (v.select("_tt_o", "_tt_g", "_tt_pos")
                .join(by_rank, (F.col("_tt_pos") == F.col("_tt_j")) & (F.col("_tt_g") == F.col("_tt_g2")))
                .select(F.col("_tt_o").alias(order), *([F.col("_tt_g").alias(group)] if group else []),
                        "_tt_src"))
    return (df.join(at_pos, on=[order] + ([group] if group else []), how="left")
              .withColumn(out, F.coalesce(F.col("_tt_src"), F.lit(-1)).cast("bigint"))
              .drop("_tt_src"))


ROLLING_OPS = ("sum", "mean", "median")


def rolling(df: DataFrame, window: int, op: str, key, out: str | None = None,
            order: str = "idx", block_rows: int | None = None, digits: int | None = None,
            pos_col: str | None = None, group: str | None = None, **kw) -> DataFrame:
    """Trailing ``window``-row aggregate in ``order``; NULL until the window is
    full or when any value inside it is NaN/NULL or infinite.

    ``key`` is a column name (result in ``out``) or a dict ``{out: key}`` to
    compute several columns in the same window pass.  See :func:`rolling_many`.
    """
    targets = dict(key) if isinstance(key, dict) else {out: key}
    return rolling_many(df, op, [(window, o, k) for o, k in targets.items()], order=order,
                        block_rows=block_rows, digits=digits, pos_col=pos_col, group=group, **kw)


def rolling_many(df: DataFrame, op: str, targets: list, order: str = "idx",
                 block_rows: int | None = None, digits: int | None = None,
                 pos_col: str | None = None, group: str | None = None, **kw) -> DataFrame:
    """Several trailing-window aggregates ``(window, out, key)`` in one pass.

    Rows are cut into position blocks of ``max(4 * max window, rolling.block)``
    rows plus a halo with the previous ``max window`` rows, partitioned by
    ``(group, block)``.  Sum / mean: exact decimal prefix sums per key, shared
    by all windows (O(1) per row and window).  ``pos_col`` names an existing
    dense position column (0..n-1 in ``order``, per group) to reuse.
    ``digits`` (sum/mean only): round half-up to that many decimals in exact
    decimal arithmetic before converting to double.
    """
    if op not in ROLLING_OPS:
        raise ValueError(f"rolling op must be one of {ROLLING_OPS}, got {op!r}")
    for w, _, _ in targets:
        if not isinstance(w, int) or isinstance(w, bool) or w < 1:
            raise ValueError(f"rolling window must be a positive int, got {w!r}")
    wmax = max(w for w, _, _ in targets)
    block = max(4 * wmax, block_rows or conf_int(df.sparkSession, "tracetide.rolling.block"))
    if pos_col is None:
        p = with_position(df, [order], "_tt_pos", group=group, **kw)
        pos = "_tt_pos"
    else:
        p, pos = df, pos_col
    p = p.withColumn("_tt_blk", F.floor(F.col(pos) / F.lit(block)).cast("bigint"))
    halo_rows = wmax if op in ("sum", "mean") else wmax - 1
    parts = p.withColumn("_tt_own", F.lit(True))
    if halo_rows > 0:
        halo = (p.where(F.pmod(F.col(pos), F.lit(block)) >= block - halo_rows)
                 .withColumn("_tt_blk", F.col("_tt_blk") + 1)
                 .withColumn("_tt_own", F.lit(False)))
        parts = parts.unionByName(halo)
    if op == "median":
        return _rolling_blocks(parts, op, targets, pos, group, pos_col is None)
    floats = sorted({k for _, _, k in targets if kind_of(df.schema[k].dataType) == "float"})
    if floats and digits is None:
        finite = [F.when(~F.isnan(quoted(k)) & (F.abs(quoted(k)) < F.lit(float("inf"))), quoted(k)) for k in floats]
        short = p.agg(*[F.bool_and(F.coalesce(decimal_exact(v), F.lit(True))) for v in finite]).first()
        if not all(x is None or x for x in short):
            return _rolling_blocks(parts, op, targets, pos, group, pos_col is None)
    wp = Window.partitionBy(*([quoted(group)] if group else []), "_tt_blk").orderBy(pos)
    run = wp.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    helpers, outs, prefix = [], {}, {}
    for w, o, k_name in targets:
        is_float = kind_of(df.schema[k_name].dataType) == "float"
        k = quoted(k_name)
        bad = k.isNull() | ((F.isnan(k) | (F.abs(k) == F.lit(float("inf")))) if is_float else F.lit(False))
        complete = F.col(pos) >= (w - 1)
        if op in ("sum", "mean"):
            dec = "decimal(38,10)" if is_float else "decimal(38,0)"
            if k_name not in prefix:
                cs, cb = f"_tt_cs{len(prefix)}", f"_tt_cb{len(prefix)}"
                val = F.when(bad, F.lit(0)).otherwise(k).cast(dec)
                parts = (parts.withColumn(cs, F.sum(val).over(run))
                              .withColumn(cb, F.sum(bad.cast("int")).over(run)))
                helpers += [cs, cb]
                prefix[k_name] = (cs, cb)
            cs, cb = prefix[k_name]
            s = F.col(cs) - F.coalesce(F.lag(cs, w).over(wp), F.lit(0).cast(dec))
            nbad = F.col(cb) - F.coalesce(F.lag(cb, w).over(wp), F.lit(0))
            div = 1 if op == "sum" else w
            if digits is None:
                agg = s.cast("double") / F.lit(float(div))
            else:
                scale = 10 ** digits
                q = F.floor((s * F.lit(2 * scale) + F.lit(div)) / F.lit(2 * div))
                agg = q.cast("double") / F.lit(float(scale))
        else:
            frame = wp.rowsBetween(-(w - 1), Window.currentRow)
            nbad = F.sum(bad.cast("int")).over(frame)
            agg = F.percentile(k.cast("double"), F.lit(0.5)).over(frame)
        outs[o] = F.when(complete & (nbad == 0), agg)
    result = parts.withColumns(outs).where("_tt_own")
    drop = ["_tt_blk", "_tt_own"] + helpers + (["_tt_pos"] if pos_col is None else [])
    return result.drop(*drop)


def _exact_window_sums(x: np.ndarray, w: int) -> np.ndarray:
    """Correctly rounded sum of each ``w`` consecutive finite doubles, in time that does not depend on ``w``.

    Every value is a whole number of the smallest unit in ``x``, kept in digits
    of 32 bits.  Running sums of digits are whole numbers below 2**63, so the
    difference of two of them is the window's sum without any error; it is rounded once.
    """
    n = len(x) - w + 1
    fraction, exponent = np.frexp(x)
    mantissa, exponent = np.ldexp(fraction, 53).astype(np.int64), exponent.astype(np.int64) - 53
    some = mantissa != 0
    if not some.any():
        return np.zeros(n)
    base = int(exponent[some].min())
    shift = np.where(some, exponent - base, 0)
    width = int(shift.max()) // 32 + 5  # three digits a value, two for the sums
    sign, size = np.sign(mantissa), np.abs(mantissa).astype(np.uint64)
    place, turn, low32 = shift // 32, (shift % 32).astype(np.uint64), np.uint64(0xFFFFFFFF)
    low, high = (size & low32) << turn, (size >> np.uint64(32)) << turn
    digits = np.zeros((width, len(x) + 1), np.int64)
    at = np.arange(1, len(x) + 1)
    for k, part in enumerate((low & low32, (low >> np.uint64(32)) + (high & low32), high >> np.uint64(32))):
        digits[place + k, at] = sign * part.astype(np.int64)
    np.cumsum(digits, axis=1, out=digits)
    total = digits[:, w:] - digits[:, :-w]

    def carried(d):
        for k in range(width - 1):
            d[k + 1] += d[k] >> 32
            d[k] &= 0xFFFFFFFF
        return d

    negative = carried(total.copy())[-1] < 0
    total = carried(np.where(negative, -total, total)).astype(np.uint64)
    top = width - 1 - np.argmax(total[::-1] > 0, axis=0)
    column = np.arange(n)
    digit = lambda k: np.where(top >= k, total[np.maximum(top - k, 0), column], np.uint64(0))
    # 64 bits from the first one that is set, and whether anything lies below them
    first = digit(0)
    gap = (32 - np.frexp(np.maximum(first, 1).astype(np.float64))[1]).astype(np.uint64)
    bits = (((first << np.uint64(32)) | digit(1)) << gap) | np.where(gap > 0, digit(2) >> (np.uint64(32) - gap) % np.uint64(64), np.uint64(0))
    nonzero_to = np.concatenate([np.zeros((1, n), np.int64), np.cumsum(total > 0, axis=0)])
    rest = ((digit(2) << gap) & low32) > 0
    rest |= nonzero_to[np.maximum(top - 2, 0), column] > 0
    tail = bits & np.uint64(2047)
    mantissa = bits >> np.uint64(11)
    up = (tail > 1024) | ((tail == 1024) & (rest | (mantissa & np.uint64(1) == 1)))
    power = base + 32 * (top - 1) - gap.astype(np.int64) + 11
    out = np.ldexp((mantissa + up).astype(np.float64), power.astype(np.int32))
    return np.where(total.any(axis=0), np.where(negative, -out, out), 0.0)


def _rolling_blocks(parts: DataFrame, op: str, targets: list, pos: str, group: str | None,
                    drop_pos: bool) -> DataFrame:
    """Rolling values per bounded position block (block rows + halo): pandas'
    O(log w) sliding median, or exact sums of doubles that are no short decimals;
    NULL until full or when a NaN/NULL or infinity is inside."""
    outs = [(w, o, k) for w, o, k in targets]
    schema = T.StructType(parts.schema.fields + [T.StructField(o, T.DoubleType()) for _, o, _ in outs])

    def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        for w, o, k in outs:
            vals = pd.to_numeric(pdf[k], errors="coerce").astype("float64")
            if op == "median":
                got = vals.rolling(w, min_periods=w).median()
            else:
                x = vals.to_numpy()
                bad = ~np.isfinite(x)
                got = pd.Series(np.nan, index=vals.index)
                if len(x) >= w:
                    sums = _exact_window_sums(np.where(bad, 0.0, x), w) / (w if op == "mean" else 1)
                    n_bad = np.concatenate([[0], np.cumsum(bad)])
                    got.iloc[w - 1:] = np.where(n_bad[w:] > n_bad[:-w], np.nan, sums)
            got[pdf[pos] < w - 1] = np.nan
            pdf[o] = got
        return pdf

    keys = ([quoted(group)] if group else []) + [F.col("_tt_blk")]
    result = parts.groupBy(*keys).applyInPandas(per_block, schema)
    result = result.withColumns({o: F.when(~F.isnan(F.col(o)), F.col(o)) for _, o, _ in outs})
    drop = ["_tt_blk", "_tt_own"] + (["_tt_pos"] if drop_pos else [])
    return result.where("_tt_own").drop(*drop)
