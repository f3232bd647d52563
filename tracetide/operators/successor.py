"""Range successor: the nearest row in key order whose other column is on the asked side of a bound.

For each probe: among the candidates of its equality group with a key beyond
the probe's key bounds (none: all of them) and ``value <op> bound``, the one with the
smallest (``next``) or largest (``prev``) key, ties to the smallest idx.

Plan, without pairs.  "First row from here on with a value above x":

1. Probes and candidates are unioned and cut into blocks on the full sort order
   (key, kind, id), as in :mod:`.asof`.  A block of a group has a tree of maxima over its
   rows; all its probes climb and descend it together (numpy, O(log n) each).  The
   block also leaves its records: rows whose value is above all before
   them, the only rows that a probe from an earlier block can hit there.
2. A probe without a hit needs the first later block whose maximum is above x.  The maxima are
   the leaves of a tree of 64 children a node, stored as one row for each node; the
   probes climb and descend it by equality joins, two for each level (:func:`_later_block`).
3. In that block the hit is the record with the smallest value above x: an as-of lookup
   by value, with the block as an equality key.

Without a key bound only the records of the whole group count, and step 3 is all.

A second bound on other columns (:func:`tree_keys`) becomes an equality key: values are
ranked, each candidate is put under the nodes of a tree over the ranks that hold
it, and a probe's range is a few nodes for each level.  So does a ``!=`` (:func:`differ_keys`).
Probes that one of the next candidates in their block answers are done before (:func:`look_ahead`).  So every further bound
multiplies the rows by the logarithm of the number of different values.

NULL and NaN keys, values and bounds never compare, and NULL equality keys match nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import conf_int, materialize
from .asof import _key_type, _row_blocks, asof
from .order import bucket_column, with_position

MOST_ROWS = 1 << 20  # rows of a block that one task holds
CHUNK_ROWS = 1 << 16  # rows looked at together where groups are small
NARROW = 1 << 20  # whole numbers of a smaller range need no ranks
FAN_BITS = 6  # a node of the tree over blocks has 64 children
TREE_BITS = 2  # a node of a tree over ranks has 4, or 16 where few rows ask
FEW_BITS = 4
LOOK = 256  # candidates that look_ahead tries for a probe


def first_reaching(values: np.ndarray, start: np.ndarray, least: np.ndarray) -> np.ndarray:
    """First index >= start with values[index] >= least, for each (start, least); len(values) if there is none."""
    n = len(values)
    width = 1 << max(0, n - 1).bit_length()
    levels = [np.concatenate([values, np.full(width - n, -1, values.dtype)])]
    while len(levels[-1]) > 1:
        levels.append(np.maximum(levels[-1][::2], levels[-1][1::2]))
    node, found = start.copy(), np.full(len(start), -1)
    for height, level in enumerate(levels):  # up: a right child is looked at, a left one by its parent
        look = np.flatnonzero((found < 0) & (node < len(level)) & ((node & 1 == 1) | (height == len(levels) - 1)))
        hit = level[node[look]] >= least[look]
        found[look[hit]] = height
        miss = look[~hit]
        node[miss] += 1
        up = found < 0
        node[up] >>= 1
    for height in range(len(levels) - 1, 0, -1):  # down, to the left where the left child reaches
        at = np.flatnonzero(found == height)
        left = 2 * node[at]
        node[at] = left + (levels[height - 1][left] < least[at])
        found[at] = height - 1
    return np.where(found == 0, node, n)


def _solve(table: pa.Table, strict: bool, types: pa.Schema):
    """Rows of whole units (see _blocks): probes with their hits, and the records."""
    position, ci, key, v, x = (table.column(c).combine_chunks() for c in ("_tt_pos", "_tt_ci", "_tt_k", "_tt_v", "_tt_x"))
    n = len(position)
    is_cand = ci.is_valid().to_numpy(zero_copy_only=False)
    asks = x.is_valid().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(position.to_numpy() == 1)
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    rank = np.full(n, -1)
    values, probes = np.flatnonzero(is_cand), np.flatnonzero(asks)
    both = np.concatenate([v.drop_null().to_numpy(), x.drop_null().to_numpy()])
    rank[np.concatenate([values, probes])] = np.unique(both, return_inverse=True)[1]
    least = rank[probes] + strict
    rank[probes] = -1
    at = first_reaching(rank, probes, least)
    hit = at < end[probes]
    probe_hit, at = probes[hit], at[hit]
    # records: above the maximum of all rows before in the unit; units are told apart by an offset
    unit = np.cumsum(position.to_numpy() == 1)
    lifted = np.where(is_cand, rank + unit * (len(both) + 1), unit * (len(both) + 1) - 1)
    before = np.concatenate([[-1], np.maximum.accumulate(lifted)[:-1]])
    record = is_cand & (lifted > np.maximum(before, unit * (len(both) + 1) - 1))
    keep = np.flatnonzero(~is_cand | record)
    take = np.full(n, -1)
    take[probe_hit] = at
    some = take[keep] >= 0
    rows = pa.array(np.where(some, take[keep], 0), mask=~some)
    out = table.take(pa.array(keep))
    out = out.append_column("_tt_hi", ci.take(rows)).append_column("_tt_hk", key.take(rows)).drop_columns(["_tt_pos"])
    return out.select(types.names).to_batches(max_chunksize=CHUNK_ROWS)


def _blocks(rows: DataFrame, gcols: list, strict: bool) -> DataFrame:
    """``rows`` (gcols, _tt_blk, _tt_k, _tt_tag, _tt_tie, _tt_ci, _tt_v, _tt_x, _tt_row) -> probes with _tt_hi, _tt_hk, and records."""
    unit = Window.partitionBy(*gcols, "_tt_blk").orderBy("_tt_k", "_tt_tag", "_tt_tie")
    rows = rows.withColumn("_tt_pos", F.row_number().over(unit))
    fields = [f for f in rows.schema.fields if f.name != "_tt_pos"]
    schema = T.StructType([*fields, T.StructField("_tt_hi", T.LongType()), T.StructField("_tt_hk", rows.schema["_tt_k"].dataType)])
    names = pa.schema([(f.name, pa.null()) for f in schema.fields])

    return rows.mapInArrow(_by_units(lambda t: _solve(t, strict, names)), schema)


def _by_units(solve):
    """A function of Arrow batches that gives ``solve`` some whole units (from a _tt_pos of 1 to the next) at a time."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            new = np.flatnonzero(batch.column("_tt_pos").to_numpy() == 1)
            if len(new) and size + int(new[-1]) >= CHUNK_ROWS:
                ready = pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))])
                if ready.num_rows:
                    yield from solve(ready)
                held, size, batch = [], 0, batch.slice(int(new[-1]))
            held.append(batch)
            size += batch.num_rows
        if size:
            yield from solve(pa.Table.from_batches(held))

    return run


def _later_block(asked: DataFrame, tops: DataFrame, gcols: list, n_blocks: int, strict: bool) -> DataFrame:
    """Add _tt_in, the first block after _tt_own of the group whose top (_tt_v) is above _tt_x, or NULL."""
    height = 1
    while 1 << FAN_BITS * height < n_blocks:
        height += 1
    nodes, level = [], tops.select(*gcols, "_tt_blk", "_tt_v")
    for _ in range(height):
        kids = F.array_sort(F.collect_list(F.struct(F.col("_tt_blk").alias("b"), F.col("_tt_v").alias("v"))))
        level = materialize(level.groupBy(*gcols, F.shiftright("_tt_blk", FAN_BITS).alias("_tt_node")).agg(kids.alias("_tt_kids"), F.max("_tt_v").alias("_tt_v")))
        nodes.append(level.select(*gcols, "_tt_node", "_tt_kids"))
        level = level.select(*gcols, F.col("_tt_node").alias("_tt_blk"), "_tt_v")

    def first_kid(after=None):
        x = F.col("_tt_x")
        reaches = lambda kid: ((kid["v"] > x) if strict else (kid["v"] >= x)) & (F.lit(True) if after is None else (kid["b"] > after))
        return F.get(F.filter("_tt_kids", reaches), F.lit(0))["b"]

    asked = asked.withColumn("_tt_at", F.lit(None).cast("bigint")).withColumn("_tt_level", F.lit(None).cast("int"))
    for h in range(height):  # up, as long as no later child reaches x
        place = F.when(F.col("_tt_at").isNull(), F.shiftright("_tt_own", FAN_BITS * (h + 1)))
        asked = asked.withColumn("_tt_node", place).join(nodes[h], [*gcols, "_tt_node"], "left")
        found = first_kid(F.shiftright("_tt_own", FAN_BITS * h))
        asked = asked.withColumn("_tt_level", F.when(F.col("_tt_node").isNotNull() & found.isNotNull(), h).otherwise(F.col("_tt_level")))
        asked = asked.withColumn("_tt_at", F.coalesce("_tt_at", found)).drop("_tt_node", "_tt_kids")
    for h in range(height - 1, 0, -1):  # down to a block
        here = F.col("_tt_level") == h
        asked = asked.withColumn("_tt_node", F.when(here, F.col("_tt_at"))).join(nodes[h - 1], [*gcols, "_tt_node"], "left")
        asked = asked.withColumn("_tt_at", F.when(here, first_kid()).otherwise(F.col("_tt_at")))
        asked = asked.withColumn("_tt_level", F.when(here, h - 1).otherwise(F.col("_tt_level"))).drop("_tt_node", "_tt_kids")
    return asked.withColumnRenamed("_tt_at", "_tt_in").drop("_tt_level")


def _usable(c):
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def _mirrored(c, kind: str):
    """The order of a number turned round, without overflow."""
    return F.bitwise_not(c) if kind == "bigint" else -c


def range_successor(probes: DataFrame, cands: DataFrame, eq: list, key_bounds: list, bound: tuple, cand_key: str, cand_idx: str,
                    direction: str, out: str, probe_id: str, out_key: str, block_rows: int | None = None) -> DataFrame:
    """Add ``out`` (candidate ``cand_idx`` or NULL) and its key ``out_key`` to ``probes``.

    ``eq``: (probe column, candidate column) pairs; ``key_bounds``: (op, probe
    column) on the near side of the key, of which all must hold; ``bound``:
    (candidate column, op, probe columns): the value compares with each of them.
    """
    spark = probes.sparkSession
    block_rows = min(block_rows or conf_int(spark, "tracetide.block.rows"), MOST_ROWS)
    column, op, bound_cols = bound
    gcols = [f"_tt_g{i}" for i in range(len(eq))]
    both = lambda kinds: "bigint" if set(kinds) == {"bigint"} else "double"
    ktype = both([_key_type(probes, c, cands, cand_key) for _, c in key_bounds] or [_key_type(cands, cand_key, cands, cand_key)])
    vtype = both(_key_type(probes, c, cands, column) for c in bound_cols)
    k = F.col(cand_key).cast(ktype)
    k = k if direction == "next" else _mirrored(k, ktype)
    upward, strict = op in (">", ">="), op in ("<", ">")
    turned = lambda c: c if upward else _mirrored(c, vtype)

    # of several bounds the farthest counts, strictly so if one that says so reaches it
    limits = [(o in ("<", ">"), F.col(c).cast(ktype)) for o, c in key_bounds]
    limits = [(s, c if direction == "next" else _mirrored(c, ktype)) for s, c in limits]
    far = reduce(lambda a, b: F.greatest(a, b), [c for _, c in limits]) if limits else F.lit(None).cast(ktype)
    after = reduce(lambda a, b: a | b, [F.lit(s) & (c == far) for s, c in limits], F.lit(False))
    x = [turned(F.col(c).cast(vtype)) for c in bound_cols]
    x_all = reduce(lambda a, b: F.greatest(a, b), x)
    valid = reduce(lambda a, b: a & b, [_usable(F.col(c)) for c in [*bound_cols, *(c for _, c in key_bounds)]])

    row = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    P = probes.select(*[F.col(a).alias(g) for (a, _), g in zip(eq, gcols)], far.alias("_tt_k"), F.when(after, 2).otherwise(0).alias("_tt_tag"),
                      F.col(probe_id).cast("bigint").alias("_tt_tie"), F.lit(None).cast("bigint").alias("_tt_ci"), F.lit(None).cast(vtype).alias("_tt_v"),
                      F.when(valid, x_all).alias("_tt_x"), row.alias("_tt_row"))
    cands = cands.where(_usable(F.col(cand_key)) & _usable(F.col(column)))
    for _, b in eq:
        cands = cands.where(F.col(b).isNotNull())
    C = cands.select(*[F.col(b).alias(g) for (_, b), g in zip(eq, gcols)], k.alias("_tt_k"), F.lit(1).alias("_tt_tag"), F.col(cand_idx).cast("bigint").alias("_tt_tie"),
                     F.col(cand_idx).cast("bigint").alias("_tt_ci"), turned(F.col(column).cast(vtype)).alias("_tt_v"), F.lit(None).cast(vtype).alias("_tt_x"),
                     F.lit(None).cast(P.schema["_tt_row"].dataType).alias("_tt_row"))
    rows = P.unionByName(C) if key_bounds else C
    cut = ["_tt_k", "_tt_tag", "_tt_tie"]
    bounds = _row_blocks(rows.select(*cut), cut, block_rows)
    rows = rows.withColumn("_tt_blk", (bucket_column(rows, bounds, cut) if bounds else F.lit(0)).cast("bigint"))
    done = _blocks(rows, gcols, strict)
    if bounds or not key_bounds:
        done = materialize(done)
    records = done.where("_tt_ci is not null").select(*gcols, "_tt_blk", "_tt_k", "_tt_v", "_tt_ci")
    turn_back = lambda c: c if direction == "next" else _mirrored(c, ktype)

    def by_value(asked: DataFrame, among: DataFrame, keys: list) -> DataFrame:
        """The record of the smallest value above x of each of ``asked`` (_tt_tie, _tt_x, _tt_row, keys)."""
        got = asof(asked, among, [(a, b) for a, b in keys], "_tt_x", "_tt_v", "_tt_ci", "next", strict, "_tt_hi", "_tt_tie", block_rows)
        got = got.withColumn("_tt_hi", F.when(F.col("_tt_x").isNotNull(), F.col("_tt_hi")))
        of = among.select(F.col("_tt_ci").alias("_tt_hi"), F.col("_tt_k").alias("_tt_hk"))
        return got.join(of, "_tt_hi", "left").select("_tt_row", "_tt_hi", "_tt_hk")

    pairs = [(g, g) for g in gcols]
    if not key_bounds:
        tops = records.groupBy(*gcols, "_tt_blk").agg(F.max("_tt_v").alias("_tt_top"))
        earlier = Window.partitionBy(*gcols).orderBy("_tt_blk").rowsBetween(Window.unboundedPreceding, -1)
        tops = tops.withColumn("_tt_before", F.max("_tt_top").over(earlier)).drop("_tt_top")
        records = records.join(tops, [*gcols, "_tt_blk"]).where("_tt_before is null or _tt_v > _tt_before").drop("_tt_before")
        hits = by_value(P.drop("_tt_k", "_tt_ci"), records, pairs)
    else:
        hits = done.where("_tt_ci is null")
        if bounds:
            lost = "_tt_hi is null and _tt_x is not null"
            tops = records.groupBy(*gcols, "_tt_blk").agg(F.max("_tt_v").alias("_tt_v"))
            asked = hits.where(lost).select(*gcols, F.col("_tt_blk").alias("_tt_own"), "_tt_tie", "_tt_x", "_tt_row")
            asked = _later_block(asked, tops, gcols, len(bounds) + 1, strict)
            far_hits = by_value(asked, records, [*pairs, ("_tt_in", "_tt_blk")])
            hits = hits.where(f"not ({lost})").select("_tt_row", "_tt_hi", "_tt_hk").unionByName(far_hits)
    return hits.select("_tt_row.*", F.col("_tt_hi").alias(out), turn_back(F.col("_tt_hk")).alias(out_key))


def _look(table: pa.Table, strict: list, whole: bool, types: pa.Schema, most: int):
    """Probes of whole units with the first of the next ``most`` candidates that passes all tests; see look_ahead."""
    is_cand = table.column("_tt_ci").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(table.column("_tt_pos").to_numpy() == 1)
    end = np.repeat(np.append(first[1:], len(is_cand)), np.diff(np.append(first, len(is_cand))))
    cand_at, probe_at = np.flatnonzero(is_cand), np.flatnonzero(~is_cand)
    values = [table.column(f"_tt_v{m}").combine_chunks().take(pa.array(cand_at)).to_numpy() for m in range(len(strict))]
    probes = table.take(pa.array(probe_at))
    asks = probes.column("_tt_asks").combine_chunks().to_numpy(zero_copy_only=False)
    bounds = [probes.column(f"_tt_x{m}").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for m in range(len(strict))]
    start, stop = np.searchsorted(cand_at, probe_at), np.searchsorted(cand_at, end[probe_at])
    hit, still = np.full(len(probe_at), -1), np.flatnonzero(asks)
    for step in range(most):
        still = still[start[still] + step < stop[still]]
        if not len(still):
            break
        at, ok = start[still] + step, np.ones(len(still), bool)
        for m, s in enumerate(strict):
            ok &= values[m][at] > bounds[m][still] if s else values[m][at] >= bounds[m][still]
        hit[still[ok]] = at[ok]
        still = still[~ok]
    found = hit >= 0
    left = asks & ~found & ~((start + most >= stop) & whole)
    rows = pa.array(np.where(found, cand_at[hit] if len(cand_at) else 0, 0), mask=~found)
    out = probes.append_column("_tt_hi", table.column("_tt_ci").combine_chunks().take(rows)).append_column("_tt_hk", table.column("_tt_k").combine_chunks().take(rows))
    return out.append_column("_tt_left", pa.array(left)).select(types.names).to_batches(max_chunksize=CHUNK_ROWS)


def look_ahead(probes: DataFrame, cands: DataFrame, eq: list, key_bounds: list, tests: list, cand_key: str, cand_idx: str,
               direction: str, out: str, probe_id: str, out_key: str, block_rows: int | None = None) -> DataFrame:
    """:func:`range_successor` for any number of ``tests`` (candidate column, op, probe column) among the next LOOK
    candidates of a probe's block: adds ``out``, ``out_key`` and _tt_left, whether the probe is still open."""
    block_rows = min(block_rows or conf_int(probes.sparkSession, "tracetide.block.rows"), MOST_ROWS)
    gcols = [f"_tt_g{i}" for i in range(len(eq))]
    both = lambda kinds: "bigint" if set(kinds) == {"bigint"} else "double"
    ktype = both(_key_type(probes, c, cands, cand_key) for _, c in key_bounds)
    turned = lambda c: c if direction == "next" else _mirrored(c, ktype)
    limits = [(o in ("<", ">"), turned(F.col(c).cast(ktype))) for o, c in key_bounds]
    far = reduce(lambda a, b: F.greatest(a, b), [c for _, c in limits], F.lit(None).cast(ktype))
    after = reduce(lambda a, b: a | b, [F.lit(s) & (c == far) for s, c in limits], F.lit(False))
    asks = reduce(lambda a, b: a & b, [_usable(F.col(c)) for c in [*(x for _, _, x in tests), *(c for _, c in key_bounds)]])
    for c in [cand_key, *(c for c, _, _ in tests)]:
        cands = cands.where(_usable(F.col(c)))
    for _, b in eq:
        cands = cands.where(F.col(b).isNotNull())
    values, limit = [], []  # each test as: the value is above the limit
    for m, (column, op, x) in enumerate(tests):
        kind = _key_type(probes, x, cands, column)
        up = (lambda c: c) if op in (">", ">=") else (lambda c, kind=kind: _mirrored(c, kind))
        values.append((up(F.col(column).cast(kind)).alias(f"_tt_v{m}"), F.lit(None).cast(kind).alias(f"_tt_v{m}")))
        limit.append((up(F.col(x).cast(kind)).alias(f"_tt_x{m}"), F.lit(None).cast(kind).alias(f"_tt_x{m}")))
    row = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    P = probes.select(*[F.col(a).alias(g) for (a, _), g in zip(eq, gcols)], far.alias("_tt_k"), F.when(after, 2).otherwise(0).alias("_tt_tag"), F.col(probe_id).cast("bigint").alias("_tt_tie"),
                      F.lit(None).cast("bigint").alias("_tt_ci"), *[v for _, v in values], *[x for x, _ in limit], asks.alias("_tt_asks"), row.alias("_tt_row"))
    C = cands.select(*[F.col(b).alias(g) for (_, b), g in zip(eq, gcols)], turned(F.col(cand_key).cast(ktype)).alias("_tt_k"), F.lit(1).alias("_tt_tag"), F.col(cand_idx).cast("bigint").alias("_tt_tie"),
                     F.col(cand_idx).cast("bigint").alias("_tt_ci"), *[v for v, _ in values], *[x for _, x in limit], F.lit(False).alias("_tt_asks"), F.lit(None).cast(P.schema["_tt_row"].dataType).alias("_tt_row"))
    rows, cut = P.unionByName(C), ["_tt_k", "_tt_tag", "_tt_tie"]
    bounds = _row_blocks(rows.select(*cut), cut, block_rows)
    rows = rows.withColumn("_tt_blk", (bucket_column(rows, bounds, cut) if bounds else F.lit(0)).cast("bigint"))
    unit = Window.partitionBy(*gcols, "_tt_blk").orderBy(*cut)
    schema = T.StructType([rows.schema["_tt_row"], T.StructField("_tt_hi", T.LongType()), T.StructField("_tt_hk", rows.schema["_tt_k"].dataType), T.StructField("_tt_left", T.BooleanType())])
    names = pa.schema([(f.name, pa.null()) for f in schema.fields])
    strict, most = [op in ("<", ">") for _, op, _ in tests], LOOK
    done = rows.withColumn("_tt_pos", F.row_number().over(unit)).mapInArrow(_by_units(lambda t: _look(t, strict, not bounds, names, most)), schema)
    return done.select("_tt_row.*", F.col("_tt_hi").alias(out), turned(F.col("_tt_hk")).alias(out_key), "_tt_left")


def _ranked(cands: DataFrame, probes: DataFrame, column: str, cols: list):
    """(``cands`` with _tt_rank, number of ranks, their table, least value): without a table the numbers themselves are ranks."""
    whole = all(isinstance(t, T.IntegralType) for t in (cands.schema[column].dataType, *(probes.schema[x].dataType for x in cols)))
    low, high = cands.agg(F.min(column), F.max(column)).first() if whole else (None, None)
    if low is not None and high - low < NARROW:
        return cands.withColumn("_tt_rank", F.col(column).cast("bigint") - low), high - low + 1, None, low
    cands = materialize(cands)
    ranked = with_position(cands.where(_usable(F.col(column))).select(F.col(column).alias("_tt_value")).distinct(), ["_tt_value"], out="_tt_rank")
    return cands.join(ranked, F.col(column) == F.col("_tt_value"), "left").drop("_tt_value"), ranked.count(), ranked, None


def _nodes_of_range(least, most, levels: int, bits: int):
    """The nodes (number * 64 + level) whose ranks are least .. most - 1: at each level what is left of the range, less whole parents."""
    f, parts = 1 << bits, []
    for h in range(levels):
        down, up = bits * h, bits * (h + 1)
        l, r = F.shiftright(least + ((1 << down) - 1), down), F.shiftright(most, down)
        next_l, next_r = F.shiftright(least + ((1 << up) - 1), up), F.shiftright(most, up)
        run = lambda a, b: F.sequence(a * 64 + h, (b - 1) * 64 + h, F.lit(64).cast("bigint"))  # noqa: B023, E731
        parts += [F.when((next_l >= next_r) & (l < r), run(l, r)).when((next_l < next_r) & (l < next_l * f), run(l, next_l * f)),
                  F.when((next_l < next_r) & (next_r * f < r), run(next_r * f, r))]
    return F.flatten(F.array_compact(F.array(*parts)))


def tree_keys(probes: DataFrame, cands: DataFrame, column: str, bounds: list, probe_id: str, node: str, bits: int = TREE_BITS) -> tuple[DataFrame, DataFrame]:
    """``bounds`` (op, probe column) of a candidate column as an equality of the new column ``node`` of both sides.

    A candidate is repeated for each level of a tree over the ranks of its
    values, a probe for each node that makes up its range of ranks; one of no range stays
    once, under no node.  A node has ``1 << bits`` children: more of them make fewer copies of candidates, and more of probes.
    """
    some, n, ranked, low = _ranked(cands.where(_usable(F.col(column))), probes, column, [x for _, x in bounds])
    limits = {"from": [], "to": []}  # a probe's ranks are from .. to - 1
    if ranked is None:
        for op, x in bounds:
            edge = F.col(x).cast("bigint") - low + int(op in (">", "<="))
            limits["from" if op in (">", ">=") else "to"].append(F.when(F.col(x).isNull(), n if op in (">", ">=") else 0).otherwise(edge))
    else:
        for m, (op, x) in enumerate(bounds):
            probes = probes.withColumn("_tt_bound", F.when(_usable(F.col(x)), F.col(x)))
            side = "next" if op in (">", ">=") else "prev"
            probes = asof(probes, ranked, [], "_tt_bound", "_tt_value", "_tt_rank", side, op in ("<", ">"), f"_tt_edge{m}", probe_id)
            edge = F.when(F.col("_tt_bound").isNotNull(), F.col(f"_tt_edge{m}") + int(side == "prev"))
            probes = probes.withColumn(f"_tt_edge{m}", F.coalesce(edge, F.lit(n if side == "next" else 0).cast("bigint"))).drop("_tt_bound")
            limits["from" if side == "next" else "to"].append(F.col(f"_tt_edge{m}"))
    levels = max(1, -(-n.bit_length() // bits))  # the top one has fewer nodes than children
    some = some.withColumn(node, F.explode(F.array(*[F.shiftright("_tt_rank", bits * h) * 64 + h for h in range(levels)]))).drop("_tt_rank")
    least = reduce(lambda a, b: F.greatest(a, b), limits["from"], F.lit(0).cast("bigint"))
    most = reduce(lambda a, b: F.least(a, b), limits["to"], F.lit(n).cast("bigint"))
    probes = probes.withColumn("_tt_from", least).withColumn("_tt_to", most)
    probes = probes.withColumn(node, _nodes_of_range(F.col("_tt_from"), F.col("_tt_to"), levels, bits))
    probes = probes.withColumn(node, F.explode(F.when(F.size(node) == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(F.col(node))))
    return probes.drop("_tt_from", "_tt_to", *[f"_tt_edge{m}" for m in range(len(bounds))]), some


def differ_keys(probes: DataFrame, cands: DataFrame, column: str, tests: list, probe_id: str, node: str) -> tuple[DataFrame, DataFrame]:
    """One ``("!=", probe column)`` of a candidate column as an equality of the new column ``node`` of both sides.

    In a binary tree over the ranks a value differs from another by exactly one sibling on the
    other's way to the root: a candidate is repeated for its node of each level, a probe for the siblings.
    NULL and NaN differ from everything: such candidates have a rank of their own, such probes one that no candidate has.
    """
    (_, x), = tests
    cands, n, ranked, low = _ranked(cands, probes, column, [x])
    if ranked is None:
        own = F.col(x).cast("bigint") - low
        probes = probes.withColumn("_tt_rank", F.when((own >= 0) & (own < n), own))
    else:
        probes = probes.join(ranked, F.col(x) == F.col("_tt_value"), "left").drop("_tt_value")
    levels = (n + 1).bit_length()
    rank = F.coalesce("_tt_rank", F.lit(n).cast("bigint"))
    cands = cands.withColumn(node, F.explode(F.array(*[F.shiftright(rank, h) * 64 + h for h in range(levels)]))).drop("_tt_rank")
    rank = F.coalesce("_tt_rank", F.lit(n + 1).cast("bigint"))
    siblings = [F.shiftright(rank, h).bitwiseXOR(F.lit(1).cast("bigint")) * 64 + h for h in range(levels)]
    return probes.withColumn(node, F.explode(F.array(*siblings))).drop("_tt_rank"), cands
