"""Pattern search over a trace (SEA1-SEA8) and the BLOCK -> WAKEUP as-of join.

A pattern is an ordered list of nodes ``{"name", "constraint"}``.  The first
node (root) is a set constraint selecting rows; each later node is
``[]`` (bind the root's row) or ``["argmin"|"argmax", key, set]``: among the
rows satisfying ``set`` -- which may read values of rows bound to earlier
nodes through ``["get", column, node]`` -- the row with the smallest
(largest) key, ties to the lowest idx; no such row binds the root's row.

Set constraints are compiled into an as-of plan, never into pairs:

* conjuncts without ``get`` filter the candidate rows;
* ``column == get(column2, node)`` conjuncts become equality keys;
* ``key <op> get(column, node)`` bounds on the reduction key select the as-of
  direction (next / previous); of several bounds in one direction the
  farthest hit counts;
* comparisons of a ``get`` with a literal or another ``get`` say whether the
  probe can bind at all;
* ``|`` around a ``get``, and ``!=`` between the reduction key and a ``get``
  (which is ``<`` or ``>``), make branches; each branch is an as-of lookup, and
  the hit of the smallest (largest) key counts;
* one ``!=`` between another column and a ``get`` keeps, beside the nearest row, the
  nearest one of a different value (:func:`.asof.asof`, ``differ``); a second one
  becomes an equality key (:func:`.successor.differ_keys`);
* bounds on other columns than the key are range successors
  (:mod:`.successor`): one bound by trees of maxima in blocks of the key, each
  further one, and every one beside a ``!=``, by a tree over its ranks;
* ``[]`` inside a reduction means "rows matching the root".

What is no comparison of a ``get`` with a column, a literal or another ``get`` raises
:class:`UnsupportedPattern`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import materialize
from ..functions.expr import TCol, compare, env_of, literal, quoted
from .asof import asof, group_extreme
from .successor import FEW_BITS, TREE_BITS, differ_keys, look_ahead, range_successor, tree_keys


class UnsupportedPattern(ValueError):
    pass


COMPARE = ("==", "!=", "<", ">", "<=", ">=")
LOGICAL = ("&", "|")
FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}


def _has_get(c) -> bool:
    return isinstance(c, list) and c and (c[0] == "get" or any(_has_get(x) for x in c[1:]))


def compile_set(constraint, env: dict, nop: Column | None = None) -> Column:
    """SEA2-SEA4: get-free set constraint -> boolean Column."""
    if not isinstance(constraint, list):
        raise UnsupportedPattern(f"constraint {constraint!r} must be a list")
    if len(constraint) == 0:
        if nop is None:
            return F.lit(True)
        return nop
    op = constraint[0]
    if len(constraint) != 3 or op not in COMPARE + LOGICAL:
        raise UnsupportedPattern(f"bad set constraint {constraint!r}")
    a, b = constraint[1], constraint[2]

    def operand(x):
        if isinstance(x, list):
            return TCol(compile_set(x, env, nop), "bool")
        if isinstance(x, str):
            if x not in env:
                raise UnsupportedPattern(f"unknown column {x!r}")
            return env[x]
        return literal(x)

    if op in LOGICAL:
        ca, cb = operand(a).col, operand(b).col
        return (ca & cb) if op == "&" else (ca | cb)
    return compare(op, operand(a), operand(b)).col


def _gets(c) -> set:
    """All (node, column) pairs read through ``["get", column, node]``."""
    if isinstance(c, list) and len(c) == 3 and c[0] == "get":
        return {(c[2], c[1])}
    if isinstance(c, list):
        return set().union(*[_gets(x) for x in c]) if c else set()
    return set()


def _is_get(c) -> bool:
    return isinstance(c, list) and len(c) == 3 and c[0] == "get"


def _branches(c, key: str) -> list:
    """Lists of conjuncts, any of which may hold (disjunctions without ``get`` stay whole)."""
    if isinstance(c, list) and len(c) == 3:
        if c[0] == "&":
            return [x + y for x in _branches(c[1], key) for y in _branches(c[2], key)]
        if c[0] == "|" and _has_get(c):
            return _branches(c[1], key) + _branches(c[2], key)
        if c[0] == "!=" and ((c[1] == key and _is_get(c[2])) or (c[2] == key and _is_get(c[1]))):
            return [[["<", c[1], c[2]]], [[">", c[1], c[2]]]]
    return [[c]]


def _split_branch(parts: list, key: str, root_cond: Column, env: dict, names: set):
    """-> (candidate filter, [(cand col, (node, col))], [(op, (node, col))], [probe comparison], [(cand col, op, (node, col))])."""
    filters, eqs, bounds, probe_tests, others = [], [], [], [], []

    def ref(g):
        if g[2] not in names:
            raise UnsupportedPattern(f"get refers to unknown or later node {g[2]!r}")
        return (g[2], g[1])

    for part in parts:
        if isinstance(part, list) and len(part) == 0:
            filters.append(root_cond)
            continue
        if not _has_get(part):
            filters.append(compile_set(part, env, root_cond))
            continue
        if not (isinstance(part, list) and len(part) == 3 and part[0] in COMPARE):
            raise UnsupportedPattern(f"'get' allowed only in a comparison: {part!r}")
        op, a, b = part
        if _is_get(a) and not (isinstance(b, str) and b in env):
            # a get with a literal or a get: a matter of the probe alone
            if not _is_get(b) and isinstance(b, (list, str)):
                raise UnsupportedPattern(f"comparison must be get vs column, literal or get: {part!r}")
            probe_tests.append((op, ref(a), ref(b) if _is_get(b) else b))
            continue
        if _is_get(a) or (_is_get(b) and not isinstance(a, (list, str))):
            op, a, b = FLIP[op], b, a
            if _is_get(a):
                probe_tests.append((op, ref(a), b))
                continue
        if not (isinstance(a, str) and _is_get(b)):
            raise UnsupportedPattern(f"comparison must be column vs get: {part!r}")
        if op == "==":
            eqs.append((a, ref(b)))
        elif op in ("<", "<=", ">", ">=") and a == key:
            bounds.append((op, ref(b)))
        else:
            if a not in env:
                raise UnsupportedPattern(f"unknown column {a!r}")
            others.append((a, op, ref(b)))
    cond = reduce(lambda x, y: x & y, filters) if filters else F.lit(True)
    return cond, eqs, bounds, probe_tests, others


def search(trace: DataFrame, pattern: list, idx: str = "idx", block_rows: int | None = None) -> DataFrame:
    """SEA1: one row per root match, one bigint column per pattern node."""
    if not pattern:
        raise UnsupportedPattern("empty pattern")
    names = [n["name"] for n in pattern]
    for n in names:
        if n in trace.columns:
            raise UnsupportedPattern(f"node name {n!r} is also a column of the trace")
    env = env_of(trace)
    root = pattern[0]
    if _has_get(root["constraint"]):
        raise UnsupportedPattern("'get' is not allowed in the root constraint")
    root_cond = compile_set(root["constraint"], env)
    rname = root["name"]
    # values of the root row read by later nodes travel with the root match
    # (no lookup join for them)
    root_cols = sorted({col for n, col in _gets([p["constraint"] for p in pattern[1:]]) if n == rname})
    results = trace.where(root_cond).select(
        quoted(idx).alias(rname), *[quoted(c).alias(f"_tt_{rname}_{c}") for c in root_cols])
    bound = {rname}
    for node in pattern[1:]:
        name, c = node["name"], node["constraint"]
        if not isinstance(c, list):
            raise UnsupportedPattern(f"constraint of {name!r} must be a list")
        if len(c) == 0:
            results = results.withColumn(name, F.col(rname))
            bound.add(name)
            continue
        if len(c) != 3 or c[0] not in ("argmin", "argmax"):
            raise UnsupportedPattern(f"{c[0]!r} is not a reduction (argmin/argmax)")
        red, key, sc = c
        branches = [_split_branch(parts, key, root_cond, env, bound) for parts in _branches(sc, key)]
        # probe values: columns of the rows bound to earlier nodes
        refs = sorted({r for _, eqs, bounds, tests, others in branches
                       for r in [*(r for _, r in eqs), *(r for _, r in bounds), *(x for t in tests for x in t[1:] if isinstance(x, tuple)),
                                 *(r for _, _, r in others)]})
        probes = results
        for node_ref in sorted({n for n, _ in refs} - {rname}):
            cols = sorted({col for n, col in refs if n == node_ref})
            look = trace.select(quoted(idx).alias(f"_tt_at_{node_ref}"),
                                *[quoted(col).alias(f"_tt_{node_ref}_{col}") for col in cols])
            probes = probes.join(look, F.col(node_ref) == F.col(f"_tt_at_{node_ref}"), "left") \
                           .drop(f"_tt_at_{node_ref}")
        out, sign = "_tt_hit", 1 if red == "argmin" else -1
        best = F.struct((sign * F.col("_tt_k")).alias("k"), F.col("_tt_i").alias("i"))
        if len(branches) == 1:
            probes = _bind(trace, probes, env, branches[0], red, key, idx, rname, "_tt_i", "_tt_k", block_rows)
            probes = probes.withColumn(out, F.col("_tt_i"))
        else:  # each branch by itself; of a probe's hits the best one
            probes = materialize(probes)
            hits = [_bind(trace, probes, env, b, red, key, idx, rname, "_tt_i", "_tt_k", block_rows).where("_tt_i is not null").select(rname, best.alias("_tt_best"))
                    for b in branches]
            hits = reduce(DataFrame.unionByName, hits).groupBy(rname).agg(F.min("_tt_best")["i"].alias(out))
            probes = probes.join(hits, rname, "left")
        keep = [c for c in results.columns]
        results = probes.select(*[F.col(k) for k in keep],
                                F.coalesce(F.col(out), F.col(rname)).cast("bigint").alias(name))
        bound.add(name)
    return results.select(*[F.col(n).cast("bigint").alias(n) for n in names])


def _bind(trace: DataFrame, probes: DataFrame, env: dict, branch, red: str, key: str, idx: str, rname: str,
          out: str, out_key: str, block_rows: int | None) -> DataFrame:
    """Add the hit (``out``, ``out_key``) of one branch to the probes."""
    cond, eqs, bounds, tests, others = branch
    cands = trace.where(cond)
    eq_pairs = [(f"_tt_{n}_{col}", cand) for cand, (n, col) in eqs]
    want, far = ("next", F.greatest) if red == "argmin" else ("prev", F.least)
    near = [b for b in bounds if (b[0] in (">", ">=")) == (red == "argmin")]
    other = [b for b in bounds if b not in near]
    near = [(op, f"_tt_{n}_{col}") for op, (n, col) in near]
    differ = [(f"_tt_{n}_{col}", a) for a, op, (n, col) in others if op == "!="]
    beyond = [(a, op, f"_tt_{n}_{col}") for a, op, (n, col) in others if op != "!="]
    if beyond or len(differ) > 1:
        probes = _beyond(probes, cands, eq_pairs, near, beyond, differ, key, idx, red, out, rname, out_key, block_rows)
    else:
        probes = _nearest(probes, cands, eq_pairs, near, differ[0] if differ else None, key, idx, red, out, rname, out_key, block_rows)
    # the nearest row must also respect the bounds on the other side, and the probe its own tests
    ok = [compare(op, TCol(F.col(out_key), "int"), TCol(F.col(f"_tt_{n}_{col}"), "int")).col for op, (n, col) in other]
    for op, (n, col), b in tests:
        right = TCol(F.col(f"_tt_{b[0]}_{b[1]}"), env[b[1]].kind) if isinstance(b, tuple) else literal(b)
        ok.append(compare(op, TCol(F.col(f"_tt_{n}_{col}"), env[col].kind), right).col)
    for test in ok:
        probes = probes.withColumn(out, F.when(test, F.col(out)))
    return probes


def _nearest(probes: DataFrame, cands: DataFrame, eq_pairs: list, near: list, differ: tuple | None, key: str, idx: str, red: str,
             out: str, probe_id: str, out_key: str, block_rows: int | None) -> DataFrame:
    """Add the nearest candidate beyond all of ``near`` (op, probe column), without those the first or last of all."""
    if not near:
        return group_extreme(probes, cands, eq_pairs, key, idx, "min" if red == "argmin" else "max", out, out_key=out_key, differ=differ)
    want, far = ("next", F.greatest) if red == "argmin" else ("prev", F.least)
    # of several bounds, the hit that is farthest satisfies all
    for m, (op, x) in enumerate(near):
        probes = asof(probes, cands, eq_pairs, x, key, idx, want, strict=op in ("<", ">"),
                      out=f"{out}_{m}", probe_id=probe_id, block_rows=block_rows, out_key=f"{out_key}_{m}", differ=differ)
    sign = 1 if red == "argmin" else -1  # of equal keys an argmax takes the lowest id first
    each = [F.struct(F.col(f"{out_key}_{m}").alias("k"), (sign * F.col(f"{out}_{m}")).alias("i")) for m in range(len(near))]
    got = each[0] if len(each) == 1 else far(*each)
    every = reduce(lambda x, y: x & y, [F.col(f"{out}_{m}").isNotNull() for m in range(len(near))])
    probes = probes.withColumn(out, F.when(every, sign * got["i"])).withColumn(out_key, F.when(every, got["k"]))
    return probes.drop(*[f"{c}_{m}" for c in (out, out_key) for m in range(len(near))])


def _beyond(probes: DataFrame, cands: DataFrame, eq_pairs: list, near: list, beyond: list, differ: list, key: str, idx: str, red: str,
            out: str, rname: str, out_key: str, block_rows: int | None) -> DataFrame:
    """Add the nearest candidate for which all of ``beyond`` (column, op, probe column) hold, too, and which
    differs by all of ``differ`` (probe column, column)."""
    want = "next" if red == "argmin" else "prev"
    grouped: dict = {}
    for column, op, x in beyond:
        grouped.setdefault(column, {}).setdefault(op, []).append(x)
    if not differ:
        column = min(grouped, key=lambda c: len(grouped[c]))  # one bound is the successor's, the rest go by trees
        op, cols = grouped[column].popitem()
    elif len(differ) > 1:  # the scan tells the column of most values apart, the others go by trees
        many = cands.agg(*[F.approx_count_distinct(quoted(v)) for _, v in differ]).first()
        differ = [differ[m] for m in sorted(range(len(differ)), key=lambda m: -many[m])]
    rows, of_row = probes, rname
    trees = [(c, [(o, x) for o, xs in ops.items() for x in xs]) for c, ops in grouped.items() if ops] + [(c, [("!=", x)]) for x, c in differ[1:]]
    done, bits = None, TREE_BITS
    if trees and near and not differ:  # most probes need no tree
        seen = materialize(look_ahead(probes, cands, eq_pairs, near, beyond, key, idx, want, out, rname, out_key, block_rows))
        done, rows = seen.where("not _tt_left").drop("_tt_left"), seen.where("_tt_left").select(*[quoted(c) for c in probes.columns])
        if rows.isEmpty():
            return done
        bits = FEW_BITS if rows.count() * 16 < cands.count() else TREE_BITS
    for m, (c, tests) in enumerate(trees):
        if tests[0][0] == "!=":
            rows, cands = differ_keys(rows, cands, c, tests, of_row, f"_tt_node{m}")
        else:
            rows, cands = tree_keys(rows, cands, c, tests, of_row, f"_tt_node{m}", bits)
        eq_pairs = [*eq_pairs, (f"_tt_node{m}", f"_tt_node{m}")]
        rows, of_row = rows.withColumn("_tt_copy", F.xxhash64(of_row, f"_tt_node{m}")), "_tt_copy"
    if differ:
        got = _nearest(rows, cands, eq_pairs, near, differ[0], key, idx, red, out, of_row, out_key, block_rows)
    else:
        got = range_successor(rows, cands, eq_pairs, near, (column, op, cols), key, idx, want, out, of_row, out_key, block_rows)
    if of_row == rname:
        return got
    sign = 1 if want == "next" else -1
    best = F.when(F.col(out).isNotNull(), F.struct((sign * F.col(out_key)).alias("k"), F.col(out).alias("i")))
    got = got.groupBy(rname).agg(F.first(F.struct(*[quoted(c) for c in probes.columns if c != rname])).alias("_tt_row"), F.min(best).alias("_tt_best"))
    kept = [F.col(rname) if c == rname else F.col("_tt_row")[c].alias(c) for c in probes.columns]
    got = got.select(*kept, F.col("_tt_best")["i"].alias(out), (sign * F.col("_tt_best")["k"]).alias(out_key))
    return got if done is None else done.unionByName(got)


def next_same_event_pattern(loc: str = "cpu") -> list:
    """The next row of the same event on the same ``loc`` (strictly later)."""
    return [
        {"name": "a", "constraint": []},
        {"name": "b", "constraint": [
            "argmin", "timestamp",
            ["&", ["&", ["==", loc, ["get", loc, "a"]], ["==", "event", ["get", "event", "a"]]],
             [">", "timestamp", ["get", "timestamp", "a"]]]]},
    ]


def block_to_wakeup(trace: DataFrame, block: int = 4, wakeup: int = 2,
                    block_rows: int | None = None) -> DataFrame:
    """JOIN1 / AGG12: each BLOCK row with the first WAKEUP of the same pid at or
    after its timestamp (ties -> lowest idx); BLOCKs without one are dropped."""
    blocks = trace.where(F.col("event") == block).select(
        F.col("idx").alias("e0idx"), "pid", F.col("timestamp").alias("ts0"))
    wakes = trace.where(F.col("event") == wakeup).select("idx", "pid", "timestamp")
    joined = asof(blocks, wakes, [("pid", "pid")], "ts0", "timestamp", "idx", "next",
                  strict=False, out="e1idx", probe_id="e0idx", block_rows=block_rows)
    return joined.where(F.col("e1idx").isNotNull()).select("e0idx", "e1idx")
