"""Category specs -> point / segment frames (EXP10-EXP15, SET1, SET2).

A spec is ``{"input": [...], "output": [...], "c": [{label, color,
hide_hovertool?, concatenate: [[step, ...], ...]}, ...]}`` with steps
``["query", text]`` and ``["=", column, expression]``.

Plan shape:

* pipelines made only of filters and row-wise assignments are compiled
  symbolically (assignments inlined, filters ANDed) and evaluated in **one
  scan**: ``explode(filter(array(when(cond_i, struct_i)...), not null))``;
* pipelines with ``rolling`` / ``argsort`` run step by step on their own
  branch and are appended with ``unionByName``;
* rows with NULL/NaN in any output column are dropped; ``c`` is the category
  index (labels may repeat).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import (cast_to, compile_query, compile_step, env_of, is_staged,
                              quoted)
from ..vars import DEFAULT_VARS, substitute
from . import order
from .computed import REGISTRY, with_computed

FIRST_ROW_EXTRA = ("nxt_blk_wkp_of_same_pid",)


class SpecError(ValueError):
    pass


def validate_spec(spec: dict) -> None:
    """Check the spec shape up front; errors name the failing category."""
    for key in ("input", "output", "c"):
        if key not in spec:
            raise SpecError(f"spec lacks {key!r}")
    if "c" not in spec["output"]:
        raise SpecError("spec output must contain 'c'")
    for i, cat in enumerate(spec["c"]):
        where = f"category {i} ({cat.get('label')!r})"
        if "concatenate" not in cat or not isinstance(cat["concatenate"], list):
            raise SpecError(f"{where}: missing 'concatenate'")
        for pipe in cat["concatenate"]:
            for step in pipe:
                if not isinstance(step, list) or not step:
                    raise SpecError(f"{where}: bad step {step!r}")
                if step[0] == "query":
                    if len(step) != 2 or not isinstance(step[1], str):
                        raise SpecError(f"{where}: query step needs one string")
                elif step[0] == "=":
                    if len(step) != 3 or not isinstance(step[1], str):
                        raise SpecError(f"{where}: '=' step needs a column name and a value")
                else:
                    raise SpecError(f"{where}: unknown step {step[0]!r}")


def normalise_time(df: DataFrame, mode: str = "first") -> DataFrame:
    """EXP13 / EXP14: subtract t0 from every ``*timestamp*`` column (and the
    BLOCK|WAKEUP next column).  ``first``: timestamp of the first row (by idx);
    ``min``: minimum timestamp.  t0 is a scalar subquery (one partial/final
    aggregate), not a join."""
    agg = F.min_by("timestamp", "idx") if mode == "first" else F.min("timestamp")
    t0 = df.select(agg).scalar()
    cols = [c for c in df.columns if "timestamp" in c or c in FIRST_ROW_EXTRA]
    return df.withColumns({c: quoted(c) - t0 for c in cols})


def _pure_pipeline(steps: list, env: dict):
    cond = None
    env = dict(env)
    for step in steps:
        if step[0] == "query":
            c = compile_query(step[1], env)
            cond = c if cond is None else (cond & c)
        else:
            env[step[1]] = compile_step(step[2], env)
    return (cond if cond is not None else F.lit(True)), env


def _staged_pipeline(df: DataFrame, steps: list, position_kw: dict,
                     rolling_digits: int | None = None, memo: dict | None = None,
                     group: str | None = None) -> DataFrame:
    cur = df
    position_kw = dict(position_kw, group=group)
    state = {"tmp": 0, "pos": False}
    memo = {} if memo is None else memo
    i = 0

    def fresh():
        name = f"_tt_s{state['tmp']}"
        state["tmp"] += 1
        return name

    def position():
        # positions depend only on the steps consumed so far: share them
        # between pipelines with the same leading steps
        nonlocal cur
        if not state["pos"]:
            key = json.dumps(steps[:i])
            if state["tmp"] == 0 and key in memo:
                cur = memo[key]
            else:
                cur = order.with_position(cur.drop("_tt_pos") if "_tt_pos" in cur.columns else cur,
                                          ["idx"], "_tt_pos", **position_kw)
                if state["tmp"] == 0:
                    memo[key] = cur
            state["pos"] = True
        return "_tt_pos"

    def ensure_column(e):
        nonlocal cur
        if isinstance(e, str):
            return e
        e = lift(e)
        col = fresh()
        cur = cur.withColumn(col, compile_step(e, env_of(cur)).col)
        return col

    def lift(e):
        nonlocal cur
        if isinstance(e, list) and e and e[0] == "argsort":
            col = fresh()
            cur = order.argsort(cur, ensure_column(e[1]), col, **position_kw)
            return col
        if isinstance(e, list) and e and e[0] == "rolling":
            if len(e) != 4:
                raise SpecError(f"rolling needs window, op and key: {e!r}")
            col = fresh()
            key = ensure_column(e[3])
            pos = position()
            cur = order.rolling(cur, e[1], e[2], key, col, digits=rolling_digits,
                                pos_col=pos, **position_kw)
            return col
        if isinstance(e, list) and e:
            return [e[0]] + [lift(a) for a in e[1:]]
        return e

    while i < len(steps):
        step = steps[i]
        if step[0] == "query":
            cur = cur.where(compile_query(step[1], env_of(cur)))
            state["pos"] = False
            i += 1
            continue
        name, expr = step[1], step[2]
        nxt = steps[i + 1] if i + 1 < len(steps) else None
        # argsort(argsort(x)) written as two assignments to the same column
        if (isinstance(expr, list) and expr[:1] == ["argsort"] and isinstance(expr[1], str)
                and nxt == ["=", name, ["argsort", name]]
                and env_of(cur)[expr[1]].kind != "float"):
            cur = order.rank(cur, expr[1], name, **position_kw)
            i += 2
            continue
        # consecutive rolling assignments with the same window and op: one pass
        group = []
        j = i
        while (j < len(steps) and steps[j][0] == "=" and isinstance(steps[j][2], list)
               and len(steps[j][2]) == 4 and steps[j][2][0] == "rolling"
               and isinstance(steps[j][2][3], str)
               and steps[j][2][1:3] == expr[1:3] if isinstance(expr, list) else False):
            group.append(steps[j])
            j += 1
        keys_used = {g[2][3] for g in group}
        if len(group) > 1 and not (keys_used & {g[1] for g in group}):
            pos = position()
            cur = order.rolling(cur, expr[1], expr[2], {g[1]: g[2][3] for g in group},
                                digits=rolling_digits, pos_col=pos, **position_kw)
            i = j
            continue
        lifted = lift(expr)
        cur = cur.withColumn(name, compile_step(lifted, env_of(cur)).col)
        i += 1
    return cur.drop("_tt_pos") if "_tt_pos" in cur.columns else cur


def _rolling_only(mid: list):
    """(op, window, ((name, key), ...)) if every step is name = rolling(w, op, key)."""
    specs = []
    for st in mid:
        e = st[2]
        if not (isinstance(e, list) and len(e) == 4 and e[0] == "rolling" and isinstance(e[3], str)):
            return None
        specs.append((e[2], e[1], st[1], e[3]))
    ops, ws = {x[0] for x in specs}, {x[1] for x in specs}
    names = [x[2] for x in specs]
    if len(ops) != 1 or len(ws) != 1 or len(set(names)) != len(names) or set(names) & {x[3] for x in specs}:
        return None
    return specs[0][0], specs[0][1], tuple((x[2], x[3]) for x in specs)


def _merge_rolling_groups(groups: dict) -> dict:
    """Rolling-only groups with the same prefix and op (different windows) -> one
    multi-window group: all windows come out of one prefix-sum pass."""
    buckets: dict = {}
    for key, members in groups.items():
        if key is None:
            continue
        ro = _rolling_only(members[0][2])
        pres = {json.dumps(m[1]) for m in members}
        if ro is None or len(pres) != 1:
            continue
        buckets.setdefault((pres.pop(), ro[0]), []).append((key, ro))
    out = dict(groups)
    for (pre, op), entries in buckets.items():
        if len(entries) < 2:
            continue
        windows = []
        members = []
        for key, ro in entries:
            windows.append((ro[1], ro[2]))
            members += out.pop(key)
        out[("rolling-many", pre, op, tuple(windows))] = members
    return out


def _fan_out(base: DataFrame, items: list, outputs: list, types: dict) -> DataFrame:
    """One scan for many pipelines: explode the indices of the matching
    pipelines (ints, not row structs), then compute each output once through a
    CASE on that index, with identical per-pipeline expressions merged."""
    hit = F.filter(F.array(*[F.when(cond, F.lit(j)) for j, (_, cond, _) in enumerate(items)]),
                   lambda x: x.isNotNull())
    rows = (base.where(reduce(lambda a, b: a | b, [cond for _, cond, _ in items]))
                .withColumn("_tt_k", F.explode(hit)))
    k = F.col("_tt_k")
    cols = []
    for pos, o in enumerate(outputs):
        variants: dict = {}
        for j, (_, _, exprs) in enumerate(items):
            e = cast_to(exprs[pos], types[o].simpleString())
            variants.setdefault(str(e), (e, []))[1].append(j)
        choices = list(variants.values())
        col = choices[-1][0]
        for e, js in reversed(choices[:-1]):
            col = F.when(k.isin(js), e).otherwise(col)
        cols.append(col.alias(o))
    cats = [ci for ci, _, _ in items]
    c = F.lit(cats[0]) if len(set(cats)) == 1 else F.element_at(F.lit(cats), k + 1)
    return rows.select(*cols, c.cast("int").alias("c"))


def _assigned(steps: list) -> set:
    return {st[1] for st in steps if st[0] == "="}


def _batchable(pres: list, env: dict) -> bool:
    """Prefixes can share one tagged fan-out when they assign the same columns."""
    names = [_assigned(p) for p in pres]
    return all(n == names[0] for n in names)


def _tag_prefixes(df: DataFrame, pres: list, env: dict) -> DataFrame:
    """One scan: every row once per matching prefix, tagged ``_tt_g`` = prefix number."""
    compiled = [_pure_pipeline(p, env) for p in pres]
    names = list(env) + sorted(_assigned(pres[0]) - set(env))
    kinds = {n: _unify([c[1][n].kind for c in compiled]) for n in names}
    types = {n: _spark_type(kinds[n]) for n in names}
    if "c" in names or "_tt_g" in names:
        raise SpecError("columns named 'c' or '_tt_g' cannot be carried through a tagged prefix")
    items = [(t, cond, [e[n] for n in names]) for t, (cond, e) in enumerate(compiled)]
    return _fan_out(df, items, names, types).withColumnRenamed("c", "_tt_g")


def _spark_type(kind: str) -> T.DataType:
    return {"float": T.DoubleType(), "int": T.LongType(), "bool": T.BooleanType(),
            "str": T.StringType()}[kind]


def _unify(kinds: list) -> str:
    kinds = set(kinds)
    if kinds <= {"int"}:
        return "int"
    if kinds <= {"int", "float", "bool"}:
        return "float" if "float" in kinds else ("bool" if kinds == {"bool"} else "int")
    if len(kinds) == 1:
        return kinds.pop()
    raise SpecError(f"output mixes incompatible kinds {kinds}")


def build_frame(trace: DataFrame, spec: dict, variables: dict | None = None,
                normalise: bool = True, position_kw: dict | None = None,
                rolling_digits: int | None = None, **computed_kw) -> DataFrame:
    """EXP15: compile and run a spec over a trace; returns the concatenated frame."""
    variables = variables or DEFAULT_VARS
    spec = substitute(spec, variables)
    validate_spec(spec)
    position_kw = position_kw or {}
    needed = [c for c in spec["input"] if c not in trace.columns]
    df = with_computed(trace, [c for c in needed if c in REGISTRY], variables, **computed_kw)
    missing = [c for c in spec["input"] if c not in df.columns]
    if missing:
        raise SpecError(f"inputs {missing} are neither stored nor computable")
    if normalise:
        df = normalise_time(df)
    outputs = [o for o in spec["output"] if o != "c"]

    # Pipelines with order-dependent steps (rolling / argsort) are grouped by
    # that staged part.  Their distinct leading filter/assign steps are fanned
    # out in one scan with a tag column, the staged part runs once per group
    # with the tag as partition (positions restart per tag), and the trailing
    # filter/assign steps of every pipeline fan out over the result.
    groups: dict = {}
    for ci, cat in enumerate(spec["c"]):
        for steps in cat["concatenate"]:
            staged_at = [k for k, st in enumerate(steps) if st[0] == "=" and is_staged(st[2])]
            if not staged_at:
                groups.setdefault(None, []).append((ci, [], [], steps))
                continue
            first, last = staged_at[0], staged_at[-1]
            pre, mid, suffix = steps[:first], steps[first:last + 1], steps[last + 1:]
            groups.setdefault(json.dumps(mid), []).append((ci, pre, mid, suffix))

    groups = _merge_rolling_groups(groups)
    base_env = env_of(df)
    compiled = []  # (base frame, [(ci, cond, output TCols)])
    memo: dict = {}
    for key, members in groups.items():
        if isinstance(key, tuple) and key[0] == "rolling-many":
            _, pre, op, windows = key
            base = _staged_pipeline(df, json.loads(pre), position_kw, rolling_digits, memo)
            targets = [(w, f"_tt_r{w}_{name}", k) for w, names in windows for name, k in names]
            pos = order.with_position(base, ["idx"], "_tt_pos", **position_kw)
            base = order.rolling_many(pos, op, targets, digits=rolling_digits, pos_col="_tt_pos",
                                      **position_kw).drop("_tt_pos")
            env0 = env_of(base)
            items = []
            for ci, _, mid, suffix in members:
                env = dict(env0)
                for st in mid:
                    env[st[1]] = env0[f"_tt_r{st[2][1]}_{st[1]}"]
                cond, env = _pure_pipeline(suffix, env)
                items.append((ci, cond, [env[o] for o in outputs]))
            compiled.append((base, items))
            continue
        if key is None:
            bases = [(df, None, members)]
        else:
            pres = list(dict.fromkeys(json.dumps(m[1]) for m in members))
            mid = members[0][2]
            if len(pres) > 1 and _batchable([json.loads(p) for p in pres], base_env):
                tagged = _tag_prefixes(df, [json.loads(p) for p in pres], base_env)
                staged_df = _staged_pipeline(tagged, mid, position_kw, rolling_digits, group="_tt_g")
                bases = [(staged_df, pres.index(json.dumps(m[1])), [m]) for m in members]
            else:
                shared: dict = {}
                for m in members:  # identical prefixes are computed once
                    k = json.dumps(m[1])
                    if k not in shared:
                        shared[k] = _staged_pipeline(df, m[1] + mid, position_kw, rolling_digits, memo)
                bases = [(shared[json.dumps(m[1])], None, [m]) for m in members]
        for base, tag, items_in in bases:
            env0 = env_of(base)
            items = []
            for ci, _, _, suffix in items_in:
                try:
                    cond, env = _pure_pipeline(suffix, env0)
                    if tag is not None:
                        cond = cond & (F.col("_tt_g") == tag)
                    items.append((ci, cond, [env[o] for o in outputs]))
                except KeyError as e:
                    raise SpecError(f"category {ci}: {e}") from e
            # pipelines over the same base frame share one fan-out
            for c in compiled:
                if c[0] is base:
                    c[1].extend(items)
                    break
            else:
                compiled.append((base, items))

    kinds = {o: _unify([cols[k].kind for _, items in compiled for _, _, cols in items])
             for k, o in enumerate(outputs)}
    types = {o: _spark_type(kinds[o]) for o in outputs}

    parts = [_fan_out(base, items, outputs, types) for base, items in compiled]
    if not parts:
        raise SpecError("spec has no pipelines")
    frame = reduce(lambda a, b: a.unionByName(b), parts)
    frame = frame.na.drop(how="any", subset=outputs + ["c"])
    return frame.select(*[quoted(o) for o in spec["output"]])


CATEGORY_SCHEMA = T.StructType([
    T.StructField("c", T.IntegerType(), False),
    T.StructField("label", T.StringType(), True),
    T.StructField("color", T.StringType(), True),
    T.StructField("hide_hovertool", T.BooleanType(), False),
])


def categories(spark: SparkSession, spec: dict) -> DataFrame:
    rows = [(i, c.get("label"), c.get("color"), bool(c.get("hide_hovertool", False)))
            for i, c in enumerate(spec["c"])]
    return spark.createDataFrame(rows, CATEGORY_SCHEMA)


def category_table(frame: DataFrame, spec: dict) -> DataFrame:
    """AGG2 + JOIN8: (c, label, color, hide_hovertool, n) incl. empty categories."""
    counts = frame.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    cats = categories(frame.sparkSession, spec)
    return (cats.join(counts, on="c", how="left")
                .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint")))
