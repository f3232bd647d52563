"""DuckDB SQL text for the correctness oracle.

The driver registers the raw tables (``events`` ...) as views; every oracle
string rebuilds the trace from ``events`` as a CTE and then states the
operator in plain SQL (window functions, joins, UNION ALL).  It reads query
strings and column names with code of its own and never goes through the
Spark compile path; what it shares with the engine are the event codes, the
``$NAME`` substitution and the recipes' JSON.
"""

from __future__ import annotations

import ast
import re

from ..trace import EVENT_CODE_BY_TYPE, OTHER_EVENT_CODE
from ..vars import DEFAULT_VARS, substitute


def trace_cte(variant: str = "base", name: str = "trace") -> str:
    if variant == "base":
        cases = " ".join(f"WHEN '{t}' THEN {c}" for t, c in EVENT_CODE_BY_TYPE.items())
        event = f"CASE event_type {cases} ELSE {OTHER_EVENT_CODE} END"
    elif variant == "trace18":
        event = "(event_id * 31 + user_id) % 18"
    elif variant == "trace_lb":
        event = "(event_id * 31 + user_id) % 22"
    else:
        raise ValueError(variant)
    return (f"{name} AS (SELECT CAST(event_id AS BIGINT) AS idx, CAST(epoch_us(ts) AS BIGINT) AS timestamp, "
            f"CAST(user_id % 8 AS BIGINT) AS cpu, CAST(user_id AS BIGINT) AS pid, "
            f"CAST({event} AS INTEGER) AS event, "
            f"CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS arg0, "
            f"CAST(round(value * 10000) AS BIGINT) AS arg1 FROM events)")


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def parse_query(text: str) -> ast.AST:
    """A query string as an expression tree; ``&`` and ``|`` bind like ``and`` and ``or``."""
    words = text.replace("&", " and ").replace("|", " or ").replace("~", " not ")
    return ast.parse(words.strip(), mode="eval").body


def computed_sql(name: str, variables: dict) -> str:
    if name == "nxt_blk_wkp_of_same_pid":
        name = "nxt_timestamp_of_(BLOCK|WAKEUP)_on_same_pid"
    if m := re.fullmatch(r"nxt_(\w+)_of_same_evt_on_same_(\w+)", name):
        return f"lead({m[1]}, 1, {m[1]}) OVER (PARTITION BY event, {m[2]} ORDER BY idx)"
    if m := re.fullmatch(r"nxt_(\w+)_of_\((\w+)\|(\w+)\)_on_same_(\w+)", name):
        k, a, b, loc = m.groups()
        member = f"event IN ({int(variables[a])}, {int(variables[b])})"
        return (f"CASE WHEN {member} THEN lead({k}, 1, {k}) OVER (PARTITION BY {loc}, {member} "
                f"ORDER BY idx) ELSE {k} END")
    if name == "prv_frq_on_same_cpu":
        tick = int(variables["TICK"])
        return (f"last_value(CASE WHEN event = {tick} THEN CAST(arg1 AS DOUBLE) END IGNORE NULLS) "
                f"OVER (PARTITION BY cpu ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    if name == "addr":
        return "(CAST(arg0 AS BIGINT) << 32) | CAST(arg1 AS BIGINT)"
    raise ValueError(f"no SQL form for {name}")


def kind_of_name(name: str) -> str:
    return "float" if name == "prv_frq_on_same_cpu" else "int"


# ----------------------------------------------------------------- expressions

def _lit(v):
    if isinstance(v, bool):
        return ("TRUE" if v else "FALSE"), "bool"
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)", "int"
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)", "float"
    raise TypeError(v)


def _cmp(op, a, b):
    sym = {"==": "=", "!=": "<>"}.get(op, op)
    raw = f"(({a[0]}) {sym} ({b[0]}))"
    floats = [x[0] for x in (a, b) if x[1] == "float"]
    if op == "!=":
        out = f"COALESCE({raw}, TRUE)"
        for f in floats:
            out = f"({out} OR isnan({f}))"
    else:
        out = f"COALESCE({raw}, FALSE)"
        for f in floats:
            out = f"({out} AND NOT isnan({f}))"
    return out, "bool"


def _num(a, b):
    return "float" if "float" in (a[1], b[1]) else "int"


def div_sql(a: str, b: str) -> str:
    a, b = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return (f"(CASE WHEN {b} = 0 THEN (CASE WHEN isnan({a}) THEN CAST('nan' AS DOUBLE) "
            f"WHEN {a} > 0 THEN CAST('inf' AS DOUBLE) WHEN {a} < 0 THEN CAST('-inf' AS DOUBLE) "
            f"ELSE CAST('nan' AS DOUBLE) END) ELSE {a} / {b} END)")


def _node(n, env):
    if isinstance(n, ast.BoolOp):
        parts = [_node(v, env)[0] for v in n.values]
        j = " AND " if isinstance(n.op, ast.And) else " OR "
        return "(" + j.join(parts) + ")", "bool"
    if isinstance(n, ast.UnaryOp):
        x = _node(n.operand, env)
        if isinstance(n.op, (ast.Not, ast.Invert)):
            return f"(NOT {x[0]})", "bool"
        if isinstance(n.op, ast.USub):
            return f"(-{x[0]})", x[1]
        return x
    if isinstance(n, ast.Compare):
        left = _node(n.left, env)
        parts = []
        for op, rn in zip(n.ops, n.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                vals = ", ".join(_lit(ast.literal_eval(e))[0] for e in rn.elts)
                t = f"COALESCE({left[0]} IN ({vals}), FALSE)"
                parts.append(t if isinstance(op, ast.In) else f"(NOT {t})")
                continue
            right = _node(rn, env)
            sym = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=",
                   ast.Gt: ">", ast.GtE: ">="}[type(op)]
            parts.append(_cmp(sym, left, right)[0])
            left = right
        return "(" + " AND ".join(parts) + ")", "bool"
    if isinstance(n, ast.BinOp):
        a, b = _node(n.left, env), _node(n.right, env)
        if isinstance(n.op, ast.Div):
            return div_sql(a[0], b[0]), "float"
        sym = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}[type(n.op)]
        return f"({a[0]} {sym} {b[0]})", _num(a, b)
    if isinstance(n, ast.Name):
        return env[n.id]
    if isinstance(n, ast.Constant):
        return _lit(n.value)
    raise ValueError(ast.dump(n))


def query_sql(text: str, env: dict) -> str:
    return _node(parse_query(text), env)[0]


def step_sql(expr, env: dict):
    if isinstance(expr, (int, float)) and not isinstance(expr, bool):
        return _lit(expr)
    if isinstance(expr, str):
        return env[expr]
    op, args = expr[0], [step_sql(a, env) for a in expr[1:]]
    if len(args) == 1:
        return args[0]
    acc = args[0]
    for b in args[1:]:
        if op == "/":
            acc = (div_sql(acc[0], b[0]), "float")
        else:
            acc = (f"({acc[0]} {op} {b[0]})", _num(acc, b))
    return acc


# ----------------------------------------------------------------- specs

def _is_staged(e):
    return isinstance(e, list) and e and (e[0] in ("rolling", "argsort") or any(_is_staged(x) for x in e[1:]))


def spec_sql(spec: dict, variables: dict | None = None, variant: str = "base",
             round_floats: int | None = None, rolling_digits: int | None = None) -> str:
    variables = variables or DEFAULT_VARS
    spec = substitute(spec, variables)
    base_cols = ["idx", "timestamp", "cpu", "pid", "event", "arg0", "arg1"]
    comp = [c for c in spec["input"] if c not in base_cols]
    comp_sql = "".join(f", {computed_sql(c, variables)} AS {q(c)}" for c in comp)
    cols = base_cols + comp
    shift = [c for c in cols if "timestamp" in c or c == "nxt_blk_wkp_of_same_pid"]
    repl = ", ".join(f"{q(c)} - (SELECT arg_min(timestamp, idx) FROM trace) AS {q(c)}" for c in shift)
    head = (f"WITH {trace_cte(variant)}, t AS (SELECT *{comp_sql} FROM trace), "
            f"n AS (SELECT * REPLACE ({repl}) FROM t)")
    base_env = {c: (q(c), kind_of_name(c)) for c in cols}
    outputs = [o for o in spec["output"] if o != "c"]

    branches = []  # (sql, env)
    for ci, cat in enumerate(spec["c"]):
        for steps in cat["concatenate"]:
            if any(s[0] == "=" and _is_staged(s[2]) for s in steps):
                branches.append((ci,) + _staged_sql(steps, base_env, rolling_digits))
            else:
                env = dict(base_env)
                conds = []
                for s in steps:
                    if s[0] == "query":
                        conds.append(query_sql(s[1], env))
                    else:
                        env[s[1]] = step_sql(s[2], env)
                where = " AND ".join(conds) if conds else "TRUE"
                branches.append((ci, "n", where, env))
    kinds = {}
    for o in outputs:
        ks = {b[3][o][1] for b in branches}
        kinds[o] = "float" if "float" in ks else "int"
    typ = {"float": "DOUBLE", "int": "BIGINT"}
    selects = []
    for ci, src, where, env in branches:
        exprs = ", ".join(f"CAST({env[o][0]} AS {typ[kinds[o]]}) AS {q(o)}" for o in outputs)
        selects.append(f"SELECT {exprs}, CAST({ci} AS INTEGER) AS c FROM {src} WHERE {where}")
    checks = []
    for o in outputs:
        checks.append(f"{q(o)} IS NOT NULL")
        if kinds[o] == "float":
            checks.append(f"NOT isnan({q(o)})")
    outer = []
    for o in spec["output"]:
        if round_floats is not None and o != "c" and kinds[o] == "float":
            outer.append(f"round({q(o)}, {round_floats}) AS {q(o)}")
        else:
            outer.append(q(o))
    body = " UNION ALL ".join(selects)
    return f"{head} SELECT {', '.join(outer)} FROM ({body}) u WHERE {' AND '.join(checks)}"


def _staged_sql(steps, base_env, rolling_digits=None):
    cols = dict(base_env)
    cur = "(SELECT * FROM n)"
    i = 0
    k = 0
    while i < len(steps):
        s = steps[i]
        if s[0] == "query":
            cur = f"(SELECT * FROM {cur} s{k} WHERE {query_sql(s[1], cols)})"
            k += 1
            i += 1
            continue
        name, expr = s[1], s[2]
        nxt = steps[i + 1] if i + 1 < len(steps) else None
        if (isinstance(expr, list) and expr[:1] == ["argsort"] and nxt == ["=", name, ["argsort", name]]):
            e = f"(row_number() OVER (ORDER BY {cols[expr[1]][0]}, idx) - 1)"
            i += 2
            kind = "int"
        elif isinstance(expr, list) and expr[:1] == ["rolling"]:
            w, op, key = expr[1], expr[2], cols[expr[3]][0]
            frame = f"OVER (ORDER BY idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
            agg = {"sum": f"sum(CAST({key} AS DOUBLE))", "mean": f"avg(CAST({key} AS DOUBLE))",
                   "median": f"median(CAST({key} AS DOUBLE))"}[op]
            if rolling_digits is not None and op in ("sum", "mean"):
                div = 1 if op == "sum" else w
                scale = 10 ** rolling_digits
                exact = f"CAST(sum({key}) {frame} AS HUGEINT)"
                agg = f"CAST((2 * {scale} * {exact} + {div}) // {2 * div} AS DOUBLE) / {float(scale)}"
                e = f"(CASE WHEN count({key}) {frame} = {w} THEN {agg} END)"
            else:
                e = f"(CASE WHEN count({key}) {frame} = {w} THEN {agg} {frame} END)"
            i += 1
            kind = "float"
        elif _is_staged(expr):
            raise ValueError(f"no SQL form for nested {expr!r}")
        else:
            e, kind = step_sql(expr, cols)
            i += 1
        if name in cols and cols[name][0] == q(name):
            cur = f"(SELECT * REPLACE ({e} AS {q(name)}) FROM {cur} s{k})"
        else:
            cur = f"(SELECT *, {e} AS {q(name)} FROM {cur} s{k})"
        k += 1
        cols[name] = (q(name), kind)
    return cur + " z", "TRUE", cols
