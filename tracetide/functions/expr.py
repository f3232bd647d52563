"""Spec expressions compiled to Spark ``Column`` objects.

Two input forms exist:

* *query strings* (filter steps), pandas ``DataFrame.query`` syntax where
  ``&`` / ``|`` bind looser than comparisons.  They are tokenised, ``&``/``|``
  rewritten to ``and``/``or`` and parsed with Python's ``ast``;
* *step lists* such as ``["+", ["-", "x1", "x0"], 1]``.

Every expression is carried as a :class:`TCol` (column + kind) so that the
float-only guards are emitted where needed: NaN never compares true, ``!=``
is true for NaN/NULL, and division by zero yields +-inf/NaN instead of the
ANSI error.
"""

from __future__ import annotations

import ast
import io
import operator
import tokenize
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StagedOperator(Exception):
    """Raised for order-dependent ops (rolling, argsort) inside a pure compile."""


@dataclass(frozen=True)
class TCol:
    col: Column
    kind: str  # "int" | "float" | "bool" | "str"
    sql_type: str | None = None  # exact Spark type when known (skips no-op casts)


def cast_to(t: "TCol", sql_type: str) -> Column:
    return t.col if t.sql_type == sql_type else t.col.cast(sql_type)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.StringType):
        return "str"
    return "int"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def env_of(df: DataFrame) -> dict:
    return {f.name: TCol(quoted(f.name), kind_of(f.dataType), f.dataType.simpleString())
            for f in df.schema.fields}


def literal(value) -> TCol:
    if isinstance(value, bool):
        return TCol(F.lit(value), "bool")
    if isinstance(value, int):
        return TCol(F.lit(value).cast("bigint"), "int", "bigint")
    if isinstance(value, float):
        return TCol(F.lit(value), "float", "double")
    if isinstance(value, str):
        return TCol(F.lit(value), "str")
    raise TypeError(f"cannot use {value!r} as a literal")


# --------------------------------------------------------------------------
# scalar building blocks (shared by query strings and step lists)

_CMP = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt,
    "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}


def compare(op: str, a: TCol, b: TCol) -> TCol:
    raw = _CMP[op](a.col, b.col)
    floats = [x.col for x in (a, b) if x.kind == "float"]
    if op == "!=":
        out = F.coalesce(raw, F.lit(True))
        for c in floats:
            out = out | F.isnan(c)
    else:
        out = F.coalesce(raw, F.lit(False))
        for c in floats:
            out = out & ~F.isnan(c)
    return TCol(out, "bool")


def _num_kind(*xs: TCol) -> str:
    return "float" if any(x.kind == "float" for x in xs) else "int"


def _arith_type(a: TCol, b: TCol) -> str | None:
    types = {a.sql_type, b.sql_type}
    if types <= {"bigint", "double"} and None not in types:
        return "double" if "double" in types else "bigint"
    return None


def add(a: TCol, b: TCol) -> TCol:
    return TCol(a.col + b.col, _num_kind(a, b), _arith_type(a, b))


def sub(a: TCol, b: TCol) -> TCol:
    return TCol(a.col - b.col, _num_kind(a, b), _arith_type(a, b))


def mul(a: TCol, b: TCol) -> TCol:
    return TCol(a.col * b.col, _num_kind(a, b))


def safe_divide(a: Column, b: Column) -> Column:
    """Float division with IEEE results: x/0 -> +-inf, 0/0 and NaN/0 -> NaN."""
    a = a.cast("double")
    b = b.cast("double")
    by_zero = (F.when(F.isnan(a), F.lit(float("nan")))
                .when(a > 0, F.lit(float("inf")))
                .when(a < 0, F.lit(float("-inf")))
                .otherwise(F.lit(float("nan"))))
    return F.when(b == 0, by_zero).otherwise(a / b)


def div(a: TCol, b: TCol) -> TCol:
    return TCol(safe_divide(a.col, b.col), "float", "double")


# --------------------------------------------------------------------------
# query strings

def parse_query(text: str) -> ast.expr:
    """Parse a pandas-style query string into a Python expression AST."""
    if not isinstance(text, str):
        raise TypeError(f"query {text!r} is not a string")
    toks = []
    for tok in tokenize.generate_tokens(io.StringIO(text.strip()).readline):
        if tok.type == tokenize.OP and tok.string == "&":
            toks.append((tokenize.NAME, "and"))
        elif tok.type == tokenize.OP and tok.string == "|":
            toks.append((tokenize.NAME, "or"))
        else:
            toks.append((tok.type, tok.string))
    source = tokenize.untokenize(toks)
    return ast.parse(source.strip(), mode="eval").body


def decimal_exact(value: Column) -> Column:
    """True where a double is a decimal of at most 10 places below 1e15, so that
    decimal(38,10) sums of it are exact; NULL stays NULL."""
    return ((F.abs(value) < 1e15) & (value.try_cast("decimal(38,10)").cast("double") == value))


def modulo(a: TCol, b: TCol) -> Column:
    """EXP1 ``%``: the result has the divisor's sign; a zero divisor gives NULL
    for integers and NaN for floats (the row does not match, the job goes on)."""
    rest = a.col % F.when(b.col != 0, b.col)
    signed = F.when((rest != 0) & ((rest < 0) != (b.col < 0)), rest + b.col).otherwise(rest)
    if _num_kind(a, b) == "float":
        return F.when(b.col == 0, F.lit(float("nan"))).otherwise(signed)
    return signed


_BIN = {ast.Add: add, ast.Sub: sub, ast.Mult: mul, ast.Div: div}


def _compile_node(node: ast.AST, env: dict) -> TCol:
    if isinstance(node, ast.BoolOp):
        parts = [_as_bool(_compile_node(v, env)) for v in node.values]
        fn = operator.and_ if isinstance(node.op, ast.And) else operator.or_
        return TCol(reduce(fn, parts), "bool")
    if isinstance(node, ast.UnaryOp):
        inner = _compile_node(node.operand, env)
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return TCol(~_as_bool(inner), "bool")
        if isinstance(node.op, ast.USub):
            return TCol(-inner.col, inner.kind)
        return inner
    if isinstance(node, ast.Compare):
        left = _compile_node(node.left, env)
        parts = []
        for op, right_node in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                values = _literal_list(right_node)
                test = F.coalesce(left.col.isin(values), F.lit(False))
                parts.append(test if isinstance(op, ast.In) else ~test)
                continue
            right = _compile_node(right_node, env)
            sym = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=",
                   ast.Gt: ">", ast.GtE: ">="}[type(op)]
            parts.append(compare(sym, left, right).col)
            left = right
        return TCol(reduce(operator.and_, parts), "bool")
    if isinstance(node, ast.BinOp):
        a, b = _compile_node(node.left, env), _compile_node(node.right, env)
        if type(node.op) in _BIN:
            return _BIN[type(node.op)](a, b)
        if isinstance(node.op, ast.Mod):
            return TCol(modulo(a, b), _num_kind(a, b))
        if isinstance(node.op, ast.Pow):
            return TCol(F.pow(a.col, b.col), "float")
        if isinstance(node.op, ast.FloorDiv):
            return TCol(F.floor(safe_divide(a.col, b.col)), _num_kind(a, b))
        if isinstance(node.op, ast.BitAnd):
            return TCol(_as_bool(a) & _as_bool(b), "bool")
        if isinstance(node.op, ast.BitOr):
            return TCol(_as_bool(a) | _as_bool(b), "bool")
        raise ValueError(f"operator {type(node.op).__name__} not supported in a query")
    if isinstance(node, ast.Name):
        if node.id in env:
            return env[node.id]
        if node.id in ("True", "False"):
            return literal(node.id == "True")
        raise KeyError(f"unknown column {node.id!r} in query")
    if isinstance(node, ast.Constant):
        return literal(node.value)
    raise ValueError(f"unsupported query syntax: {ast.dump(node)}")


def _as_bool(t: TCol) -> Column:
    return t.col if t.kind == "bool" else (t.col != 0)


def _literal_list(node: ast.AST) -> list:
    if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
        return [ast.literal_eval(e) for e in node.elts]
    raise ValueError("'in' needs a literal list")


def compile_query(text: str, env: dict) -> Column:
    """EXP1: query string -> boolean Column (never NULL)."""
    return _as_bool(_compile_node(parse_query(text), env))


# --------------------------------------------------------------------------
# step lists

def is_staged(expr) -> bool:
    """True if the step expression contains an order-dependent operator."""
    if isinstance(expr, list) and expr:
        if expr[0] in ("rolling", "argsort"):
            return True
        return any(is_staged(e) for e in expr[1:])
    return False


# UDF4: extra step operators, name -> function(list of TCol) -> TCol
STEP_OPERATORS: dict = {}


def register_step_operator(name: str, fn) -> None:
    """Extend the step language with ``[name, arg, ...]``."""
    if name in ("+", "-", "/", "rolling", "argsort", "query", "="):
        raise ValueError(f"{name!r} is a built-in step")
    STEP_OPERATORS[name] = fn


def compile_step(expr, env: dict) -> TCol:
    """EXP3..EXP9: column reference, literal, n-ary + - / and nesting."""
    if isinstance(expr, bool):
        raise TypeError("booleans are not step expressions")
    if isinstance(expr, (int, float)):
        return literal(expr)
    if isinstance(expr, str):
        if expr not in env:
            raise KeyError(f"unknown column {expr!r}")
        return env[expr]
    if isinstance(expr, list) and expr:
        op, args = expr[0], expr[1:]
        if op in ("rolling", "argsort"):
            raise StagedOperator(op)
        if op in STEP_OPERATORS:
            return STEP_OPERATORS[op]([compile_step(a, env) for a in args])
        fold = {"+": add, "-": sub, "/": div}.get(op)
        if fold is None:
            raise ValueError(f"{op!r} is not a step operator")
        if not args:
            raise ValueError(f"{op!r} needs at least one argument")
        parts = [compile_step(a, env) for a in args]
        if len(parts) == 1:
            # one operand: returned as is (no negation, no reciprocal)
            return parts[0]
        return reduce(fold, parts)
    raise ValueError(f"cannot compile step expression {expr!r}")
