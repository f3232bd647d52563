"""Range successors and lookups of a different value, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracetide.operators import successor as S
from tracetide.operators.search import search

NAN = float("nan")
COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
           "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def holds(op, a, b):
    missing = a is None or b is None or a != a or b != b
    return op == "!=" if missing else COMPARE[op](a, b)


def brute(rows, red, tests):
    """{idx: idx of the hit, or its own}: tests are (op, column, probe column)."""
    out = {}
    for p in rows:
        hits = [r for r in rows if all(holds(op, r[c], p[x]) for op, c, x in tests)]
        sign = 1 if red == "argmin" else -1
        out[p["idx"]] = min(hits, key=lambda r: (sign * r["k"], r["idx"]))["idx"] if hits else p["idx"]
    return out


def pattern(red, tests):
    parts = [[op, c, ["get", x, "a"]] for op, c, x in tests]
    c = parts[0]
    for part in parts[1:]:
        c = ["&", c, part]
    return [{"name": "a", "constraint": []}, {"name": "b", "constraint": [red, "k", c]}]


def table(spark, n=160, seed=0, wide=False):
    rng = random.Random(seed)
    value = (lambda: rng.randrange(-10**15, 10**15)) if wide else (lambda: rng.randrange(-4, 5))
    rows = [{"idx": i, "k": rng.randrange(60), "g": rng.choice([1, 1, 1, 2, 3]), "v": rng.choice([None, value(), value(), value()]),
             "w": rng.choice([NAN, -0.0, 0.0, 1.5, 2.5, float("inf"), rng.random()]), "u": value()} for i in range(n)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "idx bigint, k bigint, g int, v bigint, w double, u bigint")
    return rows, df


CASES = [
    ("argmin", [("==", "g", "g"), (">", "k", "k"), (">", "v", "v")]),
    ("argmin", [("==", "g", "g"), (">=", "k", "k"), ("<=", "v", "u")]),
    ("argmax", [("<", "k", "k"), ("<", "w", "w")]),
    ("argmax", [("==", "g", "g"), ("<=", "k", "k"), (">=", "w", "w")]),
    ("argmin", [("==", "g", "g"), (">", "v", "v")]),
    ("argmax", [("==", "g", "g"), ("<", "v", "u"), ("<", "v", "v")]),
    ("argmin", [(">", "k", "k"), (">", "u", "v"), ("<=", "u", "u"), ("<", "w", "w")]),
    ("argmin", [("==", "g", "g"), (">", "k", "k"), ("!=", "v", "v")]),
    ("argmax", [("==", "g", "g"), ("<=", "k", "k"), ("!=", "w", "w")]),
    ("argmin", [("==", "g", "g"), ("!=", "w", "w")]),
    ("argmax", [("!=", "v", "v")]),
    ("argmin", [(">", "k", "k"), ("!=", "v", "v"), ("!=", "g", "g")]),
    ("argmax", [("<", "k", "k"), ("!=", "v", "v"), ("!=", "w", "w"), ("<=", "u", "v")]),
    ("argmin", [("==", "g", "g"), ("!=", "w", "w"), ("!=", "v", "v"), ("!=", "u", "v")]),
    ("argmin", [("==", "g", "g"), (">=", "k", "k"), ("!=", "v", "u"), (">", "w", "w"), ("<", "u", "u"), (">=", "u", "v")]),
]


@pytest.mark.parametrize("block", [None, 13])
@pytest.mark.parametrize("case", range(len(CASES)))
def test_search_against_loops(spark, case, block):
    red, tests = CASES[case]
    rows, df = table(spark, n=160 if case < 11 else 90, seed=case, wide=case % 2 == 1)
    got = {r.a: r.b for r in search(df.repartition(3), pattern(red, tests), block_rows=block).collect()}
    assert got == brute(rows, red, tests)


def test_hot_group_over_many_blocks(spark):
    """One group whose hits lie far away, so that the tree over the blocks is climbed and descended."""
    n = 700
    df = spark.range(n).select(F.col("id").alias("idx"), F.col("id").alias("k"), F.when(F.col("id") == n - 1, 9).otherwise(F.col("id") % 3).cast("bigint").alias("v"), F.lit(1).alias("g"))
    got = {r.a: r.b for r in search(df, pattern("argmin", [("==", "g", "g"), (">", "k", "k"), (">", "v", "v")]), block_rows=2).collect()}
    rows = [{"idx": i, "k": i, "v": 9 if i == n - 1 else i % 3, "g": 1} for i in range(n)]
    want = brute(rows, "argmin", [(">", "k", "k"), (">", "v", "v")])
    assert got == want and got[2] == n - 1


def test_empty_sides(spark):
    _, df = table(spark)
    for red, tests in CASES[:1] + CASES[4:5] + CASES[7:8]:
        p = pattern(red, tests)
        assert search(df.where("false"), p).count() == 0
        p[1]["constraint"][2] = ["&", ["==", "k", 10**6], p[1]["constraint"][2]]  # no candidate
        got = search(df, p)
        assert got.count() == 160 and got.where("a <> b").count() == 0


def test_first_reaching_is_a_linear_scan():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64, 100):
        v = rng.integers(-1, 9, n)
        start, least = rng.integers(0, n, 300), rng.integers(0, 10, 300)
        want = [next((i for i in range(s, n) if v[i] >= x), n) for s, x in zip(start, least, strict=True)]
        assert S.first_reaching(v, start, least).tolist() == want


def test_no_pairs_in_the_plan(spark):
    _, df = table(spark)
    for red, tests in CASES:
        text = search(df, pattern(red, tests), block_rows=40)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_differs_make_one_plan(spark):
    """Two ``!=`` beside a bound are one lookup: branches for each side of each ``!=`` multiplied the plan, and the driver's memory with it."""
    _, df = table(spark)
    text = search(df, pattern("argmax", CASES[12][1]))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window ") <= 2 and text.count("Union") <= 1


RANGES = [("argmin", [(">", "k", "k"), (">", "u", "v"), ("<=", "u", "u"), ("<", "w", "w")]),
          ("argmax", [("==", "g", "g"), ("<=", "k", "k"), (">=", "w", "w"), ("<", "v", "u"), (">", "v", "g")])]


@pytest.mark.parametrize("look, block, some", [(0, None, None), (2, 13, None), (3, None, 9), (0, 13, 9)])
@pytest.mark.parametrize("case", range(len(RANGES)))
def test_what_the_next_rows_leave_open_goes_by_trees(spark, monkeypatch, case, look, block, some):
    monkeypatch.setattr(S, "LOOK", look)
    red, tests = RANGES[case]
    rows, df = table(spark, n=220, seed=20 + case, wide=case == 0)
    p = pattern(red, tests)
    if some:  # few probes: nodes of 16 children
        p[0]["constraint"] = ["<", "idx", some]
    got = {r.a: r.b for r in search(df.repartition(3), p, block_rows=block).collect()}
    want = brute(rows, red, tests)
    assert got == {a: b for a, b in want.items() if not some or a < some}


def test_near_hits_need_no_trees(spark):
    """Every row's next one passes: no copies of the candidates for the nodes of a tree."""
    df = spark.range(500).selectExpr("id idx", "id k", "1 g", "id v", "cast(id as double) w", "id + 9 u")
    plan = search(df, pattern("argmin", [("==", "g", "g"), (">", "k", "k"), (">", "v", "v"), ("<=", "v", "u"), (">", "w", "w")]))
    assert "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.where("b = least(a + 1, 499)").count() == 500
