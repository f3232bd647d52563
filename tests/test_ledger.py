"""One test per semantics-ledger decision that is observable through the API."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracetide.functions.expr import compile_query, compile_step, env_of
from tracetide.operators import frame_ops as fo
from tracetide.operators import order
from tracetide.operators.computed import with_computed
from tracetide.operators.search import UnsupportedPattern, search
from tracetide.operators.spec import SpecError, build_frame, category_table, normalise_time
from tracetide.plans import runs
from tracetide.trace import TRACE_SCHEMA
from tracetide.vars import DEFAULT_VARS, parse_dictionary_text, substitute


def trace(spark, rows):
    return spark.createDataFrame(rows, TRACE_SCHEMA)


def test_q2_first_row_timestamp_not_min(spark):
    t = trace(spark, [(0, 50, 0, 0, 0, 0, 0), (1, 40, 0, 0, 0, 0, 0), (2, 60, 0, 0, 0, 0, 0)])
    got = sorted((r["idx"], r["timestamp"]) for r in normalise_time(t).collect())
    assert got == [(0, 0), (1, -10), (2, 10)]
    got = sorted((r["idx"], r["timestamp"]) for r in normalise_time(t, "min").collect())
    assert got == [(0, 10), (1, 0), (2, 20)]


def test_q4_fallback_on_invalid_or_empty_query(spark):
    f = spark.createDataFrame([(1.0, 2.0, 0), (3.0, 4.0, 1)], "x double, y double, c int")
    assert fo.apply_query(f, "x > 2").frame.count() == 1
    assert not fo.apply_query(f, "x > 100").applied
    assert fo.apply_query(f, "x > 100").frame.count() == 2
    assert fo.apply_query(f, "x >>> ").frame.count() == 2
    assert fo.apply_query(f, "nosuchcol > 1").frame.count() == 2
    assert fo.apply_query(f, "   ").frame.count() == 2
    assert fo.apply_query(f, "c == $TICK - 9", DEFAULT_VARS).frame.count() == 1


def test_q5_q7_unmatched_and_empty_constraints(spark):
    t = trace(spark, [(0, 1, 0, 0, 4, 0, 0), (1, 2, 0, 1, 2, 0, 0), (2, 3, 0, 0, 2, 0, 0)])
    pat = [{"name": "a", "constraint": ["==", "event", 4]},
           {"name": "b", "constraint": []},
           {"name": "w", "constraint": ["argmin", "timestamp",
                                        ["&", ["==", "pid", ["get", "pid", "a"]], ["==", "event", 9]]]}]
    assert [tuple(r) for r in search(t, pat).collect()] == [(0, 0, 0)]
    allrows = search(t, [{"name": "a", "constraint": []}])
    assert allrows.count() == 3


def test_q6_argmin_argmax_ties_lowest_idx(spark):
    t = trace(spark, [(0, 5, 0, 0, 1, 7, 0), (1, 5, 0, 0, 1, 3, 0), (2, 5, 0, 0, 1, 3, 0), (3, 5, 0, 0, 1, 7, 0)])
    for red, expect in (("argmin", 1), ("argmax", 0)):
        pat = [{"name": "a", "constraint": ["==", "idx", 0]},
               {"name": "b", "constraint": [red, "arg0", ["==", "cpu", ["get", "cpu", "a"]]]}]
        assert [tuple(r) for r in search(t, pat).collect()] == [(0, expect)]


def test_search_rejects_collisions_and_pair_shapes(spark):
    t = trace(spark, [(0, 1, 0, 0, 1, 0, 0)])
    with pytest.raises(UnsupportedPattern):
        search(t, [{"name": "cpu", "constraint": []}])
    with pytest.raises(UnsupportedPattern):
        search(t, [{"name": "a", "constraint": []},
                   {"name": "b", "constraint": ["argmin", "timestamp", ["==", ["<", "cpu", 1], ["get", "cpu", "a"]]]}])
    with pytest.raises(UnsupportedPattern):
        search(t, [{"name": "a", "constraint": []},
                   {"name": "b", "constraint": ["argmin", "timestamp", ["<", "no_column", ["get", "cpu", "a"]]]}])


def test_q8_segment_viewport_as_written_vs_overlap(spark):
    f = spark.createDataFrame([(0.0, 5.0, 5.0, 5.0, 0)], "x0 double, y0 double, x1 double, y1 double, c int")
    box = (4.0, 10.0, 0.0, 10.0)
    assert f.where(fo.segment_viewport(*box)).count() == 0
    assert f.where(fo.segment_viewport_overlap(*box)).count() == 1


def test_q12_rolling_incomplete_and_nan(spark):
    rows = [(i, float("nan") if i == 5 else float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "idx long, v double")
    got = {r["idx"]: r["r"] for r in order.rolling(df, 3, "sum", "v", "r", block_rows=4).collect()}
    assert got[0] is None and got[1] is None
    assert got[2] == 3.0 and got[4] == 9.0
    assert got[5] is None and got[6] is None and got[7] is None
    assert got[8] == 21.0
    med = {r["idx"]: r["r"] for r in order.rolling(df, 3, "median", "v", "r", block_rows=4).collect()}
    assert med[2] == 1.0 and med[9] == 8.0 and med[6] is None


def test_q13_argsort_nan_and_positions(spark):
    df = spark.createDataFrame([(0, 3.0), (1, float("nan")), (2, 1.0), (3, 2.0)], "idx long, k double")
    got = {r["idx"]: r["y"] for r in order.argsort(df, "k", "y").collect()}
    # non-NaN subarray (idx 0, 2, 3) = [3, 1, 2] -> argsort [1, 2, 0]
    assert got == {0: 1, 1: -1, 2: 2, 3: 0}
    rk = {r["idx"]: r["y"] for r in order.rank(df, "k", "y").collect()}
    assert rk == {0: 2, 1: -1, 2: 0, 3: 1}


def test_position_many_buckets_with_ties(spark):
    rows = [(i, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "idx long, k long")
    got = order.with_position(df, ["k", "idx"], "p", bucket_rows=37).collect()
    exp = {idx: p for p, (k, idx) in enumerate(sorted((k, i) for i, k in rows))}
    assert {r["idx"]: r["p"] for r in got} == exp


def test_q14_q15_q16_scalar_semantics(spark):
    df = spark.createDataFrame([(1.0, 0.0, float("nan")), (0.0, 0.0, 1.0), (-2.0, 0.0, 2.0)],
                               "a double, b double, n double")
    env = env_of(df)
    neg = compile_step(["-", "a"], env).col
    div = compile_step(["/", "a", "b"], env).col
    rows = df.select(neg.alias("neg"), div.alias("d"), compile_query("n == n", env).alias("eq"),
                     compile_query("n != n", env).alias("ne"), compile_query("n > 0", env).alias("gt")).collect()
    assert [r["neg"] for r in rows] == [1.0, 0.0, -2.0]
    assert rows[0]["d"] == math.inf and math.isnan(rows[1]["d"]) and rows[2]["d"] == -math.inf
    assert [r["eq"] for r in rows] == [False, True, True]
    assert [r["ne"] for r in rows] == [True, False, False]
    assert [r["gt"] for r in rows] == [False, True, True]
    with pytest.raises(ValueError):
        compile_step(["-"], env)


def test_query_precedence_and_chains(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (3, 3)], "a long, b long")
    env = env_of(df)
    q = compile_query("a == 1 | a == 3 & b > 4", env)  # & binds tighter than |
    assert sorted(r["a"] for r in df.where(q).collect()) == [1]
    assert sorted(r["a"] for r in df.where(compile_query("1 < a <= 3", env)).collect()) == [2, 3]
    assert sorted(r["a"] for r in df.where(compile_query("a in [1, 2] and not b == 1", env)).collect()) == [1]


SPEC = {
    "input": ["timestamp", "cpu", "event", "arg1"],
    "output": ["x", "y", "c"],
    "c": [
        {"label": "A", "color": "#ff0000", "concatenate": [[["query", "event == $TICK"], ["=", "x", "timestamp"],
                                                             ["=", "y", ["/", "arg1", "cpu"]]]]},
        {"label": "A", "color": "#00ff00", "concatenate": [[["query", "event == $EXEC"], ["=", "x", "timestamp"],
                                                             ["=", "y", "cpu"]],
                                                            [["query", "event == $TICK"], ["=", "x", "timestamp"],
                                                             ["=", "y", 1]]]},
        {"label": "none", "color": "#0000ff", "hide_hovertool": True,
         "concatenate": [[["query", "event == $FORK"], ["=", "x", "timestamp"], ["=", "y", "cpu"]]]},
    ],
}


def spec_trace(spark):
    return trace(spark, [(0, 100, 0, 0, 10, 0, 0), (1, 101, 1, 0, 10, 0, 5), (2, 102, 2, 0, 0, 0, 0),
                         (3, 103, 0, 0, 10, 0, 7)])


def test_q17_q18_q19_spec_frame(spark):
    frame = build_frame(spec_trace(spark), SPEC)
    got = sorted(tuple(r) for r in frame.collect())
    # cat 0: y = arg1 / cpu: 0/0 -> NaN (dropped), 5/1 = 5, 7/0 = inf (kept)
    assert (1.0, 5.0, 0) in got and (3.0, math.inf, 0) in got
    assert not any(r[2] == 0 and r[0] == 0.0 for r in got)
    # cat 1: union of two pipelines, labels repeat but c is the index
    assert sorted(r for r in got if r[2] == 1) == [(0.0, 1.0, 1), (1.0, 1.0, 1), (2.0, 2.0, 1), (3.0, 1.0, 1)]
    cats = {r["c"]: r["n"] for r in category_table(frame, SPEC).collect()}
    assert cats == {0: 2, 1: 4, 2: 0}
    legend = [r["c"] for r in fo.exclude_categories(frame, fo.hidden_categories(SPEC)).select("c").distinct().collect()]
    assert sorted(legend) == [0, 1]


def test_fan_out_equals_union_of_pipelines(spark):
    t = spec_trace(spark)
    frame = sorted(tuple(r) for r in build_frame(t, SPEC).collect())
    parts = []
    for i, cat in enumerate(SPEC["c"]):
        for pipe in cat["concatenate"]:
            one = {"input": SPEC["input"], "output": SPEC["output"],
                   "c": [{"label": "x", "color": "#000000", "concatenate": [pipe]}]}
            parts += [(r["x"], r["y"], i) for r in build_frame(t, one).collect()]
    assert frame == sorted(parts)


def test_q20_spec_validation_names_category(spark):
    bad = {"input": [], "output": ["x", "c"], "c": [{"label": "ok", "concatenate": [[["=", "x", 1]]]},
                                                    {"label": "broken", "concatenate": [[["filter", "x"]]]}]}
    with pytest.raises(SpecError, match="broken"):
        build_frame(spec_trace(spark), bad)


def test_q21_substitution():
    assert substitute({"k$X": ["$X", "$$X", 3]}, {"X": "7"}) == {"k$X": ["7", "$X", 3]}
    with pytest.raises(KeyError):
        substitute("$NOPE", {})


def test_q22_dictionary_stops_at_blank_line():
    assert parse_dictionary_text("1 A\n2 B\n\n3 C\n") == {"A": "1", "B": "2"}


def test_q23_unknown_columns_raise(spark):
    with pytest.raises(KeyError):
        with_computed(spec_trace(spark), ["nxt_nothing"])


def test_q26_q27_typed_defaults_and_totals(spark):
    df = spark.createDataFrame([("1.5", None), ("x", "a")], "v string, s string")
    got = df.select(runs.typed(F.col("v"), runs.FLOAT).alias("f"), runs.typed(F.col("s"), runs.STRING).alias("t")).collect()
    assert got[0]["f"] == 1.5 and math.isnan(got[1]["f"])
    assert got[0]["t"] == "(NULL)" and got[1]["t"] == "a"
    tot = spark.createDataFrame([(1.0, float("nan"))], "a double, b double").select((F.col("a") + F.col("b")).alias("t"))
    assert math.isnan(tot.first()["t"])


def test_stats_names_and_nan_skipping(spark):
    f = spark.createDataFrame([(1.0, 0), (float("nan"), 0), (3.0, 0)], "x double, c int")
    r = fo.category_stats(f).first()
    assert r["x.count"] == 2 and r["x.sum"] == 4.0 and r["x.mean"] == 2.0


def test_extension_points(spark):
    from tracetide.functions.expr import TCol, register_step_operator, STEP_OPERATORS
    from tracetide.operators.computed import register_computed, REGISTRY
    register_step_operator("double_it", lambda args: TCol(args[0].col * 2, args[0].kind))
    register_computed("ts_x10", ["timestamp"], lambda df, v: df.withColumn("ts_x10", F.col("timestamp") * 10))
    try:
        t = spec_trace(spark)
        got = with_computed(t, ["ts_x10"]).select("ts_x10").collect()
        assert sorted(r[0] for r in got) == [1000, 1010, 1020, 1030]
        env = env_of(t)
        assert t.select(compile_step(["double_it", "cpu"], env).col.alias("d")).agg(F.sum("d")).first()[0] == 6
        idx = spark.createDataFrame([("p1",), ("p2",)], "path string")
        table = (runs.RunTable(idx).add_column("fname", runs.STRING, lambda d: F.col("path"))
                 .add_column("n", runs.FLOAT, lambda d: F.length("fname"))
                 .add_column("bad", runs.FLOAT, lambda d: F.lit("x")))
        rows = table.build().collect()
        assert [r["n"] for r in rows] == [2.0, 2.0] and all(math.isnan(r["bad"]) for r in rows)
        seen = []
        f = spark.createDataFrame([(1.0,)], "x double")
        fo.apply_query(f, "x > 0", listeners=[seen.append])
        assert seen and seen[0].applied
    finally:
        STEP_OPERATORS.pop("double_it", None)
        REGISTRY.pop("ts_x10", None)


def test_grouped_positions_many_buckets(spark):
    import random
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0, 0, 0, 1, 2]), rnd.randint(0, 20)) for i in range(900)]
    df = spark.createDataFrame(rows, "idx long, g int, k long")
    got = {(r["g"], r["idx"]): r["p"] for r in
           order.with_position(df, ["k", "idx"], "p", bucket_rows=50, group="g").collect()}
    exp = {}
    for g in (0, 1, 2):
        members = sorted((k, i) for i, gg, k in rows if gg == g)
        exp.update({(g, i): p for p, (k, i) in enumerate(members)})
    assert got == exp
    rk = {(r["g"], r["idx"]): r["y"] for r in order.rank(df, "k", "y", group="g", bucket_rows=50).collect()}
    assert rk == exp
    roll = order.rolling(df, 5, "sum", "k", "s", group="g", bucket_rows=50, block_rows=20)
    got = {(r["g"], r["idx"]): r["s"] for r in roll.collect()}
    for g in (0, 1, 2):
        seq = [(i, k) for i, gg, k in sorted(rows) if gg == g]
        for j, (i, k) in enumerate(seq):
            want = float(sum(x for _, x in seq[j - 4:j + 1])) if j >= 4 else None
            assert got[(g, i)] == want


def test_position_many_bounds_uses_binary_search(spark):
    rows = [(i, (i * 7919) % 13) for i in range(5000)]
    df = spark.createDataFrame(rows, "idx long, k long")
    got = {r["idx"]: r["p"] for r in order.with_position(df, ["k", "idx"], "p", bucket_rows=50).collect()}
    exp = {i: p for p, (k, i) in enumerate(sorted((k, i) for i, k in rows))}
    assert got == exp
    one = {r["idx"]: r["p"] for r in order.with_position(df, ["idx"], "p", bucket_rows=40).collect()}
    assert one == {i: i for i in range(5000)}


def test_hover_sample_bounded_and_deterministic(spark):
    f = spark.range(20000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"),
                                  (F.col("id") % 3).cast("int").alias("c"))
    view = fo.point_viewport(0.0, 1e9, 0.0, 10.0)
    a = fo.hover_sample(f, view, [2], max_rows=1000)
    b = fo.hover_sample(f.repartition(5), view, [2], max_rows=1000)
    ra, rb = sorted(tuple(r) for r in a.collect()), sorted(tuple(r) for r in b.collect())
    assert ra == rb and 700 < len(ra) < 1300 and all(r[2] != 2 for r in ra)
    assert fo.hover_sample(f, view, [], max_rows=10 ** 6).count() == 20000
