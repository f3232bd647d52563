"""Hand-built frames with expected values written out (FIXTURES section 3),
run with tiny blocks so the carry paths are exercised."""

import math

import pytest
from pyspark.sql import functions as F

from tracetide.operators.blocks import next_in_group
from tracetide.operators.computed import with_computed
from tracetide.operators.search import block_to_wakeup, next_same_event_pattern, search
from tracetide.trace import TRACE_SCHEMA

EVENTS12 = [13, 0, 13, 4, 13, 2, 13, 4, 4, 2, 2, 1]


def blk_wkp_frame(spark):
    rows = []
    for i in range(24):
        rows.append((i, i, 0, i // 12, EVENTS12[i % 12], 0, 0))
    return spark.createDataFrame(rows, TRACE_SCHEMA)


def prv_frq_frame(spark):
    ev = [0, 10, 4, 2, 10, 1]
    rows = []
    for i in range(12):
        e = ev[i % 6]
        rows.append((i, i, i // 6, 0, e, 0, i if e == 10 else -1))
    return spark.createDataFrame(rows, TRACE_SCHEMA)


@pytest.mark.parametrize("block", [2, 5, 1 << 22])
def test_next_block_wakeup_of_same_pid(spark, block):
    df = with_computed(blk_wkp_frame(spark), ["nxt_blk_wkp_of_same_pid"], block_rows=block)
    got = {r["idx"]: r["nxt_blk_wkp_of_same_pid"] for r in df.collect()}
    expect = {i: i for i in range(24)}
    for off in (0, 12):
        for a, b in ((3, 5), (5, 7), (7, 8), (8, 9), (9, 10), (10, 10)):
            expect[a + off] = b + off
    assert got == expect


@pytest.mark.parametrize("block", [2, 4, 1 << 22])
def test_prv_frq_on_same_cpu(spark, block):
    df = with_computed(prv_frq_frame(spark), ["prv_frq_on_same_cpu"], block_rows=block)
    got = {r["idx"]: r["prv_frq_on_same_cpu"] for r in df.collect()}
    assert [got[i] for i in range(6)] == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert [got[i] for i in range(6, 12)] == [None, 7.0, 7.0, 7.0, 10.0, 10.0]


@pytest.mark.parametrize("block", [2, 7, 1 << 22])
def test_next_same_event_last_row_keeps_own_value(spark, block):
    df = with_computed(blk_wkp_frame(spark), ["nxt_timestamp_of_same_evt_on_same_pid"], block_rows=block)
    got = {r["idx"]: r["nxt_timestamp_of_same_evt_on_same_pid"] for r in df.collect()}
    # pid 0, event 13 rows at 0, 2, 4, 6 -> next 2, 4, 6, then itself
    assert [got[i] for i in (0, 2, 4, 6)] == [2, 4, 6, 6]
    assert got[11] == 11  # the only EXIT of pid 0
    assert [got[i] for i in (5, 9, 10)] == [9, 10, 10]


@pytest.mark.parametrize("block", [2, 1 << 22])
def test_block_to_wakeup(spark, block):
    got = sorted(tuple(r) for r in block_to_wakeup(blk_wkp_frame(spark), block_rows=block).collect())
    assert got == [(3, 5), (7, 9), (8, 9), (15, 17), (19, 21), (20, 21)]


def test_search_equals_next_event_column(spark):
    """SEA9: the search and the computed column agree on unique timestamps."""
    trace = blk_wkp_frame(spark)
    res = search(trace, next_same_event_pattern("pid"), block_rows=3)
    comp = with_computed(trace, ["nxt_timestamp_of_same_evt_on_same_pid"], block_rows=3)
    ts = {r["idx"]: r["timestamp"] for r in trace.collect()}
    by_search = {r["a"]: ts[r["b"]] for r in res.collect()}
    by_column = {r["idx"]: r["nxt_timestamp_of_same_evt_on_same_pid"] for r in comp.collect()}
    assert by_search == by_column


def test_search_ties_and_strictness(spark):
    # equal timestamps: strict '>' skips them; argmin ties go to the lowest idx
    rows = [(0, 10, 0, 0, 1, 0, 0), (1, 10, 0, 0, 1, 0, 0), (2, 20, 0, 0, 1, 0, 0),
            (3, 20, 0, 0, 1, 0, 0), (4, 30, 0, 0, 1, 0, 0)]
    trace = spark.createDataFrame(rows, TRACE_SCHEMA)
    res = {r["a"]: r["b"] for r in search(trace, next_same_event_pattern("cpu"), block_rows=2).collect()}
    assert res == {0: 2, 1: 2, 2: 4, 3: 4, 4: 4}
    prev = [{"name": "a", "constraint": []},
            {"name": "p", "constraint": ["argmax", "timestamp", ["<=", "timestamp", ["get", "timestamp", "a"]]]}]
    res = {r["a"]: r["p"] for r in search(trace, prev, block_rows=2).collect()}
    # largest timestamp <= own (itself included), ties -> lowest idx
    assert res == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_next_in_group_member_restriction(spark):
    rows = [(i, i * 10, 0, 0, e, 0, 0) for i, e in enumerate([4, 1, 2, 1, 4, 2])]
    df = next_in_group(spark.createDataFrame(rows, TRACE_SCHEMA), ["cpu"], {"n": "timestamp"},
                       block_rows=2, member=F.col("event").isin(2, 4))
    got = {r["idx"]: r["n"] for r in df.collect()}
    assert got == {0: 20, 1: 10, 2: 40, 3: 30, 4: 50, 5: 50}


@pytest.mark.parametrize("block", [2, 3, 5, 1 << 22])
def test_latest_exec_with_equal_times_across_blocks(spark, block):
    """as-of by time, ties included: equal timestamps straddle idx blocks."""
    import random
    from tracetide.operators.blocks import running_max_by_time
    rnd = random.Random(3)
    rows = [(i, i // 3, 0, rnd.randint(0, 2), rnd.choice([0, 0, 2, 4]), 0, 0) for i in range(240)]
    df = spark.createDataFrame(rows, TRACE_SCHEMA)
    latest = F.when(F.col("event") == 0, F.struct(F.col("timestamp").alias("t"), F.col("idx").alias("i")))
    got = {r["idx"]: (tuple(r["m"]) if r["m"] else None)
           for r in running_max_by_time(df, ["pid"], latest, "m", block_rows=block).collect()}
    for idx, ts, _, pid, _, _, _ in rows:
        cands = [(t, i) for i, t, _, p, e, _, _ in rows if p == pid and e == 0 and t <= ts]
        assert got[idx] == (max(cands) if cands else None), idx
