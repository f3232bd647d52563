"""Plan-shape checks: the properties that matter at scale, read from explain()."""

import pytest

from tests.conftest import SF_SMALL
from tracetide.plans.catalog import QUERIES as CATALOG

QUERIES = {name: query for name, (query, _) in CATALOG.items()}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + "\n" + \
        df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_enumeration(spark, name):
    """No query plans a cartesian product or a nested-loop join."""
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "CrossJoin"):
        assert bad not in text, f"{name}: {bad}"


def test_next_event_window_is_blocked(spark):
    text = plan_text(QUERIES["nxt_same_evt_cpu"](spark, SF_SMALL))
    # the window partitions by the key *and* the idx block, never by the key alone
    assert "_tt_blk" in text and "hashpartitioning(event" in text


def test_top_results_use_partial_group_limit(spark):
    from tracetide.plans import runs
    from tracetide.sources.runlogs import run_logs_from_events
    from tracetide.trace import load_events
    _, docs = run_logs_from_events(load_events(spark, SF_SMALL))
    text = plan_text(runs.nth_results(docs))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_stored_trace_pushdown_and_pruning(spark, tmp_path):
    from tracetide.operators.computed import with_computed
    from tracetide.trace import load_trace, read_trace
    load_trace(spark, SF_SMALL).write.parquet(str(tmp_path / "t"))
    t = read_trace(spark, str(tmp_path / "t"))
    df = with_computed(t.where("event = 13"), ["nxt_timestamp_of_same_evt_on_same_cpu"]) \
        .select("idx", "nxt_timestamp_of_same_evt_on_same_cpu")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event,13)" in text
    assert "arg1" not in text.split("ReadSchema")[1].split("\n")[0]


def test_spec_is_one_scan_fan_out(spark):
    """21 categories, one Generate: the trace is read a few times (main scan,
    carry, t0 subquery), not once per category."""
    df = QUERIES["rec_events_per_cpu"](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Generate") == 1
    assert text.count("FileScan parquet") <= 4
