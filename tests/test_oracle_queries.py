"""Every registered query against its DuckDB oracle at sf0.01, with default
and with tiny block / bucket sizes (so the carry and bucket paths run)."""

import pytest

from tests.conftest import SF_MID
from tests.helpers import assert_matches_oracle

import __spark_entry__ as entry
from tracetide.plans.catalog import QUERIES as CATALOG

QUERIES = {name: query for name, (query, _) in CATALOG.items()}
SQL = {name: sql for name, (_, sql) in CATALOG.items() if sql is not None}
NAMES = sorted(SQL)

# block-sensitive operators: rerun with tiny blocks
BLOCKED = [n for n in NAMES if n.startswith(("nxt_", "prv_frq", "comm", "position", "rolling",
                                              "argsort", "rank", "search", "asof", "rec_run_queue",
                                              "rec_freq_rolling", "rec_block_wakeup", "rec_user_jobs"))]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    assert_matches_oracle(QUERIES[name](spark, SF_MID), duck, SQL[name])


@pytest.mark.parametrize("name", BLOCKED)
def test_query_matches_oracle_tiny_blocks(spark, duck, tiny_blocks, name):
    assert_matches_oracle(QUERIES[name](spark, SF_MID), duck, SQL[name])


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["x0", "y0", "x1", "y1", "c", "arg0", "arg1", "delta"]


@pytest.mark.parametrize("name", ["trace_scan", "rec_run_queue", "comm"])
def test_independent_of_session_time_zone(spark, duck, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert_matches_oracle(QUERIES[name](spark, SF_MID), duck, SQL[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
