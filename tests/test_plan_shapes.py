"""Plans that must keep their shape: aggregates that hash, few scans, counts before pixels."""

import re

import pytest
from pyspark.sql import functions as F

from tracetide.operators import raster
from tracetide.operators.computed import with_comm
from tracetide.plans import runs
from tracetide.sources.runlogs import run_logs_from_events
from tracetide.trace import load_events, load_trace

from .conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_run_table_scans(spark):
    lines, docs = run_logs_from_events(load_events(spark, SF_SMALL))
    text = plan(runs.traces_summary(lines, docs))
    assert len(re.findall("FileScan parquet", text)) == 3
    first = plan(runs.first_pattern_matches(lines, runs.PERF_PATTERNS + runs.energy_patterns()))
    assert "SortAggregate" not in first and "HashAggregate" in first


def test_segments_are_counted_before_they_are_spread(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("x0"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"), F.lit(1).alias("c"))
    text = plan(raster.segment_raster(frame, (0, 10), (0, 10), 64, 32))
    assert text.index("Generate") < text.rindex("HashAggregate") and text.count("HashAggregate") >= 4
    got = raster.segment_raster(frame, (0, 10), (0, 10), 64, 32)
    assert got.agg(F.max("n")).first()[0] == 1000


def test_command_ids_do_not_sort_to_aggregate_the_trace(spark):
    text = plan(with_comm(load_trace(spark, SF_SMALL)))
    for line in text.splitlines():
        if "SortAggregate" in line:  # only over EXEC rows and block borders, never keyed by row
            assert "idx#" not in re.search(r"keys?=\[([^\]]*)\]", line)[1]


@pytest.mark.parametrize("kernel", ["same", "other"])
def test_only_runs_of_one_kernel_are_compared(spark, kernel):
    head = "runs/BENCH=phoronix/POWER={}/MONITORING=cpu-energy-meter/PHORONIX=b/{}/1.tar"
    a, b = head.format("powersave-y", "k1"), head.format("performance-n", "k1" if kernel == "same" else "k2")
    doc = '{"results":[{"test":"t","arguments":"a","units":"u","results":{"schedrecord":{"value":%s}}}]}'
    docs = spark.createDataFrame([(a, "phoronix.json", 0, doc % "2.0"), (b, "phoronix.json", 0, doc % "4.0")], "path string, member string, doc_no long, doc string")
    lines = spark.createDataFrame([], "path string, member string, line_no long, line string")
    out = runs.power_comparison(lines, docs).collect()
    assert [(r.perf_value_powersave, r.perf_value_performance) for r in out] == ([(2.0, 4.0)] if kernel == "same" else [])
