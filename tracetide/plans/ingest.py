"""SNK5: raw per-CPU ring buffers -> enriched trace parquet + comm dictionary.

raw files -> merged, time-ordered trace with idx -> addr, comm,
nxt_timestamp_of_same_evt_on_same_cpu, nxt_blk_wkp_of_same_pid,
prv_frq_on_same_cpu -> parquet; the comm dictionary is written as JSON.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ..operators.computed import comm_dictionary, with_comm, with_computed
from ..sources.raw import read_raw_trace
from ..trace import with_addr
from ..vars import DEFAULT_VARS

INGEST_COLUMNS = ["nxt_timestamp_of_same_evt_on_same_cpu", "nxt_blk_wkp_of_same_pid", "prv_frq_on_same_cpu"]


def ingest_raw(spark: SparkSession, raw_dir: str, out_dir: str, variables: dict | None = None,
               **position_kw) -> str:
    variables = variables or DEFAULT_VARS
    trace = read_raw_trace(spark, raw_dir, **position_kw)
    # cut the lineage once: the ordered trace is reused by every derived column
    trace.write.mode("overwrite").parquet(os.path.join(out_dir, "base"))
    trace = spark.read.parquet(os.path.join(out_dir, "base"))
    dictionary = comm_dictionary(trace, variables)
    dictionary.write.mode("overwrite").json(os.path.join(out_dir, "comm"))
    enriched = with_comm(with_addr(trace), variables, spark.read.json(os.path.join(out_dir, "comm")))
    enriched = with_computed(enriched, INGEST_COLUMNS, variables)
    enriched.write.mode("overwrite").parquet(os.path.join(out_dir, "tracer"))
    return os.path.join(out_dir, "tracer")
