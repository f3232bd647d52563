"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every query reads the driver tables (the trace is derived from ``events``)
and runs over the whole table.
"""

from __future__ import annotations

import os as _os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import frame_ops as _fo
from ..operators import order as _order
from ..operators import raster as _ra
from ..operators.computed import comm_dictionary, with_comm, with_computed
from ..operators.search import block_to_wakeup, next_same_event_pattern, search
from ..operators.spec import build_frame, category_table, normalise_time
from ..operators.spec import categories as _categories
from ..sources import archive as _archive
from ..sources import dictionary as _dictionary
from ..sources import frames as _frames
from ..sources import raw as _raw
from ..sources import raw_merge as _raw_merge
from ..sources import side_columns as _side
from ..sources import sinks as _sinks
from ..sources import text as _text
from ..functions.scalar import extension as _extension
from ..sources import runlogs as _runlogs
from ..sources.runlogs import run_logs_from_events
from ..streaming.run_stream import run_table_stream_from_logs, scratch_dir, stream_run_archives
from ..trace import (EVENT_CODE_BY_TYPE, LB_EXTRA_VARS, OTHER_EVENT_CODE, load_events,
                     load_trace, with_addr)
from ..vars import DEFAULT_VARS, merge_vars, merge_vars_frames, vars_frame
from . import oracle
from . import runs as _runs
from .ingest import INGEST_COLUMNS, ingest_raw
from .recipes import RECIPES

# Test dictionary: defaults + the balancing pairs of the trace_lb fixture +
# names used by specs that the default dictionary lacks.
TEST_VARS = merge_vars(DEFAULT_VARS, LB_EXTRA_VARS, {
    "USER_EVT": "10",
    "WAIT_PID": "22",
    "DEBUG_EVT": "23",
    "UNBLOCK_PREPARE_IPA_BEG": "24",
    "UNBLOCK_PREPARE_IPA_END": "25",
})

QUERIES: dict = {}


def register(name: str, sql=None):
    def wrap(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return wrap


def round_floats(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round double columns (inexact aggregates) so both engines hash alike."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


# --------------------------------------------------------------------- recipes

RECIPE_VARIANT = {
    "events_per_cpu": "trace18", "freq": "trace18", "events_per_pid": "trace18",
    "freq_balancing": "trace_lb", "freq_balancing_fair": "trace_lb", "pull_back": "trace_lb",
    "idle_balancing": "trace_lb",
}
INEXACT = {"freq_rolling_mean"}


def recipe_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    trace = load_trace(spark, sf_dir, RECIPE_VARIANT.get(name, "base"))
    return build_frame(trace, RECIPES[name](), TEST_VARS,
                       rolling_digits=4 if name in INEXACT else None)


def _recipe_query(name):
    def fn(spark, sf_dir):
        return recipe_frame(spark, sf_dir, name)
    sql = oracle.spec_sql(RECIPES[name](), TEST_VARS, RECIPE_VARIANT.get(name, "base"),
                          rolling_digits=4 if name in INEXACT else None)
    return fn, sql


for _name in RECIPES:
    QUERIES[f"rec_{_name}"] = _recipe_query(_name)


def _recipe_categories(name):
    def fn(spark, sf_dir):
        return category_table(recipe_frame(spark, sf_dir, name), RECIPES[name]())
    return fn


# --------------------------------------------------------------------- trace & computed columns


TRACE_COLS = "idx, timestamp, cpu, pid, event, arg0, arg1"


def _with(variant="base", extra=""):
    return f"WITH {oracle.trace_cte(variant)}{extra} "


@register("trace_scan", _with() + "SELECT idx, timestamp, cpu, pid, event, arg0, arg1 FROM trace")
def q_trace_scan(spark, sf_dir):
    """SRC2 / EXP3: the trace mapped from events, pruned to the trace columns."""
    return load_trace(spark, sf_dir)


@register("trace_normalise_first", _with() + (
    "SELECT idx, timestamp - (SELECT arg_min(timestamp, idx) FROM trace) AS timestamp, cpu, pid, event "
    "FROM trace"))
def q_norm_first(spark, sf_dir):
    """EXP13: subtract the first row's timestamp."""
    return normalise_time(load_trace(spark, sf_dir).select("idx", "timestamp", "cpu", "pid", "event"))


@register("trace_normalise_min", _with() + (
    "SELECT idx, timestamp - (SELECT min(timestamp) FROM trace) AS timestamp FROM trace"))
def q_norm_min(spark, sf_dir):
    """EXP14: subtract the minimum timestamp."""
    t = load_trace(spark, sf_dir).select("idx", "timestamp")
    return normalise_time(t, mode="min")


@register("addr", _with() + "SELECT idx, (CAST(arg0 AS BIGINT) << 32) | CAST(arg1 AS BIGINT) AS addr FROM trace")
def q_addr(spark, sf_dir):
    """CMP5 / FN7."""
    return with_addr(load_trace(spark, sf_dir)).select("idx", "addr")


def _computed_query(names, variant="base", vars_=None):
    vars_ = vars_ or TEST_VARS

    def fn(spark, sf_dir):
        df = with_computed(load_trace(spark, sf_dir, variant), names, vars_)
        return df.select("idx", *[F.col(f"`{n}`") for n in names])
    cols = ", ".join(f"{oracle.computed_sql(n, vars_)} AS {oracle.q(n)}" for n in names)
    return fn, _with(variant) + f"SELECT idx, {cols} FROM trace"


_NXT = "nxt_{}_of_same_evt_on_same_{}"
QUERIES["nxt_same_evt_cpu"] = _computed_query([_NXT.format(k, "cpu") for k in ("timestamp", "arg0", "arg1")])
QUERIES["nxt_same_evt_pid"] = _computed_query([_NXT.format(k, "pid") for k in ("timestamp", "arg0", "arg1")])
QUERIES["nxt_block_wakeup"] = _computed_query(
    ["nxt_blk_wkp_of_same_pid"] + [f"nxt_{k}_of_(BLOCK|WAKEUP)_on_same_cpu" for k in ("timestamp", "arg0", "arg1")])
for _loc in ("cpu", "pid"):  # CMP2: all 30 columns
    QUERIES[f"nxt_pairs_{_loc}"] = _computed_query(
        [f"nxt_{k}_of_({a}|{b})_on_same_{_loc}" for k in ("timestamp", "arg0", "arg1")
         for a, b in (("BLOCK", "WAKEUP"), ("IDL_BLN_FAIR_BEG", "IDL_BLN_FAIR_END"), ("PER_BLN_FAIR_BEG", "PER_BLN_FAIR_END"),
                      ("IDL_BLN_IPA_BEG", "IDL_BLN_IPA_END"), ("PER_BLN_IPA_BEG", "PER_BLN_IPA_END"))], variant="trace_lb")
QUERIES["nxt_pairs_balancing"] = _computed_query(
    [f"nxt_timestamp_of_({a}|{b})_on_same_{loc}"
     for a, b in (("IDL_BLN_FAIR_BEG", "IDL_BLN_FAIR_END"), ("PER_BLN_FAIR_BEG", "PER_BLN_FAIR_END"),
                  ("IDL_BLN_IPA_BEG", "IDL_BLN_IPA_END"), ("PER_BLN_IPA_BEG", "PER_BLN_IPA_END"))
     for loc in ("cpu", "pid")], variant="trace_lb")
QUERIES["prv_frq"] = _computed_query(["prv_frq_on_same_cpu"])

# names whose bytes are not UTF-8 are compared as '(invalid)'
COMM_SQL_TEXT = (
    "coalesce(try(decode(unhex(array_to_string(list_transform(b[1:coalesce(list_position(b, 0) - 1, 8)], "
    "lambda x: printf('%02X', x)), '')))), '(invalid)')")
COMM_DICT_SQL = _with(extra=", a AS (SELECT DISTINCT (CAST(arg0 AS BIGINT) << 32) | CAST(arg1 AS BIGINT) AS addr "
                                "FROM trace WHERE event = 0), "
                                "bb AS (SELECT addr, list_transform(range(8), lambda i: (addr >> (8 * i)) & 255) AS b FROM a)") + (
    f"SELECT CAST(row_number() OVER (ORDER BY addr) AS BIGINT) AS comm_id, addr, {COMM_SQL_TEXT} AS comm FROM bb")


@register("comm_dictionary", COMM_DICT_SQL)
def q_comm_dict(spark, sf_dir):
    """CMP6 / FN8: command dictionary of EXEC addresses."""
    names = comm_dictionary(load_trace(spark, sf_dir))
    return names.withColumn("comm", F.when(F.contains("comm", F.lit("\ufffd")), "(invalid)").otherwise(F.col("comm")))


@register("comm", _with(extra=", d AS (SELECT addr, row_number() OVER (ORDER BY addr) AS comm_id FROM "
                              "(SELECT DISTINCT (CAST(arg0 AS BIGINT) << 32) | CAST(arg1 AS BIGINT) AS addr "
                              "FROM trace WHERE event = 0)), "
                              "x AS (SELECT idx, pid, timestamp, CASE WHEN event = 0 THEN "
                              "struct_pack(t := timestamp, i := idx, a := (CAST(arg0 AS BIGINT) << 32) | CAST(arg1 AS BIGINT)) END AS e "
                              "FROM trace), "
                              "y AS (SELECT idx, max(e) OVER (PARTITION BY pid ORDER BY timestamp "
                              "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_exec FROM x)") + (
    "SELECT y.idx, CAST(coalesce(d.comm_id, 0) AS BIGINT) AS comm FROM y LEFT JOIN d ON d.addr = y.last_exec.a"))
def q_comm(spark, sf_dir):
    """CMP7: command id of the latest EXEC of the pid at or before the row."""
    return with_comm(load_trace(spark, sf_dir)).select("idx", "comm")


VARS_SQL = (
    "WITH d(key, value) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in DEFAULT_VARS.items()) + "), "
    "t AS (SELECT DISTINCT upper(event_type) AS key, CAST(CASE event_type "
    + " ".join(f"WHEN '{t}' THEN {c}" for t, c in EVENT_CODE_BY_TYPE.items())
    + " ELSE 13 END AS VARCHAR) AS value FROM events), "
    "u AS (SELECT key, value, 0 AS pr FROM d UNION ALL SELECT key, value, 1 AS pr FROM t) "
    "SELECT '$' || key AS key, arg_max(value, pr) AS value FROM u GROUP BY key")


@register("vars_table", VARS_SQL)
def q_vars(spark, sf_dir):
    """SRC8 / EXP2: defaults overridden by the trace's own dictionary (event
    names of the events table with their codes)."""
    ev = load_events(spark, sf_dir).select("event_type").distinct()
    code = F.lit(OTHER_EVENT_CODE)
    for t, c in reversed(list(EVENT_CODE_BY_TYPE.items())):
        code = F.when(F.col("event_type") == t, F.lit(c)).otherwise(code)
    own = ev.select(F.upper("event_type").alias("key"), code.cast("string").alias("value"),
                    F.lit(1).alias("priority"))
    return merge_vars_frames(vars_frame(spark, DEFAULT_VARS, 0), own)


# --------------------------------------------------------------------- order-sensitive operators

@register("position_ticks", _with() + "SELECT idx, row_number() OVER (ORDER BY timestamp, idx) - 1 AS pos FROM trace")
def q_position(spark, sf_dir):
    """WIN7: dense positions of all rows by time."""
    return _order.with_position(load_trace(spark, sf_dir).select("idx", "timestamp"), ["timestamp", "idx"], "pos").select("idx", "pos")


def _rolling_sql(agg):
    frame = "OVER (ORDER BY idx ROWS BETWEEN 159 PRECEDING AND CURRENT ROW)"
    return _with() + (f"SELECT idx, CASE WHEN count(arg1) {frame} = 160 THEN {agg} END AS r "
                      f"FROM trace")


@register("rolling_sum", _rolling_sql("CAST(sum(arg1) OVER (ORDER BY idx ROWS BETWEEN 159 PRECEDING AND CURRENT ROW) AS DOUBLE)"))
def q_rolling_sum(spark, sf_dir):
    """WIN1: trailing 160-row sum of arg1 over the whole trace."""
    return _order.rolling(load_trace(spark, sf_dir).select("idx", "arg1"), 160, "sum", "arg1", "r").select("idx", "r")


@register("rolling_mean", _rolling_sql(
    "CAST((2 * 10000 * CAST(sum(arg1) OVER (ORDER BY idx ROWS BETWEEN 159 PRECEDING AND CURRENT ROW) AS HUGEINT) + 160)"
    " // 320 AS DOUBLE) / 10000.0"))
def q_rolling_mean(spark, sf_dir):
    """WIN2: trailing 160-row mean (rounded half up at 4 decimals, exactly)."""
    return _order.rolling(load_trace(spark, sf_dir).select("idx", "arg1"), 160, "mean", "arg1", "r",
                          digits=4).select("idx", "r")


@register("rolling_median", _rolling_sql(
    "median(CAST(arg1 AS DOUBLE)) OVER (ORDER BY idx ROWS BETWEEN 159 PRECEDING AND CURRENT ROW)"))
def q_rolling_median(spark, sf_dir):
    """WIN3: trailing 160-row median."""
    return _order.rolling(load_trace(spark, sf_dir).select("idx", "arg1"), 160, "median", "arg1", "r").select("idx", "r")


@register("argsort_ticks", _with(extra=", p AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS pos, "
                                       "row_number() OVER (ORDER BY arg1, idx) - 1 AS rk FROM trace WHERE arg1 IS NOT NULL)") + (
    "SELECT t.idx, coalesce(b.pos, -1) AS y FROM trace t LEFT JOIN p a ON a.idx = t.idx LEFT JOIN p b ON b.rk = a.pos"))
def q_argsort(spark, sf_dir):
    """WIN4: argsort of arg1 over the whole trace (stable ties by idx; rows without a value -1)."""
    return _order.argsort(load_trace(spark, sf_dir).select("idx", "arg1"), "arg1", "y").select("idx", "y")


@register("rank_ticks", _with() + (
    "SELECT idx, CASE WHEN arg1 IS NULL THEN -1 ELSE row_number() OVER (PARTITION BY arg1 IS NULL ORDER BY arg1, idx) - 1 END AS y FROM trace"))
def q_rank(spark, sf_dir):
    """WIN5: argsort of argsort = 0-based rank."""
    return _order.rank(load_trace(spark, sf_dir).select("idx", "arg1"), "arg1", "y").select("idx", "y")


@register("sorted_ticks", _with() + "SELECT idx, timestamp, arg1 FROM trace ORDER BY timestamp")
def q_sorted(spark, sf_dir):
    """WIN6: global sort by timestamp (range-partitioned sort)."""
    return load_trace(spark, sf_dir).select("idx", "timestamp", "arg1").orderBy("timestamp")


# --------------------------------------------------------------------- search & joins

@register("search_next_same_event_cpu", _with() + (
    "SELECT idx AS a, coalesce(lead(idx) OVER (PARTITION BY cpu, event ORDER BY timestamp, idx), idx) AS b FROM trace"))
def q_search_next(spark, sf_dir):
    """SEA1/3/4/5/6/9: next same event on the same CPU (strictly later)."""
    return search(load_trace(spark, sf_dir), next_same_event_pattern("cpu"))


PREV_PATTERN = [
    {"name": "a", "constraint": []},
    {"name": "p", "constraint": ["argmax", "timestamp",
                                 ["&", ["&", ["==", "pid", ["get", "pid", "a"]], ["==", "event", ["get", "event", "a"]]],
                                  ["<", "timestamp", ["get", "timestamp", "a"]]]]},
]


@register("search_prev_same_event_pid", _with() + (
    "SELECT idx AS a, coalesce(lag(idx) OVER (PARTITION BY pid, event ORDER BY timestamp, idx), idx) AS p FROM trace"))
def q_search_prev(spark, sf_dir):
    """SEA7: previous same event of the same pid (argmax)."""
    return search(load_trace(spark, sf_dir), PREV_PATTERN)


CHAIN_PATTERN = [
    {"name": "a", "constraint": ["==", "event", 4]},
    {"name": "b", "constraint": ["argmin", "timestamp",
                                 ["&", ["&", ["==", "pid", ["get", "pid", "a"]], ["==", "event", 2]],
                                  [">", "timestamp", ["get", "timestamp", "a"]]]]},
    {"name": "c", "constraint": ["argmin", "timestamp",
                                 ["&", ["&", ["==", "pid", ["get", "pid", "b"]], ["==", "event", 4]],
                                  [">=", "timestamp", ["get", "timestamp", "b"]]]]},
    {"name": "d", "constraint": []},
]


@register("search_block_chain", _with(extra=(
    ", b AS (SELECT a.idx AS a, coalesce((SELECT arg_min(t.idx, t.timestamp) FROM trace t WHERE t.pid = a.pid "
    "AND t.event = 2 AND t.timestamp > a.timestamp), a.idx) AS b FROM trace a WHERE a.event = 4)")) + (
    "SELECT b.a, b.b, coalesce((SELECT arg_min(t.idx, t.timestamp) FROM trace t, trace s WHERE s.idx = b.b "
    "AND t.pid = s.pid AND t.event = 4 AND t.timestamp >= s.timestamp), b.a) AS c, b.a AS d FROM b"))
def q_search_chain(spark, sf_dir):
    """SEA2/SEA8: BLOCK root -> next WAKEUP of the pid -> next BLOCK after it."""
    return search(load_trace(spark, sf_dir), CHAIN_PATTERN)


GLOBAL_PATTERN = [
    {"name": "a", "constraint": ["==", "event", 10]},
    {"name": "b", "constraint": ["argmin", "timestamp", ["&", [], [">", "timestamp", ["get", "timestamp", "a"]]]]},
]


@register("search_next_root_match", _with() + (
    "SELECT idx AS a, coalesce(lead(idx) OVER (ORDER BY timestamp, idx), idx) AS b FROM trace WHERE event = 10"))
def q_search_global(spark, sf_dir):
    """SEA6 with ``[]`` (root mask) and no equality key: next TICK overall."""
    return search(load_trace(spark, sf_dir), GLOBAL_PATTERN)


FIRST_PATTERN = [
    {"name": "a", "constraint": ["==", "event", 4]},
    {"name": "f", "constraint": ["argmin", "timestamp", ["&", ["==", "pid", ["get", "pid", "a"]], ["==", "event", 2]]]},
]


@register("search_first_of_pid", _with(extra=", m AS (SELECT pid, arg_min(idx, timestamp) AS f FROM trace "
                                             "WHERE event = 2 GROUP BY pid)") + (
    "SELECT t.idx AS a, coalesce(m.f, t.idx) AS f FROM trace t LEFT JOIN m ON m.pid = t.pid WHERE t.event = 4"))
def q_search_first(spark, sf_dir):
    """SEA6 without a bound: first WAKEUP of the pid (group argmin)."""
    return search(load_trace(spark, sf_dir), FIRST_PATTERN)


NEXT_OF_CPU = ["&", ["==", "cpu", ["get", "cpu", "a"]], [">", "timestamp", ["get", "timestamp", "a"]]]
_NEXT_CPU_SQL = "SELECT arg_min(t.idx, t.timestamp) FROM trace t WHERE t.cpu = a.cpu AND t.timestamp > a.timestamp"


@register("search_get_literal", _with() + (
    f"SELECT a.idx AS a, coalesce(CASE WHEN a.event = 4 AND a.arg0 <> a.cpu THEN ({_NEXT_CPU_SQL}) END, a.idx) AS b FROM trace a"))
def q_search_get_literal(spark, sf_dir):
    """SEA5: ``get`` against a literal and against another ``get`` (tests of the probe)."""
    return search(load_trace(spark, sf_dir), [
        {"name": "a", "constraint": []},
        {"name": "b", "constraint": ["argmin", "timestamp", ["&", ["&", ["==", ["get", "event", "a"], 4],
                                     ["!=", ["get", "arg0", "a"], ["get", "cpu", "a"]]], NEXT_OF_CPU]]}])


@register("search_or_get", _with() + (
    "SELECT a.idx AS a, coalesce((SELECT arg_min(t.idx, t.timestamp) FROM trace t WHERE t.timestamp > a.timestamp "
    "AND (t.cpu = a.cpu OR t.pid = a.pid)), a.idx) AS b FROM trace a WHERE a.event = 4"))
def q_search_or_get(spark, sf_dir):
    """SEA4: ``|`` around ``get``: one branch for each side, the smaller key wins."""
    return search(load_trace(spark, sf_dir), [
        {"name": "a", "constraint": ["==", "event", 4]},
        {"name": "b", "constraint": ["argmin", "timestamp", ["&", [">", "timestamp", ["get", "timestamp", "a"]],
                                     ["|", ["==", "cpu", ["get", "cpu", "a"]], ["==", "pid", ["get", "pid", "a"]]]]]}])


@register("search_ne_key", _with() + (
    "SELECT a.idx AS a, coalesce((SELECT arg_max(t.idx, t.timestamp) FROM trace t WHERE t.timestamp <> a.timestamp "
    "AND t.pid = a.pid AND t.event = 4), a.idx) AS b FROM trace a WHERE a.event = 4"))
def q_search_ne_key(spark, sf_dir):
    """SEA3: ``!=`` between the reduction key and a ``get`` (``<`` or ``>``)."""
    return search(load_trace(spark, sf_dir), [
        {"name": "a", "constraint": ["==", "event", 4]},
        {"name": "b", "constraint": ["argmax", "timestamp", ["&", ["&", ["!=", "timestamp", ["get", "timestamp", "a"]],
                                     ["==", "pid", ["get", "pid", "a"]]], ["==", "event", 4]]]}])


@register("search_two_bounds", _with(extra=(
    f", s AS (SELECT a.idx AS a, a.timestamp, a.cpu, coalesce(({_NEXT_CPU_SQL}), a.idx) AS b FROM trace a WHERE a.event = 4)")) + (
    "SELECT s.a, s.b, coalesce((SELECT arg_min(t.idx, t.timestamp) FROM trace t WHERE t.event = 2 AND t.timestamp > s.timestamp "
    "AND t.timestamp >= u.timestamp), s.a) AS c FROM s JOIN trace u ON u.idx = s.b"))
def q_search_two_bounds(spark, sf_dir):
    """SEA7: two lower bounds on the key, from two nodes."""
    return search(load_trace(spark, sf_dir), [
        {"name": "a", "constraint": ["==", "event", 4]},
        {"name": "b", "constraint": ["argmin", "timestamp", NEXT_OF_CPU]},
        {"name": "c", "constraint": ["argmin", "timestamp", ["&", ["&", ["==", "event", 2], [">", "timestamp", ["get", "timestamp", "a"]]],
                                     [">=", "timestamp", ["get", "timestamp", "b"]]]]}])


AFTER = [">", "timestamp", ["get", "timestamp", "a"]]
ON_CPU = ["==", "cpu", ["get", "cpu", "a"]]


@register("search_other_bound", _with() + (
    "SELECT a.idx AS a, coalesce((SELECT arg_min(t.idx, t.timestamp) FROM trace t WHERE t.cpu = a.cpu AND t.timestamp > a.timestamp "
    "AND t.arg0 > a.arg0), a.idx) AS b FROM trace a"))
def q_search_other_bound(spark, sf_dir):
    """SEA7 with a bound on a column that is not the key: the next row of the CPU with a larger argument."""
    return search(load_trace(spark, sf_dir), [
        {"name": "a", "constraint": []},
        {"name": "b", "constraint": ["argmin", "timestamp", ["&", ["&", ON_CPU, AFTER], [">", "arg0", ["get", "arg0", "a"]]]]}])


@register("search_other_bound_prev", _with() + (
    "SELECT a.idx AS a, coalesce((SELECT arg_max(t.idx, t.timestamp) FROM trace t WHERE t.timestamp <= a.timestamp "
    "AND t.pid <= a.cpu AND t.event = 2), a.idx) AS b FROM trace a WHERE a.event = 4"))
def q_search_other_bound_prev(spark, sf_dir):
    """SEA6/SEA7: argmax, no equality key, a bound on one column by another one of the probe."""
    return search(load_trace(spark, sf_dir), [
        {"name": "a", "constraint": ["==", "event", 4]},
        {"name": "b", "constraint": ["argmax", "timestamp", ["&", ["&", ["==", "event", 2], ["<=", "timestamp", ["get", "timestamp", "a"]]],
                                     [">=", ["get", "cpu", "a"], "pid"]]]}])


@register("search_other_range", _with() + (
    "SELECT a.idx AS a, coalesce((SELECT arg_min(t.idx, t.timestamp) FROM trace t WHERE t.timestamp > a.timestamp AND t.cpu = a.cpu "
    "AND t.arg1 > a.arg0 AND t.arg1 <= a.arg1 AND t.pid < a.pid), a.idx) AS b FROM trace a WHERE a.event = 4"))
def q_search_other_range(spark, sf_dir):
    """SEA7: a range of one column and a bound on a third one."""
    return search(load_trace(spark, sf_dir), [
        {"name": "a", "constraint": ["==", "event", 4]},
        {"name": "b", "constraint": ["argmin", "timestamp", ["&", ["&", ["&", AFTER, ON_CPU], [">", "arg1", ["get", "arg0", "a"]]],
                                     ["&", ["<=", "arg1", ["get", "arg1", "a"]], ["<", "pid", ["get", "pid", "a"]]]]]}])


@register("search_other_first", _with() + (
    "SELECT a.idx AS a, coalesce((SELECT arg_min(t.idx, t.timestamp) FROM trace t WHERE t.event = a.event AND t.arg0 >= a.arg0 AND t.arg0 >= a.cpu), "
    "a.idx) AS b FROM trace a"))
def q_search_other_first(spark, sf_dir):
    """SEA6 without a bound on the key, with two on another column."""
    return search(load_trace(spark, sf_dir), [
        {"name": "a", "constraint": []},
        {"name": "b", "constraint": ["argmin", "timestamp", ["&", ["==", "event", ["get", "event", "a"]],
                                     ["&", [">=", "arg0", ["get", "arg0", "a"]], [">=", "arg0", ["get", "cpu", "a"]]]]]}])


@register("search_ne_other", _with() + (
    "SELECT a.idx AS a, coalesce((SELECT arg_min(t.idx, t.timestamp) FROM trace t WHERE t.cpu = a.cpu AND t.timestamp > a.timestamp "
    "AND t.event <> a.event), a.idx) AS b FROM trace a"))
def q_search_ne_other(spark, sf_dir):
    """SEA3: ``!=`` on a column that is not the key: the next other event of the CPU."""
    return search(load_trace(spark, sf_dir), [
        {"name": "a", "constraint": []},
        {"name": "b", "constraint": ["argmin", "timestamp", ["&", ["&", ON_CPU, AFTER], ["!=", "event", ["get", "event", "a"]]]]}])


@register("search_ne_other_last", _with() + (
    "SELECT a.idx AS a, coalesce((SELECT arg_max(t.idx, t.timestamp) FROM trace t WHERE t.event = a.event AND t.pid <> a.pid), a.idx) AS b FROM trace a"))
def q_search_ne_other_last(spark, sf_dir):
    """SEA3 without a bound on the key: the last row of the event by another process."""
    return search(load_trace(spark, sf_dir), [
        {"name": "a", "constraint": []},
        {"name": "b", "constraint": ["argmax", "timestamp", ["&", ["==", "event", ["get", "event", "a"]], ["!=", ["get", "pid", "a"], "pid"]]]}])


@register("search_ne_two", _with() + (
    "SELECT a.idx AS a, coalesce((SELECT arg_max(t.idx, t.timestamp) FROM trace t WHERE t.timestamp < a.timestamp AND t.event <> a.event "
    "AND t.pid <> a.pid AND t.arg0 <= a.arg0), a.idx) AS b FROM trace a WHERE a.event = 4"))
def q_search_ne_two(spark, sf_dir):
    """SEA3/SEA7: two ``!=`` and a bound, all on columns that are not the key."""
    return search(load_trace(spark, sf_dir), [
        {"name": "a", "constraint": ["==", "event", 4]},
        {"name": "b", "constraint": ["argmax", "timestamp", ["&", ["&", ["<", "timestamp", ["get", "timestamp", "a"]], ["!=", "event", ["get", "event", "a"]]],
                                     ["&", ["!=", "pid", ["get", "pid", "a"]], ["<=", "arg0", ["get", "arg0", "a"]]]]]}])


@register("asof_block_wakeup", _with(extra=(
    ", j AS (SELECT e0.idx AS e0idx, e1.idx AS e1idx, row_number() OVER (PARTITION BY e0.idx "
    "ORDER BY e1.timestamp, e1.idx) AS rn FROM trace e0 JOIN trace e1 ON e0.pid = e1.pid "
    "AND e0.timestamp <= e1.timestamp WHERE e0.event = 4 AND e1.event = 2)")) + (
    "SELECT e0idx, e1idx FROM j WHERE rn = 1"))
def q_asof(spark, sf_dir):
    """JOIN1 / JOIN4 / AGG12: BLOCK -> first WAKEUP of the same pid at or after it."""
    return block_to_wakeup(load_trace(spark, sf_dir))


# --------------------------------------------------------------------- frame operations


def _frame_sql(name):
    return oracle.spec_sql(RECIPES[name](), TEST_VARS, RECIPE_VARIANT.get(name, "base"))


def _frame(spark, sf_dir, name):
    return recipe_frame(spark, sf_dir, name)


def _shared_frame(spark, sf_dir, name):
    """A frame read by several actions (ranges, then a filter / raster)."""
    from ..config import materialize
    return materialize(recipe_frame(spark, sf_dir, name))


RQ_SQL = _frame_sql("run_queue")
FP_SQL = _frame_sql("freq_points")
RQ_COLS = ["x0", "y0", "x1", "y1", "arg0", "arg1", "delta"]
RQ_FLOAT = {"y0", "y1"}


def _stats_sql():
    parts = []
    for col in RQ_COLS:
        qc = oracle.q(col)
        if col in RQ_FLOAT:
            v = f"CASE WHEN NOT isnan({qc}) THEN {qc} END"
            tot = f"CAST(sum(CAST({v} AS DECIMAL(38,10))) AS DOUBLE)"
        else:
            v = qc
            tot = f"CAST(sum(CAST({v} AS DECIMAL(38,0))) AS DOUBLE)"
        cnt = f"count({v})"
        parts += [f"{tot} / CASE WHEN {cnt} > 0 THEN CAST({cnt} AS DOUBLE) END AS {oracle.q(col + '.mean')}",
                  f"coalesce({tot}, 0.0) AS {oracle.q(col + '.sum')}",
                  f"CAST({cnt} AS BIGINT) AS {oracle.q(col + '.count')}"]
    return f"SELECT c, {', '.join(parts)} FROM ({RQ_SQL}) f GROUP BY c"


@register("stats_run_queue", _stats_sql())
def q_stats(spark, sf_dir):
    """AGG1: mean / sum / count of every column per category."""
    return _fo.category_stats(_frame(spark, sf_dir, "run_queue"))


def _cats_values(name):
    spec = RECIPES[name]()
    rows = ", ".join(
        f"({i}, '{c['label']}', '{c['color']}', {str(bool(c.get('hide_hovertool', False))).upper()})"
        for i, c in enumerate(spec["c"]))
    return f"cats(c, label, color, hide_hovertool) AS (VALUES {rows})"


@register("categories_run_queue", (
    f"WITH {_cats_values('run_queue')}, n AS (SELECT c, count(*) AS n FROM ({RQ_SQL}) f GROUP BY c) "
    "SELECT CAST(cats.c AS INTEGER) AS c, label, color, hide_hovertool, CAST(coalesce(n.n, 0) AS BIGINT) AS n "
    "FROM cats LEFT JOIN n ON n.c = cats.c"))
def q_categories(spark, sf_dir):
    """AGG2 / JOIN8: categories with their row counts (empty ones included)."""
    return category_table(_frame(spark, sf_dir, "run_queue"), RECIPES["run_queue"]())


@register("legend_events_per_cpu", (
    f"WITH {_cats_values('events_per_cpu')}, n AS (SELECT c, count(*) AS n FROM ({_frame_sql('events_per_cpu')}) f "
    "GROUP BY c) SELECT CAST(cats.c AS INTEGER) AS c, label, color, CAST(n.n AS BIGINT) AS n "
    "FROM cats JOIN n ON n.c = cats.c WHERE n.n > 0"))
def q_legend(spark, sf_dir):
    """AGG10 / Q19: legend of the non-empty categories."""
    frame = _frame(spark, sf_dir, "events_per_cpu")
    return _ra.legend(category_table(frame, RECIPES["events_per_cpu"]()))


SEG_RANGES = ("CAST(least(min(x0), min(x1)) AS DOUBLE) AS xmin, CAST(greatest(max(x0), max(x1)) AS DOUBLE) AS xmax, "
              "CAST(least(min(y0), min(y1)) AS DOUBLE) AS ymin, CAST(greatest(max(y0), max(y1)) AS DOUBLE) AS ymax")
PT_RANGES = ("CAST(min(x) AS DOUBLE) AS xmin, CAST(max(x) AS DOUBLE) AS xmax, "
             "CAST(min(y) AS DOUBLE) AS ymin, CAST(max(y) AS DOUBLE) AS ymax")


@register("ranges_run_queue", f"SELECT {SEG_RANGES} FROM ({RQ_SQL}) f")
def q_ranges_seg(spark, sf_dir):
    """AGG5: data range of a segment frame (one pass)."""
    return _fo.data_ranges(_frame(spark, sf_dir, "run_queue"))


@register("ranges_freq_points", f"SELECT {PT_RANGES} FROM ({FP_SQL}) f")
def q_ranges_pt(spark, sf_dir):
    """AGG4: data range of a point frame."""
    return _fo.data_ranges(_frame(spark, sf_dir, "freq_points"))


@register("lanes_run_queue", (
    f"SELECT CAST(count(DISTINCT y0) AS BIGINT) AS lanes, CAST((count(DISTINCT y0) + 2) * 4 AS BIGINT) AS height, "
    f"CAST(-1 AS BIGINT) AS ymin_clamp, CAST(count(DISTINCT y0) + 1 AS BIGINT) AS ymax_clamp FROM ({RQ_SQL}) f"))
def q_lanes(spark, sf_dir):
    """EXP20 / AGG11: lanes, figure height and y clamp."""
    return _fo.lanes(_frame(spark, sf_dir, "run_queue"))


def _mid_box(r):
    dx, dy = (r["xmax"] - r["xmin"]) / 4, (r["ymax"] - r["ymin"]) / 4
    return r["xmin"] + dx, r["xmax"] - dx, r["ymin"] + dy, r["ymax"] - dy


MID_BOX_SQL = ("v AS (SELECT xmin + (xmax - xmin) / 4 AS xlo, xmax - (xmax - xmin) / 4 AS xhi, "
               "ymin + (ymax - ymin) / 4 AS ylo, ymax - (ymax - ymin) / 4 AS yhi FROM r)")


@register("viewport_segments", (
    f"WITH f AS ({RQ_SQL}), r AS (SELECT {SEG_RANGES} FROM f), {MID_BOX_SQL} "
    "SELECT f.* FROM f, v WHERE ((x0 >= xlo AND x0 <= xhi) OR (x0 <= xlo AND x1 >= xhi)) "
    "AND ((y0 >= ylo AND y0 <= yhi) OR (y0 <= ylo AND y1 >= yhi))"))
def q_viewport_seg(spark, sf_dir):
    """EXP18 as stated (first end inside or spanning), middle half of the data range."""
    frame = _shared_frame(spark, sf_dir, "run_queue")
    box = _mid_box(_fo.data_ranges(frame).first())
    return frame.where(_fo.segment_viewport(*box))


@register("viewport_segments_overlap", (
    f"WITH f AS ({RQ_SQL}), r AS (SELECT {SEG_RANGES} FROM f), {MID_BOX_SQL} "
    "SELECT f.* FROM f, v WHERE least(x0, x1) <= xhi AND greatest(x0, x1) >= xlo "
    "AND least(y0, y1) <= yhi AND greatest(y0, y1) >= ylo"))
def q_viewport_overlap(spark, sf_dir):
    """EXP18 variant: true overlap of the segment box and the viewport."""
    frame = _shared_frame(spark, sf_dir, "run_queue")
    box = _mid_box(_fo.data_ranges(frame).first())
    return frame.where(_fo.segment_viewport_overlap(*box))


@register("viewport_points", (
    f"WITH f AS ({FP_SQL}), r AS (SELECT {PT_RANGES} FROM f), {MID_BOX_SQL} "
    "SELECT f.* FROM f, v WHERE x BETWEEN xlo AND xhi AND y BETWEEN ylo AND yhi"))
def q_viewport_pt(spark, sf_dir):
    """EXP17: inclusive box on points."""
    frame = _shared_frame(spark, sf_dir, "freq_points")
    box = _mid_box(_fo.data_ranges(frame).first())
    return frame.where(_fo.point_viewport(*box))


def _stored_viewport(spark, sf_dir, name, **how):
    """The frame stored in the order of the curve, then zoomed: row groups outside are skipped."""
    frame = _shared_frame(spark, sf_dir, name)
    box = _mid_box(_fo.data_ranges(frame).first())
    d = scratch_dir(spark, "viewport")
    _frames.write_frame(frame, d, row_group_bytes=1 << 16)
    return _frames.read_viewport(spark, d, *box, **how)


QUERIES["viewport_points_stored"] = (lambda spark, sf_dir: _stored_viewport(spark, sf_dir, "freq_points"), QUERIES["viewport_points"][1])
QUERIES["viewport_segments_stored"] = (lambda spark, sf_dir: _stored_viewport(spark, sf_dir, "run_queue"), QUERIES["viewport_segments"][1])
QUERIES["viewport_overlap_stored"] = (lambda spark, sf_dir: _stored_viewport(spark, sf_dir, "run_queue", overlap=True),
                                      QUERIES["viewport_segments_overlap"][1])


@register("synthetic_lines", (
    "WITH s AS (SELECT CAST((i * 48271 + 11) % 1000000000 AS DOUBLE) AS x0, CAST((i * 69621 + 7) % 160 AS DOUBLE) AS y0, "
    "CAST((i * 16807 + 3) % 20 AS INTEGER) AS c FROM (SELECT CAST(event_id AS BIGINT) % 2147483648 AS i FROM events)) "
    "SELECT x0, y0, x0 AS x1, y0 + 0.5 AS y1, c FROM s"))
def q_synthetic(spark, sf_dir):
    """SRC17: arithmetic segments, one for each event, sorted by x0."""
    return _text.synthetic_lines_of(load_events(spark, sf_dir), "event_id")


@register("hide_hovertool_run_queue", f"SELECT * FROM ({RQ_SQL}) f WHERE c NOT IN (4)")
def q_hide(spark, sf_dir):
    """EXP19: drop categories flagged hide_hovertool."""
    spec = RECIPES["run_queue"]()
    return _fo.exclude_categories(_frame(spark, sf_dir, "run_queue"), _fo.hidden_categories(spec))


@register("interactive_query", f"SELECT * FROM ({RQ_SQL}) f WHERE arg0 >= 2 AND delta > 1000000")
def q_interactive(spark, sf_dir):
    """EXP16: user query with $NAME substitution and arithmetic."""
    frame = _frame(spark, sf_dir, "run_queue")
    return _fo.apply_query(frame, "arg0 >= $TICK - 8 & delta > 1000000", TEST_VARS).frame


@register("interactive_fallback", (
    f"WITH f AS ({RQ_SQL}) SELECT * FROM f WHERE delta < 0 OR NOT EXISTS (SELECT 1 FROM f WHERE delta < 0)"))
def q_fallback(spark, sf_dir):
    """EXP16 / Q4: a query with no rows falls back to the unfiltered frame."""
    frame = _frame(spark, sf_dir, "run_queue")
    return _fo.apply_query(frame, "delta < 0", TEST_VARS).frame


@register("result_ranges", f"SELECT {SEG_RANGES} FROM ({RQ_SQL}) f WHERE arg0 >= 2 AND delta > 1000000")
def q_result_ranges(spark, sf_dir):
    """AGG6: ranges of the filtered (result) frame."""
    frame = _frame(spark, sf_dir, "run_queue")
    return _fo.data_ranges(_fo.apply_query(frame, "arg0 >= 2 & delta > 1000000").frame)


HOVER_ROWS = 200


@register("hover_sample", (
    f"WITH f AS ({RQ_SQL}), r AS (SELECT {SEG_RANGES} FROM f), {MID_BOX_SQL}, "
    "k AS (SELECT f.* FROM f, v WHERE ((x0 >= xlo AND x0 <= xhi) OR (x0 <= xlo AND x1 >= xhi)) "
    "AND ((y0 >= ylo AND y0 <= yhi) OR (y0 <= ylo AND y1 >= yhi)) AND c NOT IN (4)), m AS (SELECT count(*) AS m FROM k) "
    "SELECT k.* FROM k, m WHERE m <= 200 OR CAST('0x' || md5('7|' || CAST(x0 AS VARCHAR) || '|' || CAST(x1 AS VARCHAR) || '|' "
    "|| CAST(arg1 AS VARCHAR))[1:8] AS BIGINT) < CAST(floor(4294967296 * 200.0::DOUBLE / m) AS BIGINT)"))
def q_hover(spark, sf_dir):
    """WIN8: viewport + hidden categories, sampled to about 200 rows by a hash of the row."""
    frame = _shared_frame(spark, sf_dir, "run_queue")
    spec = RECIPES["run_queue"]()
    box = _mid_box(_fo.data_ranges(frame).first())
    return _fo.hover_sample(frame, _fo.segment_viewport(*box), _fo.hidden_categories(spec), max_rows=HOVER_ROWS, keys=["x0", "x1", "arg1"])


# --------------------------------------------------------------------- raster

def _pix_sql(v, lo, hi, size):
    return f"least(floor((CAST({v} AS DOUBLE) - {lo}) * {float(size)} / ({hi} - {lo})), {size - 1})"


@register("raster_points", (
    f"WITH f AS ({FP_SQL}), r AS (SELECT {PT_RANGES} FROM f) "
    f"SELECT CAST({_pix_sql('x', 'xmin', 'xmax', 64)} AS INTEGER) AS px, "
    f"CAST({_pix_sql('y', 'ymin', 'ymax', 32)} AS INTEGER) AS py, CAST(c AS INTEGER) AS c, count(*) AS n "
    "FROM f, r WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY 1, 2, 3"))
def q_raster_points(spark, sf_dir):
    """AGG7: 64x32 point raster over the data range."""
    frame = _shared_frame(spark, sf_dir, "freq_points")
    r = _fo.data_ranges(frame).first()
    return _ra.point_raster(frame, (r["xmin"], r["xmax"]), (r["ymin"], r["ymax"]), 64, 32)


def _segment_raster_sql(box_sql, w, h):
    lo = ("GREATEST(0.0, CASE WHEN -dx < 0 THEN (x0d - xlo) / (-dx) END, CASE WHEN dx < 0 THEN (xhi - x0d) / dx END, "
          "CASE WHEN -dy < 0 THEN (y0d - ylo) / (-dy) END, CASE WHEN dy < 0 THEN (yhi - y0d) / dy END)")
    hi = ("LEAST(1.0, CASE WHEN -dx > 0 THEN (x0d - xlo) / (-dx) END, CASE WHEN dx > 0 THEN (xhi - x0d) / dx END, "
          "CASE WHEN -dy > 0 THEN (y0d - ylo) / (-dy) END, CASE WHEN dy > 0 THEN (yhi - y0d) / dy END)")
    rej = ("((-dx = 0 AND x0d - xlo < 0) OR (dx = 0 AND xhi - x0d < 0) OR "
           "(-dy = 0 AND y0d - ylo < 0) OR (dy = 0 AND yhi - y0d < 0))")
    return (
        f"WITH f AS ({RQ_SQL}), r AS (SELECT {SEG_RANGES} FROM f), {box_sql}, "
        "s AS (SELECT CAST(x0 AS DOUBLE) AS x0d, CAST(y0 AS DOUBLE) AS y0d, "
        "CAST(x1 AS DOUBLE) - CAST(x0 AS DOUBLE) AS dx, CAST(y1 AS DOUBLE) - CAST(y0 AS DOUBLE) AS dy, c, "
        "xlo, xhi, ylo, yhi FROM f, v), "
        f"t AS (SELECT *, {lo} AS t0, {hi} AS t1, {rej} AS rej FROM s), "
        "cl AS (SELECT x0d + t0 * dx AS cx0, y0d + t0 * dy AS cy0, x0d + t1 * dx AS cx1, y0d + t1 * dy AS cy1, "
        "c, xlo, xhi, ylo, yhi FROM t WHERE NOT rej AND t0 <= t1), "
        f"e AS (SELECT CAST({_pix_sql('cx0', 'xlo', 'xhi', w)} AS INTEGER) AS ax, "
        f"CAST({_pix_sql('cy0', 'ylo', 'yhi', h)} AS INTEGER) AS ay, "
        f"CAST({_pix_sql('cx1', 'xlo', 'xhi', w)} AS INTEGER) AS bx, "
        f"CAST({_pix_sql('cy1', 'ylo', 'yhi', h)} AS INTEGER) AS qy, CAST(c AS INTEGER) AS c FROM cl), "
        "g AS (SELECT *, greatest(abs(bx - ax), abs(qy - ay)) AS n FROM e), "
        "p AS (SELECT ax + CASE WHEN n = 0 THEN 0 ELSE CAST(floor((2 * (bx - ax) * i + n) / (2 * n)) AS INTEGER) END AS px, "
        "ay + CASE WHEN n = 0 THEN 0 ELSE CAST(floor((2 * (qy - ay) * i + n) / (2 * n)) AS INTEGER) END AS py, c "
        "FROM g, unnest(range(0, n + 1)) AS u(i)) "
        "SELECT px, py, c, count(*) AS n FROM p GROUP BY px, py, c")


FULL_BOX_SQL = "v AS (SELECT xmin AS xlo, xmax AS xhi, ymin AS ylo, ymax AS yhi FROM r)"


def _seg_raster(spark, sf_dir, zoom):
    frame = _shared_frame(spark, sf_dir, "run_queue")
    r = _fo.data_ranges(frame).first()
    if zoom:
        xlo, xhi, ylo, yhi = _mid_box(r)
    else:
        xlo, xhi, ylo, yhi = r["xmin"], r["xmax"], r["ymin"], r["ymax"]
    return _ra.segment_raster(frame, (xlo, xhi), (ylo, yhi), 256, 64)


@register("raster_segments", _segment_raster_sql(FULL_BOX_SQL, 256, 64))
def q_raster_segments(spark, sf_dir):
    """AGG8: 256x64 segment raster over the data range."""
    return _seg_raster(spark, sf_dir, False)


@register("raster_segments_zoom", _segment_raster_sql(MID_BOX_SQL, 256, 64))
def q_raster_segments_zoom(spark, sf_dir):
    """AGG8 with clipping: the middle half of the data range."""
    return _seg_raster(spark, sf_dir, True)


def _shade_sql():
    spec = RECIPES["run_queue"]()
    pal = ", ".join(f"({i}, {int(c['color'][1:3], 16)}, {int(c['color'][3:5], 16)}, {int(c['color'][5:7], 16)})"
                    for i, c in enumerate(spec["c"]))
    ras = _segment_raster_sql(FULL_BOX_SQL, 256, 64)
    def ch(x):
        return f"CAST(floor((2 * sum(n * {x}) + sum(n)) / (2 * sum(n))) AS INTEGER) AS {x}"
    return (f"WITH pal(c, r, g, b) AS (VALUES {pal}), ras AS ({ras}) "
            f"SELECT px, py, {ch('r')}, {ch('g')}, {ch('b')}, 255 AS a, CAST(sum(n) AS BIGINT) AS n "
            "FROM ras JOIN pal USING (c) GROUP BY px, py")


@register("shade_segments", _shade_sql())
def q_shade(spark, sf_dir):
    """AGG9: count-weighted category colour per pixel (FN12 palette)."""
    ras = _seg_raster(spark, sf_dir, False)
    return _ra.shade(ras, _categories(spark, RECIPES["run_queue"]()))


# --------------------------------------------------------------------- run tables


def _run_logs(spark, sf_dir):
    return run_logs_from_events(load_events(spark, sf_dir))


RUN_LOG_CTES = (
    "ev AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, "
    "printf('%.2f', value) AS v, 'runs/BENCH=phoronix/POWER=' || CASE WHEN user_id % 2 = 0 THEN 'powersave-y' "
    "ELSE 'performance-n' END || '/MONITORING=cpu-energy-meter/PHORONIX=bench' || "
    "CAST(CAST(floor(user_id / 2) AS BIGINT) AS VARCHAR) || CASE WHEN user_id % 5 = 0 THEN '/k9' ELSE '/k' || "
    "CAST(CAST(floor(user_id / 2) AS BIGINT) % 3 AS VARCHAR) END || '/1.tar' AS path "
    "FROM events), "
    "lines AS (SELECT path, CASE WHEN event_type IN ('view', 'click') THEN 'cpu-energy-meter.out' "
    "WHEN event_type = 'purchase' THEN 'time.err' ELSE 'run.out' END AS member, event_id AS line_no, "
    "CASE WHEN event_type = 'view' THEN 'cpu' || CAST(k % 4 AS VARCHAR) || '_package_joules=' || v "
    "WHEN event_type = 'click' THEN 'cpu' || CAST(k % 4 AS VARCHAR) || '_dram_joules=' || v "
    "WHEN event_type = 'purchase' THEN v "
    "WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN '    transactions:   ' ELSE '    Transactions:   ' END || CAST(k AS VARCHAR) || '   (' || v || ' per sec.)' "
    "ELSE 'error ' || CAST(k AS VARCHAR) END AS line FROM ev), "
    "res AS (SELECT path, event_id AS doc_no, 0 AS pos, event_type AS test, 'k=' || CAST(k % 3 AS VARCHAR) AS arguments, "
    "'ops' AS units, value AS value FROM ev WHERE event_type <> 'signup'), "
    "kern AS (SELECT path, arg_min('4.19.' || CAST(k % 5 AS VARCHAR), event_id) AS kernel FROM ev "
    "WHERE event_type = 'signup' GROUP BY path), "
    "idx AS (SELECT DISTINCT path FROM ev WHERE regexp_matches(path, '^(?:" + _runs.TRACE_PATH_PATTERN + ")'))")


# The log patterns as regular expressions, written out for the oracle.
LOG_REGEX = [("usr_bin_time", "time.err", r"(?i)^([-+ ]?\d*\.\d+)$"),
             ("sysbench_trps", "run.out", r"(?i)^\s+transactions:\s+[-+ ]?\d+\s+\(([-+ ]?\d*\.\d+) per sec\.\)$"),
             *[(f"cpu{i}_{part}_joules", "cpu-energy-meter.out", rf"(?i)^cpu{i}_{part}_joules=([-+ ]?\d*\.\d+)$")
               for part in ("package", "dram") for i in range(4)]]


def _summary_sql():
    pats = [(None, name, member, None) for name, member, _ in LOG_REGEX]
    cols = []
    for name, member, rx in LOG_REGEX:
        cols.append(f"arg_min(regexp_extract(line, '{rx}', 1), line_no) FILTER "
                    f"(WHERE member = '{member}' AND regexp_matches(line, '{rx}')) AS {name}")
    fl = ("coalesce(TRY_CAST({} AS DOUBLE), CAST('nan' AS DOUBLE))")
    st = "coalesce(CAST({} AS VARCHAR), '(NULL)')"
    sel = ["idx.path AS fname"]
    sel += [f"coalesce(nullif(regexp_extract(idx.path, '{v}=([^/]+)', 1), ''), '(NULL)') AS {v}"
            for v in _runs.PATH_VARS]
    sel += [fl.format(name) + f" AS {name}" for _, name, _, _ in pats]
    for i in range(_runs.MAX_RESULTS):
        sel += [st.format(f"r{i}.test") + f" AS phoro_test{i}", st.format(f"r{i}.arguments") + f" AS phoro_args{i}",
                st.format(f"r{i}.units") + f" AS phoro_units{i}", fl.format(f"r{i}.value") + f" AS phoro_value{i}"]
    sel.append(st.format("kern.kernel") + " AS kernel")
    pk = " + ".join(f"cpu{i}_package_joules" for i in range(4))
    dr = " + ".join(f"cpu{i}_dram_joules" for i in range(4))
    joins = " ".join(f"LEFT JOIN (SELECT * FROM ranked WHERE rn = {i + 1}) r{i} ON r{i}.path = idx.path"
                     for i in range(_runs.MAX_RESULTS))
    return (f"WITH {RUN_LOG_CTES}, "
            f"pm AS (SELECT path, {', '.join(cols)} FROM lines GROUP BY path), "
            "ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_no, pos) AS rn FROM res), "
            f"base AS (SELECT {', '.join(sel)} FROM idx LEFT JOIN pm ON pm.path = idx.path {joins} "
            "LEFT JOIN kern ON kern.path = idx.path) "
            f"SELECT *, ({pk}) AS total_package_joules, ({dr}) AS total_dram_joules, "
            f"({pk}) + ({dr}) AS total_joules FROM base")


@register("run_traces_summary", _summary_sql())
def q_traces_summary(spark, sf_dir):
    """RUN1 / RUN3: one row per run (path variables, log patterns, JSON results, totals)."""
    lines, docs = _run_logs(spark, sf_dir)
    return _runs.traces_summary(lines, docs)


def _comparison_sql():
    ps = "^.*BENCH=phoronix/POWER=powersave-y/MONITORING=cpu-energy-meter/PHORONIX=[^/]+/[^/]+/1\\.tar$"
    pf = "^.*BENCH=phoronix/POWER=performance-n/MONITORING=cpu-energy-meter/PHORONIX=[^/]+/[^/]+/1\\.tar$"
    nan = "CAST('nan' AS DOUBLE)"

    def ratio(a, b):
        return f"CASE WHEN {b} = 0 THEN {nan} ELSE {a} / {b} END"
    a, b = "perf_value_powersave", "perf_value_performance"
    return (f"WITH {RUN_LOG_CTES}, "
            f"r2 AS (SELECT path, regexp_extract(path, 'PHORONIX=([^/]+)/([^/]+)/', 1) || ' ' || "
            f"regexp_extract(path, 'PHORONIX=([^/]+)/([^/]+)/', 2) AS ph, "
            f"CASE WHEN regexp_matches(path, '{ps}') THEN 'powersave' WHEN regexp_matches(path, '{pf}') "
            "THEN 'performance' END AS mode FROM idx), "
            "fst AS (SELECT ph, mode, min(path) AS p FROM r2 WHERE mode IS NOT NULL GROUP BY ph, mode), "
            "pairs AS (SELECT a.p AS fps, b.p AS fpf FROM fst a JOIN fst b ON a.ph = b.ph "
            "AND a.mode = 'powersave' AND b.mode = 'performance'), "
            "kept AS (SELECT r.test, r.arguments, r.units, pairs.fps, pairs.fpf FROM res r JOIN pairs ON r.path = pairs.fps "
            "WHERE EXISTS (SELECT 1 FROM res q WHERE q.path = pairs.fpf AND q.test = r.test "
            "AND q.arguments = r.arguments AND q.units = r.units)), "
            "fv AS (SELECT path, test, arguments, units, arg_min(value, doc_no * 1000000 + pos) AS v FROM res "
            "GROUP BY path, test, arguments, units), "
            "o AS (SELECT k.test, k.arguments, k.units, coalesce(CAST(p.v AS DOUBLE), "
            f"{nan}) AS {a}, coalesce(CAST(f.v AS DOUBLE), {nan}) AS {b} FROM kept k "
            "LEFT JOIN fv p ON p.path = k.fps AND p.test = k.test AND p.arguments = k.arguments AND p.units = k.units "
            "LEFT JOIN fv f ON f.path = k.fpf AND f.test = k.test AND f.arguments = k.arguments AND f.units = k.units) "
            f"SELECT test, arguments, units, {a}, {b}, {ratio(a, b)} AS power_perf, {ratio(b, a)} AS perf_power, "
            f"{ratio(f'({a} - {b})', a)} AS power_perf_power, {ratio(f'({b} - {a})', b)} AS perf_power_perf FROM o")


@register("run_power_comparison", _comparison_sql())
def q_power_comparison(spark, sf_dir):
    """RUN4 / JOIN5-7 / FN10: powersave vs performance results per benchmark."""
    lines, docs = _run_logs(spark, sf_dir)
    return _runs.power_comparison(lines, docs)


@register("run_scatter", (
    f"WITH s AS ({_summary_sql()}) SELECT CAST(row_number() OVER (ORDER BY fname) - 1 AS DOUBLE) AS x, "
    "total_joules AS y FROM s"))
def q_scatter(spark, sf_dir):
    """RUN5: scatter projection of two run-table columns (row position vs total energy)."""
    lines, docs = _run_logs(spark, sf_dir)
    return _fo.scatter(_runs.traces_summary(lines, docs), "index", "total_joules")


# --------------------------------------------------------------------- streaming


@register("run_table_stream", _summary_sql())
def q_run_stream(spark, sf_dir):
    """STR1 / STR2 / SET4: the traces summary built by micro-batches of run paths
    (file-source stream + foreachBatch append); the final state equals the batch table."""
    lines, docs = _run_logs(spark, sf_dir)
    return run_table_stream_from_logs(spark, lines, docs, batches=4)


# --------------------------------------------------------------------- sources and sinks (round trips)


@register("archive_roundtrip", _with() + "SELECT idx, timestamp, cpu, event FROM trace")
def q_archive(spark, sf_dir):
    """SRC1 / SRC2 / SNK2: trace written as npz-column archives (one per task)
    and read back with a column selection."""
    d = scratch_dir(spark, "archives")
    _archive.write_trace_archives(load_trace(spark, sf_dir), d).collect()
    t = _archive.read_trace_archives(spark, d, only=["timestamp", "cpu", "event"])
    return t.select("idx", "timestamp", "cpu", F.col("event").cast("int").alias("event"))


@register("archive_split", QUERIES["archive_roundtrip"][1])
def q_archive_split(spark, sf_dir):
    """SRC1: archives of stored members, each read in parts by several tasks."""
    d = scratch_dir(spark, "archivesplit")
    _archive.write_trace_archives(load_trace(spark, sf_dir), d, compressed=False).collect()
    t = _archive.read_trace_archives(spark, d, only=["timestamp", "cpu", "event"], split_bytes=1 << 16)
    return t.select("idx", "timestamp", "cpu", F.col("event").cast("int").alias("event"))


@register("raw_roundtrip", _with() + f"SELECT {TRACE_COLS} FROM trace")
def q_raw(spark, sf_dir):
    """SRC4 / SRC5 / SET3: per-CPU 24-byte record files, merged and renumbered."""
    d = scratch_dir(spark, "raw")
    _raw.write_raw_files(load_trace(spark, sf_dir), d).collect()
    return _raw.read_raw_trace(spark, d)


@register("raw_merged", _with() + f"SELECT {TRACE_COLS} FROM trace")
def q_raw_merged(spark, sf_dir):
    """SRC5: per-CPU record files in time order, merged and numbered by range without a shuffle."""
    d = scratch_dir(spark, "rawmerge")
    _raw.write_raw_files(load_trace(spark, sf_dir), d).collect()
    return _raw_merge.read_raw_merged(spark, d, records_per_range=1 << 20)


@register("dictionary_files", VARS_SQL)
def q_dictionary(spark, sf_dir):
    """SRC6 / SRC7 / SRC8: dictionary text files (old and new name) merged over
    the defaults; parsing stops at the first empty line."""
    d = scratch_dir(spark, "dict")
    ev = load_events(spark, sf_dir).select("event_type").distinct()
    code = F.lit(OTHER_EVENT_CODE)
    for t, c in reversed(list(EVENT_CODE_BY_TYPE.items())):
        code = F.when(F.col("event_type") == t, F.lit(c)).otherwise(code)
    lines = ev.select(F.concat(code.cast("string"), F.lit(" "), F.upper("event_type")).alias("l"))
    # the newer file: the events' own names, then an empty line and junk that must be ignored
    body = lines.agg(F.concat_ws("\n", F.array_sort(F.collect_list("l"))).alias("value"))
    body.select(F.concat("value", F.lit("\n\n99 IGNORED_AFTER_BLANK\n")).alias("value")) \
        .coalesce(1).write.text(_os.path.join(d, "new"))
    # the older file: a stale code for SIGNUP that the newer file overrides
    spark.createDataFrame([("7 SIGNUP\n",)], "value string").write.text(_os.path.join(d, "old"))
    table = _dictionary.dictionary_table(spark, [_os.path.join(d, "old"), _os.path.join(d, "new")])
    return table


@register("process_list", (
    "SELECT CAST(user_id AS VARCHAR) AS PID, 'u' || CAST(user_id % 7 AS VARCHAR) AS \"USER\", "
    "'cmd ' || event_type || ' --k ' || json_extract_string(props, '$.k') AS COMMAND FROM events"))
def q_process_list(spark, sf_dir):
    """SRC16: whitespace table whose last column keeps the rest of the line."""
    d = scratch_dir(spark, "ps")
    ev = load_events(spark, sf_dir)
    rows = ev.select(F.format_string("%6d  u%d   cmd %s --k %s", F.col("user_id"), F.col("user_id") % 7,
                                     F.col("event_type"), F.get_json_object("props", "$.k")).alias("value"))
    # one folder, the header in its first file
    spark.createDataFrame([("  PID USER   COMMAND",)], "value string").coalesce(1).write.text(_os.path.join(d, "0"))
    rows.write.text(_os.path.join(d, "1"))
    d = _os.path.join(d, "*")
    return _text.read_process_list(spark, d)


@register("nested_flatten", "SELECT event_id AS \"e/id\", value AS \"m/v/value\", user_id AS \"m/v/user\", "
                            "event_type AS \"m/type\" FROM events")
def q_flatten(spark, sf_dir):
    """SRC15: nested struct columns flattened to leaf paths."""
    ev = load_events(spark, sf_dir)
    nested = ev.select(F.struct(F.col("event_id").alias("id")).alias("e"),
                       F.struct(F.struct(F.col("value").alias("value"), F.col("user_id").alias("user")).alias("v"),
                                F.col("event_type").alias("type")).alias("m"))
    return _text.flatten(nested)


@register("run_table_saved", _summary_sql())
def q_run_saved(spark, sf_dir):
    """SNK1 / SRC14: run table saved uncompressed and loaded back."""
    lines, docs = _run_logs(spark, sf_dir)
    d = scratch_dir(spark, "runtable")
    _sinks.save_run_table(_runs.traces_summary(lines, docs), d)
    return _sinks.load_run_table(spark, d)


@register("side_column", QUERIES["prv_frq"][1])
def q_side(spark, sf_dir):
    """SNK3: a computed column persisted keyed by idx and joined back on read."""
    d = scratch_dir(spark, "side")
    trace = load_trace(spark, sf_dir)
    _sinks.write_trace(trace, _os.path.join(d, "trace"))
    stored = spark.read.parquet(_os.path.join(d, "trace"))
    _sinks.write_side_column(with_computed(stored, ["prv_frq_on_same_cpu"]), "prv_frq_on_same_cpu",
                             _os.path.join(d, "side"))
    df = _sinks.read_with_side_columns(spark, _os.path.join(d, "trace"), _os.path.join(d, "side"),
                                       ["prv_frq_on_same_cpu"])
    return df.select("idx", "prv_frq_on_same_cpu")


@register("side_column_bucketed", _with() + (
    f"SELECT idx, cpu, {oracle.computed_sql('prv_frq_on_same_cpu', DEFAULT_VARS)} AS prv_frq_on_same_cpu, "
    "timestamp * 2 AS twice FROM trace"))
def q_side_bucketed(spark, sf_dir):
    """SNK3 / JOIN9: two columns added to a bucketed trace, joined back without exchange or sort."""
    d = scratch_dir(spark, "sidebuckets")
    _side.write_side_trace(load_trace(spark, sf_dir), d)
    stored = _side.read_side_trace(spark, d)
    _side.add_side_column(with_computed(stored, ["prv_frq_on_same_cpu"]), "prv_frq_on_same_cpu", d)
    _side.add_side_column(stored.withColumn("twice", F.col("timestamp") * 2), "twice", d)
    return _side.read_side_trace(spark, d, ["cpu"], ["prv_frq_on_same_cpu", "twice"])


@register("result_cache", RQ_SQL)
def q_cache(spark, sf_dir):
    """SNK4: frame cached under sha256(trace path + config) and read back."""
    d = scratch_dir(spark, "cache")
    frame = _frame(spark, sf_dir, "run_queue")
    spec = RECIPES["run_queue"]()
    _sinks.cache_put(d, sf_dir, spec, frame, {"len": 0})
    got = _sinks.cache_get(spark, d, sf_dir, spec)
    return got[0]


def _ingest_sql():
    nxt = oracle.computed_sql("nxt_timestamp_of_same_evt_on_same_cpu", DEFAULT_VARS)
    bw = oracle.computed_sql("nxt_blk_wkp_of_same_pid", DEFAULT_VARS)
    pf = oracle.computed_sql("prv_frq_on_same_cpu", DEFAULT_VARS)
    comm = QUERIES["comm"][1].split(" SELECT y.idx,")[0]
    return (f"{comm}, z AS (SELECT y.idx, CAST(coalesce(d.comm_id, 0) AS BIGINT) AS comm FROM y "
            "LEFT JOIN d ON d.addr = y.last_exec.a) "
            f", c AS (SELECT idx, timestamp, {nxt} AS nxt_timestamp_of_same_evt_on_same_cpu, "
            f"{bw} AS nxt_blk_wkp_of_same_pid, {pf} AS prv_frq_on_same_cpu FROM trace) "
            "SELECT c.idx, c.timestamp, z.comm, c.nxt_timestamp_of_same_evt_on_same_cpu, c.nxt_blk_wkp_of_same_pid, "
            "c.prv_frq_on_same_cpu FROM c JOIN z ON z.idx = c.idx")


@register("ingest_raw", _ingest_sql())
def q_ingest(spark, sf_dir):
    """SNK5: raw ring buffers -> enriched trace (comm, next/previous columns)."""
    d = scratch_dir(spark, "ingest")
    _raw.write_raw_files(load_trace(spark, sf_dir), _os.path.join(d, "raw")).collect()
    out = ingest_raw(spark, _os.path.join(d, "raw"), _os.path.join(d, "out"))
    return spark.read.parquet(out).select("idx", "timestamp", "comm", *INGEST_COLUMNS)


# --------------------------------------------------------------------- scalar aggregates

@register("trace_count", _with() + "SELECT CAST(count(*) AS BIGINT) AS n FROM trace")
def q_count(spark, sf_dir):
    """AGG3: number of records in the trace."""
    return load_trace(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@register("first_timestamp", _with() + (
    "SELECT arg_min(timestamp, idx) AS t0_first, min(timestamp) AS t0_min FROM trace"))
def q_first_ts(spark, sf_dir):
    """AGG13: timestamp of the first row and the minimum timestamp (one pass)."""
    return load_trace(spark, sf_dir).agg(F.min_by("timestamp", "idx").alias("t0_first"),
                                         F.min("timestamp").alias("t0_min"))


@register("distinct_events", _with("trace18") + "SELECT DISTINCT event FROM trace ORDER BY event")
def q_distinct_events(spark, sf_dir):
    """AGG11: sorted distinct event codes."""
    return load_trace(spark, sf_dir, "trace18").select("event").distinct().orderBy("event")


@register("interactive_raster_points", (
    f"WITH f AS (SELECT * FROM ({FP_SQL}) f0 WHERE y > 250000), r AS (SELECT {PT_RANGES} FROM f) "
    f"SELECT CAST({_pix_sql('x', 'xmin', 'xmax', 48)} AS INTEGER) AS px, "
    f"CAST({_pix_sql('y', 'ymin', 'ymax', 24)} AS INTEGER) AS py, CAST(c AS INTEGER) AS c, count(*) AS n "
    "FROM f, r WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY 1, 2, 3"))
def q_interactive_raster(spark, sf_dir):
    """Interactive update (EXP16 -> AGG6 -> AGG7): raster of the query result over its fitted range."""
    view = _fo.interactive_view(_frame(spark, sf_dir, "freq_points"), "y > 250000", TEST_VARS, 48, 24)
    return view.raster


# --------------------------------------------------------------------- run archives

RUN_HEAD = "runs/BENCH=phoronix/POWER=powersave-y/MONITORING=cpu-energy-meter/PHORONIX="
ODD_RUNS = [RUN_HEAD + f"{n}/k0/1.tar" for n in ("none", "broken", "twice")]


def _run_archives(spark, sf_dir) -> str:
    """Archives of the derived runs, one without logs (a foreign member only),
    one that is no tar, one with two members of one name."""
    d = scratch_dir(spark, "run-archives")
    lines, docs = _run_logs(spark, sf_dir)
    per_run = F.to_json(F.struct(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("doc_no", F.from_json("doc", _runs.RESULT_SCHEMA)["results"].alias("r")))),
        lambda x: x["r"])).alias("results")))
    merged = docs.where("member = 'phoronix.json'").groupBy("path").agg(per_run.alias("doc"))
    docs = docs.where("member <> 'phoronix.json'").unionByName(
        merged.select("path", F.lit("phoronix.json").alias("member"), F.lit(0).cast("bigint").alias("doc_no"), "doc"))
    _runlogs.write_run_archives(lines, docs, d).count()
    put = lambda n, data: _raw.put_file(f"{d.rstrip('/')}/{ODD_RUNS[n]}", data)
    put(0, _runlogs.run_archive_bytes([("other.txt", "1.00")]))
    put(1, b"this is no archive " * 100)
    put(2, _runlogs.run_archive_bytes([("a/time.err", "no number\n1.50"), ("b/time.err", "2.50")]))
    return d


def _archive_summary_sql():
    odd = ", ".join(f"('{p}')" for p in ODD_RUNS)
    return (_summary_sql()
            .replace("idx AS (SELECT DISTINCT path FROM ev", f"idx AS (SELECT * FROM (VALUES {odd}) o(path) UNION SELECT DISTINCT path FROM ev")
            .replace("END AS line FROM ev), ", f"END AS line FROM ev UNION ALL SELECT '{ODD_RUNS[2]}', 'time.err', 1, '1.50'), "))


@register("run_archives_summary", _archive_summary_sql())
def q_run_archives(spark, sf_dir):
    """RUN1 / RUN3 / SRC9 / SRC10 / SRC11: the summary from archive files, a row for every file."""
    lines, docs, files = _runlogs.read_run_archives(spark, _run_archives(spark, sf_dir))
    table = _runs.traces_summary(lines, docs, runs=files)
    return table.withColumn("fname", F.regexp_replace("fname", "^.*/runs/BENCH", "runs/BENCH"))


@register("run_archives_stream", _archive_summary_sql())
def q_run_archives_stream(spark, sf_dir):
    """STR1 / STR2 over archives: micro-batches of new files, each opened once; equals the batch table."""
    base, files = scratch_dir(spark, "archivestream"), _run_archives(spark, sf_dir)
    most = -(-len(_runlogs.new_archives(files, f"{base}/none")) // 3)  # three batches
    table = stream_run_archives(spark, files, f"{base}/out", f"{base}/checkpoint", files_per_trigger=most)
    return table.withColumn("fname", F.regexp_replace("fname", "^.*/runs/BENCH", "runs/BENCH"))


@register("run_files", (
    f"WITH {RUN_LOG_CTES} SELECT path, split_part(path, '/', -1) AS name, '.tar' AS ext FROM idx WHERE path LIKE '%POWER=powersave-y%' "
    "UNION SELECT * FROM (VALUES " + ", ".join(f"('{p}', '1.tar', '.tar')" for p in ODD_RUNS) + ")"))
def q_run_files(spark, sf_dir):
    """SRC11 / SRC12 / FN5: archive files by extension and path pattern, with name and extension."""
    found = _runlogs.list_files(spark, _run_archives(spark, sf_dir), ".tar", ".*POWER=powersave-y/.*")
    return found.select(F.regexp_replace("path", "^.*/runs/BENCH", "runs/BENCH").alias("path"), "name", _extension(F.col("path")).alias("ext"))


@register("archive_preview", (
    f"WITH {RUN_LOG_CTES}, t AS (SELECT path, member, string_agg(line, chr(10) ORDER BY line_no) AS body FROM lines "
    "WHERE path IN (SELECT path FROM idx) GROUP BY path, member) "
    "SELECT path, 'logs/' || member AS member, CAST(octet_length(encode(body)) AS BIGINT) AS length, substr(body, 1, 64) AS text FROM t "
    f"UNION ALL SELECT * FROM (VALUES ('{ODD_RUNS[0]}', 'other.txt', 4, '1.00'))"))
def q_archive_preview(spark, sf_dir):
    """SRC13: text members of the run archives with length and head."""
    d = _run_archives(spark, sf_dir)
    _raw.put_file(f"{d.rstrip('/')}/{ODD_RUNS[1]}", _runlogs.run_archive_bytes([]))
    _raw.put_file(f"{d.rstrip('/')}/{ODD_RUNS[2]}", _runlogs.run_archive_bytes([]))
    got = _text.preview_archives(spark, d, 64).where("member not like '%.json'")
    return got.withColumn("path", F.regexp_replace("path", "^.*/runs/BENCH", "runs/BENCH"))


@register("archive_union", _with() + (
    "SELECT idx, CASE WHEN idx % 2 = 1 THEN arg0 END AS arg0, CASE WHEN idx % 2 = 1 THEN CAST(arg1 AS DOUBLE) ELSE arg1 + 0.5 END AS arg1 FROM trace"))
def q_archive_union(spark, sf_dir):
    """SRC1: archives with different columns and types give the union of both."""
    d = scratch_dir(spark, "archives")
    trace = load_trace(spark, sf_dir)
    _archive.write_trace_archives(trace.where("idx % 2 = 1").select("idx", "arg0", "arg1"), _os.path.join(d, "b")).collect()
    _archive.write_trace_archives(trace.where("idx % 2 = 0").select("idx", (F.col("arg1") + F.lit(0.5).cast("double")).alias("arg1")), _os.path.join(d, "a")).collect()
    return _archive.read_trace_archives(spark, d).select("idx", "arg0", "arg1")


# --------------------------------------------------------------------- spec forms and extension points

FORMS_SPEC = {
    "input": ["timestamp", "cpu", "event", "arg0", "arg1"], "output": ["x", "y", "c"],
    "c": [{"label": "two pipelines", "color": "#000000", "concatenate": [
        [["query", "event == $TICK"], ["=", "x", "timestamp"], ["=", "y", ["/", "arg1", ["+", "arg0", 1], 2.0]]],
        [["query", "event == $BLOCK & arg0 > 0"], ["=", "x", ["-", ["+", "timestamp", 1], "cpu"]], ["=", "y", ["/", "arg1", "arg0"]]]]}]}


@register("spec_forms", oracle.spec_sql(FORMS_SPEC, TEST_VARS))
def q_spec_forms(spark, sf_dir):
    """SET1 / EXP8 / EXP9: two pipelines in a category, n-ary division, nested steps."""
    return build_frame(load_trace(spark, sf_dir), FORMS_SPEC, TEST_VARS)


@register("query_modulo", _with() + (
    "SELECT idx FROM trace WHERE arg0 <> 0 AND idx % arg0 = 1"))
def q_modulo(spark, sf_dir):
    """EXP1: remainder with a divisor that is sometimes zero."""
    from ..functions.expr import compile_query, env_of
    t = load_trace(spark, sf_dir)
    return t.where(compile_query("idx % arg0 == 1", env_of(t))).select("idx")


@register("query_modulo_negative", _with() + "SELECT idx FROM trace WHERE arg0 > 0 AND idx % arg0 <> 0 AND (idx % arg0) - arg0 = -1")
def q_modulo_negative(spark, sf_dir):
    """EXP1: the remainder has the divisor's sign."""
    from ..functions.expr import compile_query, env_of
    t = load_trace(spark, sf_dir)
    return t.where(compile_query("arg0 > 0 & idx % (0 - arg0) == 0 - 1", env_of(t))).select("idx")


@register("stored_column", _with() + "SELECT idx, CAST(7 AS BIGINT) AS addr FROM trace")
def q_stored_column(spark, sf_dir):
    """SRC3: a computed column that is stored already is kept as it is."""
    t = load_trace(spark, sf_dir).withColumn("addr", F.lit(7).cast("bigint"))
    return with_computed(t, ["addr"], TEST_VARS).select("idx", "addr")


@register("clamped_ranges", (
    f"WITH f AS ({RQ_SQL}), r AS (SELECT {SEG_RANGES}, count(DISTINCT y0) AS lanes FROM f) "
    "SELECT xmin, xmax, greatest(ymin, -1.0) AS ymin, least(ymax, CAST(lanes + 1 AS DOUBLE)) AS ymax FROM r"))
def q_clamped(spark, sf_dir):
    """EXP20: the data range with its lanes clamped."""
    frame = _shared_frame(spark, sf_dir, "run_queue")
    n = _fo.lanes(frame).first()["lanes"]
    return _fo.clamp_ranges(_fo.data_ranges(frame).withColumn("lanes", F.lit(n))).select("xmin", "xmax", "ymin", "ymax")


@register("declared_run_table", (
    f"WITH {RUN_LOG_CTES}, l AS (SELECT path, count(*) AS n FROM lines GROUP BY path) SELECT idx.path AS fname, "
    "CAST(l.n AS DOUBLE) AS lines, CASE WHEN l.n > 10 THEN 'long' ELSE '(NULL)' END AS size, CAST(l.n AS DOUBLE) * 2 AS twice "
    "FROM idx JOIN l ON l.path = idx.path"))
def q_declared(spark, sf_dir):
    """RUN2 / UDF1 / EXP24: a table declared column by column, appended to the empty table of its schema."""
    lines, _ = _run_logs(spark, sf_dir)
    index = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    table = (_runs.RunTable(index).add_column("fname", _runs.STRING, lambda d: F.col("path"))
             .add_column("lines", _runs.FLOAT, lambda d: F.col("n"))
             .add_column("size", _runs.STRING, lambda d: F.when(F.col("n") > 10, "long"))
             .add_column("twice", _runs.FLOAT, lambda d: F.col("lines") * 2))
    empty = _runs.empty_run_table(spark, [_runs.RunColumn("fname", _runs.STRING), _runs.RunColumn("lines", _runs.FLOAT),
                                          _runs.RunColumn("size", _runs.STRING), _runs.RunColumn("twice", _runs.FLOAT)])
    return empty.unionByName(table.build())


@register("run_functions", (
    f"WITH {RUN_LOG_CTES}, l AS (SELECT path, count(*) AS n FROM lines GROUP BY path), "
    "r AS (SELECT path, n, CASE WHEN n % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 100.0 / (n % 3) END AS ratio FROM l) "
    "SELECT path AS fname, regexp_extract(path, 'PHORONIX=([^/]*)', 1) AS bench, ratio, "
    "CASE n % 3 WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'none' END AS label, ratio * 2 AS twice, "
    "ratio * 2 + 1 AS more, CAST(CASE WHEN n % 3 = 0 THEN 2 ELSE 0 END AS DOUBLE) AS failed FROM r"))
def q_run_functions(spark, sf_dir):
    """UDF1 / EXP23: functions of a row, some of which fail on some rows, between Column builders."""
    lines, _ = _run_logs(spark, sf_dir)
    index = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    table = (_runs.RunTable(index)
             .add_function("fname", _runs.STRING, lambda index, row: index["path"])
             .add_function("bench", _runs.STRING, lambda index, row: row["fname"].split("PHORONIX=")[1].split("/")[0])
             .add_function("ratio", _runs.FLOAT, lambda index, row: 100 / (index["n"] % 3))
             .add_function("label", _runs.STRING, lambda index, row: {100.0: "one", 50.0: "two"}[row["ratio"]], default="none")
             .add_column("twice", _runs.FLOAT, lambda d: F.col("ratio") * 2)
             .add_function("more", _runs.FLOAT, lambda index, row: row["twice"] + 1))
    return table.build(errors="errors").select(*table.columns_name(), F.size("errors").cast("double").alias("failed"))


@register("extension_points", _with() + (
    "SELECT idx, timestamp * 10 AS ts_x10, least(arg1, CAST(1000 AS BIGINT)) AS y FROM trace"))
def q_extensions(spark, sf_dir):
    """UDF2 / UDF4: a registered computed column and a registered step operator."""
    from ..functions import expr as _expr
    from ..operators import computed as _computed
    if "q_ts_x10" not in _computed.REGISTRY:
        _computed.register_computed("q_ts_x10", ["timestamp"], lambda df, v: df.withColumn("q_ts_x10", F.col("timestamp") * 10))
    _expr.register_step_operator("q_least", lambda a: _expr.TCol(F.least(a[0].col, a[1].col), a[0].kind))
    t = with_computed(load_trace(spark, sf_dir), ["q_ts_x10"], TEST_VARS)
    y = _expr.compile_step(["q_least", "arg1", 1000], _expr.env_of(t))
    return t.select("idx", F.col("q_ts_x10").alias("ts_x10"), y.col.alias("y"))


@register("query_listener", f"SELECT c, CAST(count(*) AS BIGINT) AS n FROM ({RQ_SQL}) f WHERE arg0 >= 2 GROUP BY c")
def q_listener(spark, sf_dir):
    """UDF5: a listener that derives statistics from each applied query."""
    seen: list = []
    _fo.apply_query(_shared_frame(spark, sf_dir, "run_queue"), "arg0 >= 2", TEST_VARS,
                    listeners=[lambda r: seen.append(r.frame.groupBy("c").agg(F.count(F.lit(1)).alias("n")))])
    return seen[0]


@register("extra_dictionary_reader", (
    VARS_SQL.replace("SELECT '$' || key AS key, arg_max(value, pr) AS value FROM u GROUP BY key",
                     "SELECT '$' || key AS key, CASE WHEN key = 'SIGNUP' THEN '77' ELSE arg_max(value, pr) END AS value FROM u GROUP BY key")))
def q_extra_reader(spark, sf_dir):
    """UDF3 / SRC6: an extra dictionary reader overrides the file; of two lines of a name the last counts."""
    d = scratch_dir(spark, "dict")
    ev = load_events(spark, sf_dir).select("event_type").distinct()
    code = F.lit(OTHER_EVENT_CODE)
    for t, c in reversed(list(EVENT_CODE_BY_TYPE.items())):
        code = F.when(F.col("event_type") == t, F.lit(c)).otherwise(code)
    lines = ev.select(F.explode(F.array(F.concat(F.lit("98 "), F.upper("event_type")), F.concat(code.cast("string"), F.lit(" "), F.upper("event_type")))).alias("l"))
    body = lines.agg(F.concat_ws("\n", F.sort_array(F.collect_list("l"), asc=False)).alias("value"))
    body.coalesce(1).write.text(d)
    reader = lambda s, p, i: s.createDataFrame([("SIGNUP", "77", i)], "key string, value string, priority int")
    _dictionary.register_reader(reader)
    try:
        return _dictionary.dictionary_table(spark, [d])
    finally:
        _dictionary.READERS.remove(reader)
