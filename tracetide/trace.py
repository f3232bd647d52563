"""Trace schema, required columns and the mapping from the driver tables.

A trace carries an explicit ``idx`` (zero-based position in time order):
every positional operator uses it as identity and tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType(), False),
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("cpu", T.LongType(), False),
    T.StructField("pid", T.LongType(), False),
    T.StructField("event", T.IntegerType(), False),
    T.StructField("arg0", T.LongType(), False),
    T.StructField("arg1", T.LongType(), False),
])

REQUIRED_COLUMNS = ("timestamp", "pid", "event", "cpu", "arg0", "arg1")

# Event type of the driver's `events` table -> trace event code
# (signup=EXEC, click=WAKEUP, purchase=BLOCK, view=TICK, anything else=RQ_SIZE).
EVENT_CODE_BY_TYPE = {"signup": 0, "click": 2, "purchase": 4, "view": 10}
OTHER_EVENT_CODE = 13

# Extra dictionary entries for the load-balancing fixture (codes are our choice).
LB_EXTRA_VARS = {
    "IDL_BLN_IPA_BEG": "18",
    "IDL_BLN_IPA_END": "19",
    "PER_BLN_IPA_BEG": "20",
    "PER_BLN_IPA_END": "21",
}


def require_columns(df: DataFrame, columns=REQUIRED_COLUMNS) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"trace is missing mandatory columns {missing}")


def _event_code(event_type: Column) -> Column:
    # one flat CASE: Catalyst folds `event = k` into predicates on event_type
    expr = None
    for name, code in EVENT_CODE_BY_TYPE.items():
        expr = F.when(event_type == name, F.lit(code)) if expr is None else expr.when(event_type == name, F.lit(code))
    return expr.otherwise(F.lit(OTHER_EVENT_CODE))


def epoch_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970-01-01 00:00 UTC, independent of the session
    time zone: a wall-clock (NTZ) value is read as UTC."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(F.col(column).cast("timestamp"))


def trace_from_events(events: DataFrame, variant: str = "base") -> DataFrame:
    """Map the driver's ``events`` table onto a scheduler trace.

    ``variant``: ``base`` (5 event codes), ``trace18`` (all 18 default codes)
    or ``trace_lb`` (22 codes incl. the IPA balancing pairs).
    """
    user = F.col("user_id")
    if variant == "base":
        event = _event_code(F.col("event_type"))
    elif variant == "trace18":
        event = ((F.col("event_id") * 31 + user) % 18).cast("int")
    elif variant == "trace_lb":
        event = ((F.col("event_id") * 31 + user) % 22).cast("int")
    else:
        raise ValueError(f"unknown trace variant {variant!r}")
    return events.select(
        F.col("event_id").cast("bigint").alias("idx"),
        epoch_micros(events, "ts").alias("timestamp"),
        (user % 8).cast("bigint").alias("cpu"),
        user.cast("bigint").alias("pid"),
        event.alias("event"),
        (F.get_json_object("props", "$.k").cast("bigint") % 4).alias("arg0"),
        F.round(F.col("value") * 10000).cast("bigint").alias("arg1"),
    )


def spread_small_input(df: DataFrame) -> DataFrame:
    """An input with fewer scan splits than task slots (e.g. one parquet row
    group) would run every map-side operator in one task: spread it once,
    round-robin.  Inputs with enough splits (the cluster case) are untouched."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


REPLICATE_ID_STRIDE = 1 << 32
REPLICATE_TIME_STRIDE_US = 40 * 24 * 3600 * 1_000_000


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``events`` table.

    ``tracetide.fixture.replicate=k`` (scaling experiments only) appends k-1
    copies after the original, ids and times shifted, users unchanged, so
    every key group grows k-fold.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = spread_small_input(events)
    k = int(spark.conf.get("tracetide.fixture.replicate", "1") or 1)
    if k <= 1:
        return events
    rep = events.withColumn("_tt_copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rep.select(
        (F.col("event_id") + F.col("_tt_copy") * REPLICATE_ID_STRIDE).alias("event_id"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                          (F.col("_tt_copy") * (REPLICATE_TIME_STRIDE_US // 1_000_000)).cast("decimal(18,6)"))
         ).alias("ts"),
        "user_id", "event_type", "value", "props")


def load_trace(spark: SparkSession, sf_dir: str, variant: str = "base") -> DataFrame:
    return trace_from_events(load_events(spark, sf_dir), variant)


def read_trace(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """SRC2: read a stored trace, pruning to ``columns`` (+ idx)."""
    df = spark.read.parquet(path)
    require_columns(df)
    if columns:
        keep = ["idx"] + [c for c in columns if c != "idx"]
        df = df.select(*[F.col(f"`{c}`") for c in keep])
    return df


def with_addr(df: DataFrame, out: str = "addr") -> DataFrame:
    """CMP5: ``addr = (arg0 << 32) | arg1`` with arg1 sign-extended (as a long)."""
    return df.withColumn(
        out, F.shiftleft(F.col("arg0").cast("bigint"), 32).bitwiseOR(F.col("arg1").cast("bigint")))
