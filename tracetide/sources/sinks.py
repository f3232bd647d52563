"""Parquet sinks: run tables, traces, side columns and the result cache."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vars import substitute
from .versions import new_version, publish, published, snapshot, version_folder


def save_run_table(df: DataFrame, path: str) -> None:
    """SNK1: uncompressed parquet."""
    df.write.mode("overwrite").option("compression", "none").parquet(path)


def load_run_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC14."""
    return spark.read.parquet(path)


def write_trace(df: DataFrame, path: str) -> None:
    """SNK2: a trace as parquet (one column per trace column)."""
    df.write.mode("overwrite").parquet(path)


def write_side_column(df: DataFrame, column: str, path: str) -> None:
    """SNK3: persist one derived column keyed by ``idx`` next to a stored trace."""
    df.select("idx", F.col(f"`{column}`")).write.mode("overwrite").parquet(os.path.join(path, column))


def read_with_side_columns(spark: SparkSession, trace_path: str, side_root: str, columns: list) -> DataFrame:
    """Join stored side columns back on ``idx`` (shuffle join, both sides keyed by idx)."""
    df = spark.read.parquet(trace_path)
    for c in columns:
        df = df.join(spark.read.parquet(os.path.join(side_root, c)), "idx", "left")
    return df


def cache_key(spark: SparkSession, trace_path: str, config: dict, variables: dict | None = None) -> str:
    """Key of the trace as its files are now and of the spec with its ``$NAME`` values filled in."""
    spec = json.dumps(config, sort_keys=True)
    if variables is not None:
        spec = substitute(spec, variables)
    state = snapshot(spark, trace_path)
    return hashlib.sha256(f"{len(trace_path)}:{trace_path}{state}\n{spec}".encode()).hexdigest()


def cache_put(root: str, trace_path: str, config: dict, frame: DataFrame, state: dict,
              variables: dict | None = None, key: str | None = None) -> str | None:
    """SNK4: frame parquet + JSON state under a key of (trace files, config, dictionary).

    The entry is published after frame and state are written. ``key``: a ``cache_key`` taken before
    the frame was built. Nothing is published, and None is returned, if the trace has changed since.
    """
    spark = frame.sparkSession
    key = key or cache_key(spark, trace_path, config, variables)
    base = os.path.join(root, key)
    name, folder = new_version(base)
    frame.write.parquet(os.path.join(folder, "frame"))
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(os.path.join(folder, "state"))
    if cache_key(spark, trace_path, config, variables) != key:
        return None
    publish(spark, base, name)
    return key


def cache_get(spark: SparkSession, root: str, trace_path: str, config: dict, variables: dict | None = None):
    """(frame, state) of the newest entry for the trace as it is now; None if there is none.

    A trace that was rewritten since, and an entry whose writer was lost, are misses. An entry that
    cannot be read is an error, not a miss.
    """
    base = os.path.join(root, cache_key(spark, trace_path, config, variables))
    names = published(spark, base)
    if not names:
        return None
    folder = version_folder(base, names[-1])
    frame = spark.read.parquet(os.path.join(folder, "frame")).withColumn("c", F.col("c").cast("int"))
    return frame, json.loads(spark.read.text(os.path.join(folder, "state")).first()[0])
