"""Event dictionary ($NAME variables): defaults, merge and substitution."""

from __future__ import annotations

import copy
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 18 default event codes of a scheduler trace.
DEFAULT_VARS = {
    "EXEC": "0",
    "EXIT": "1",
    "WAKEUP": "2",
    "WAKEUP_NEW": "3",
    "BLOCK": "4",
    "BLOCK_IO": "5",
    "WAIT_FUTEX": "6",
    "WAKE_FUTEX": "7",
    "WAKER_FUTEX": "8",
    "FORK": "9",
    "TICK": "10",
    "CTX_SWITCH": "11",
    "MIGRATE": "12",
    "RQ_SIZE": "13",
    "IDL_BLN_FAIR_BEG": "14",
    "IDL_BLN_FAIR_END": "15",
    "PER_BLN_FAIR_BEG": "16",
    "PER_BLN_FAIR_END": "17",
}


def substitute(obj, variables: dict):
    """Strict ``$NAME`` substitution over dict values, lists and strings.

    Unknown names raise ``KeyError``; ``$$`` yields ``$``; dict keys are left
    alone.  Returns a new object (the input is not modified).
    """
    obj = copy.deepcopy(obj)

    def walk(o):
        if isinstance(o, dict):
            return {k: walk(v) for k, v in o.items()}
        if isinstance(o, list):
            return [walk(v) for v in o]
        if isinstance(o, str):
            return string.Template(o).substitute(**variables)
        return o

    return walk(obj)


def merge_vars(*sources: dict) -> dict:
    """Later sources override earlier ones (defaults first)."""
    out: dict = {}
    for s in sources:
        out.update({k: str(v) for k, v in s.items()})
    return out


def parse_dictionary_text(text: str) -> dict:
    """``"<id> <NAME>"`` per line, stopping at the first empty line."""
    out = {}
    for line in text.split("\n"):
        if len(line) == 0:
            break
        value, key = line.split(" ")
        out[key] = value
    return out


VARS_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
    T.StructField("priority", T.IntegerType(), False),
])


def vars_frame(spark: SparkSession, variables: dict, priority: int = 0) -> DataFrame:
    rows = [(k, str(v), priority) for k, v in variables.items()]
    return spark.createDataFrame(rows, VARS_SCHEMA)


def merge_vars_frames(*frames: DataFrame) -> DataFrame:
    """SRC8 as a data op: per name keep the value of the highest priority source."""
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    return (df.groupBy("key")
              .agg(F.max_by("value", "priority").alias("value"))
              .select(F.concat(F.lit("$"), F.col("key")).alias("key"), F.col("value")))
