"""Event dictionaries (``"<id> <NAME>"`` per line, up to the first empty line)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vars import DEFAULT_VARS, merge_vars_frames, vars_frame



def read_dictionary(spark: SparkSession, path: str, priority: int = 1) -> DataFrame:
    """SRC6 / SRC7: ``(key, value, priority)`` from dictionary text files, one
    row for each name: the last line of a name wins (files in path order)."""
    docs = spark.read.text(path, wholetext=True).withColumn("_f", F.input_file_name())
    lines = docs.select("_f", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    stop = lines.where(F.length("line") == 0).groupBy("_f").agg(F.min("pos").alias("_stop"))
    kept = lines.join(stop, "_f", "left").where(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
    parts = F.split("line", " ")
    named = kept.select(parts[1].alias("key"), parts[0].alias("value"), F.struct("_f", "pos").alias("_at"))
    last = named.groupBy("key").agg(F.max_by("value", "_at").alias("value"))
    return last.select("key", "value", F.lit(priority).alias("priority"))


# UDF3: extra dictionary readers: fn(spark, path, priority) -> (key, value, priority)
READERS: list = []


def register_reader(fn) -> None:
    READERS.append(fn)


def dictionary_table(spark: SparkSession, paths: list) -> DataFrame:
    """SRC8: defaults, then each dictionary source in order (later overrides);
    within one source the last line of a name wins, and an extra reader
    (UDF3) overrides the file's own lines."""
    frames = [vars_frame(spark, DEFAULT_VARS, 0)]
    for i, p in enumerate(paths, start=1):
        found = [read_dictionary(spark, p, i)]
        for reader in READERS:
            try:
                found.append(reader(spark, p, i))
            except Exception:  # noqa: BLE001 - a failing reader contributes nothing
                pass
        d = reduce(DataFrame.unionByName, [f.withColumn("_n", F.lit(n)) for n, f in enumerate(found)])
        frames.append(d.groupBy("key", "priority").agg(F.max_by("value", "_n").alias("value"))
                       .select("key", "value", "priority"))
    return merge_vars_frames(*frames)


def vars_from_table(table: DataFrame) -> dict:
    """Driver-side dict for ``$NAME`` substitution (a dictionary is tiny)."""
    return {r["key"].lstrip("$"): r["value"] for r in table.collect()}


def dictionary_from_dir(spark: SparkSession, directory: str, file_names: list) -> DataFrame:
    """SRC6 + SRC7 + SRC8 for an unpacked trace folder.

    ``file_names``: the recorder's dictionary file names, oldest format first;
    a later file overrides an earlier one, all override the defaults.  Only
    file names are listed (contents are pruned)."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
                  .select("path").collect())
    paths = []
    for name in file_names:
        matches = sorted(r["path"] for r in found if r["path"].rsplit("/", 1)[-1] == name)
        if matches:
            paths.append(matches[0])  # the first file with that name wins
    return dictionary_table(spark, paths)
