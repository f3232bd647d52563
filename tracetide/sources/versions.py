"""Versioned folders on the shared file system, published in two steps.

A writer fills a folder of its own under ``<base>/versions/`` and then creates one empty
file of the same name under ``<base>/published/``. A reader looks at published names only,
so what a lost driver left half written is never seen, and what a reader has opened is never
overwritten. Names begin with the time of writing: the last one is the newest.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_version(base: str) -> tuple:
    """(name, folder) of a version that nobody sees yet."""
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    return name, version_folder(base, name)


def version_folder(base: str, name: str) -> str:
    return os.path.join(base, "versions", name)


def publish(spark: SparkSession, base: str, name: str) -> None:
    fs, where = _path(spark, os.path.join(base, "published", name))
    fs.create(where, False).close()


def published(spark: SparkSession, base: str) -> list:
    """Names of the published versions, oldest first; none if the folder is missing.

    Every other error (no permission, a file system that does not answer) is raised.
    """
    fs, where = _path(spark, os.path.join(base, "published"))
    if not fs.exists(where):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(where))


def delete_superseded(spark: SparkSession, base: str) -> int:
    """Delete all published versions but the newest; for times when nobody reads them."""
    old = published(spark, base)[:-1]
    for name in old:
        for path in (os.path.join(base, "published", name), version_folder(base, name)):
            fs, where = _path(spark, path)
            fs.delete(where, True)
    return len(old)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modificationTime`` of every file below ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path) \
        .select("path", "length", "modificationTime")


def snapshot(spark: SparkSession, path: str) -> str:
    """State of the files below ``path``: changes with any name, length or time of change.

    One aggregate of fixed size (number, bytes, exclusive or of SHA-256 sums), whatever the number of files.
    """
    digest = F.sha2(F.concat_ws("\n", "path", F.col("length").cast("string"),
                                F.unix_micros("modificationTime").cast("string")), 256)
    parts = [F.bit_xor(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long")).alias(f"p{i}") for i in range(4)]
    row = files_of(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), *parts).first()
    return ":".join(str(v) for v in row)
