"""SNK3 / JOIN9: a stored trace that grows by columns without being rewritten or shuffled.

The trace and every side column have one layout: rows are cut into blocks of ``idx`` (a block is
a range), blocks are hashed into buckets, and a bucket is one file sorted by (block, idx). Reading
joins them bucket by bucket: no exchange and no sort on any side, however many columns were added.
A block keeps rows of neighbouring idx together, so row-group statistics on idx and
timestamp still let a scan skip data.

Layout of a folder: ``trace/`` and ``columns/<name>/``, each of published versions (see
``versions``), so a column that is written again replaces the old one as a whole, and a half-written
one is not seen. ``idx`` must be unique within the trace; rows without idx keep null side columns.
Column names with ``/`` are not allowed, and ``__block`` is taken by the layout.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import conf_int
from .versions import new_version, publish, published, version_folder

BLOCK = "__block"
BLOCKS_PER_BUCKET = 16
DATA, LAYOUT = "data", "layout"


def _table(version: str) -> str:
    return "tracetide_" + version.replace("-", "_")


def _with_block(df: DataFrame, block_rows: int) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col("idx") / F.lit(block_rows)).cast("long"))


def _write(df: DataFrame, base: str, layout: dict) -> None:
    spark = df.sparkSession
    version, folder = new_version(base)
    buckets = layout["buckets"]
    # one task a bucket (the same hash as the bucket's), so one sorted file a bucket
    rows = _with_block(df, layout["block_rows"]).repartition(buckets, BLOCK)
    rows.write.bucketBy(buckets, BLOCK).sortBy(BLOCK, "idx").format("parquet") \
        .option("path", os.path.join(folder, DATA)).saveAsTable(_table(version))
    spark.createDataFrame([(json.dumps(layout),)], "layout string").coalesce(1).write.text(os.path.join(folder, LAYOUT))
    publish(spark, base, version)


def _layout(spark: SparkSession, base: str) -> tuple:
    names = published(spark, base)
    if not names:
        raise FileNotFoundError(base)
    folder = version_folder(base, names[-1])
    return names[-1], folder, json.loads(spark.read.text(os.path.join(folder, LAYOUT)).first()[0])


def _read(spark: SparkSession, base: str) -> tuple:
    """The newest version as a bucketed table; declared in this session if another one wrote it."""
    version, folder, layout = _layout(spark, base)
    table, data = _table(version), os.path.join(folder, DATA)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(data).schema)
        where = data.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({BLOCK}) "
                  f"SORTED BY ({BLOCK}, idx) INTO {layout['buckets']} BUCKETS LOCATION '{where}'")
    return spark.table(table), layout


def write_side_trace(df: DataFrame, root: str, bucket_rows: int | None = None) -> None:
    """Store a trace so that side columns can be joined to it without a shuffle.

    ``bucket_rows`` (default ``tracetide.block.rows``) bounds a bucket's rows in the mean; a bucket
    takes about 16 blocks.
    """
    if BLOCK in df.columns:
        raise ValueError(f"{BLOCK} is taken by the layout")
    spark = df.sparkSession
    rows = bucket_rows or conf_int(spark, "tracetide.block.rows")
    _write(df, os.path.join(root, "trace"),
           {"buckets": max(1, -(-df.count() // rows)), "block_rows": max(1, rows // BLOCKS_PER_BUCKET)})


def add_side_column(df: DataFrame, column: str, root: str) -> None:
    """SNK3: append one derived column of ``df`` (which holds ``idx``) to the trace stored at ``root``."""
    if "/" in column or column in (BLOCK, "idx"):
        raise ValueError(f"no side column can be named {column}")
    layout = _layout(df.sparkSession, os.path.join(root, "trace"))[2]
    _write(df.where(F.col("idx").isNotNull()).select("idx", F.col(f"`{column}`")), os.path.join(root, "columns", column), layout)


def read_side_trace(spark: SparkSession, root: str, columns: list | None = None, side: list = ()) -> DataFrame:
    """The stored trace with its side columns: no exchange and no sort.

    ``columns`` prunes the trace's own columns (default: all). Sets two options of the session:
    ``spark.sql.legacy.bucketedTableScan.outputOrdering`` lets Spark use the order of the files, and
    ``spark.sql.requireAllClusterKeysForCoPartition`` (off) lets rows hashed by block meet on (block, idx).
    """
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    df, layout = _read(spark, os.path.join(root, "trace"))
    if columns is not None:
        df = df.select(BLOCK, *dict.fromkeys(["idx", *columns]))
    for name in side:
        extra, its_layout = _read(spark, os.path.join(root, "columns", name))
        if its_layout != layout:
            raise ValueError(f"column {name} was written for another layout of the trace: write it again")
        df = df.join(extra, [BLOCK, "idx"], "left")
    return df.drop(BLOCK)
