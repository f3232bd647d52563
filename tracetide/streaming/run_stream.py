"""Micro-batch run-table build (STR1, STR2, SET4).

The run index (one row per run path) is written as files; a Structured
Streaming file source reads it ``files_per_trigger`` files at a time, each
micro-batch computes the full run-table rows of its paths (joined with the
static run logs) and appends them to a parquet sink.  The checkpoint makes
the build restartable: a lost driver or executor resumes at the last
committed batch, and each epoch overwrites its own output folder, so a
replayed batch never duplicates rows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..config import ensure_checkpoint_dir
from ..plans import runs
from ..sources import runlogs


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tracetide", f"{name}-{uuid.uuid4().hex}")


def write_index(index: DataFrame, directory: str, files: int) -> str:
    index.repartition(files, "path").write.mode("overwrite").parquet(directory)
    return directory


def stream_run_table(spark: SparkSession, run_lines: DataFrame, run_docs: DataFrame,
                     index_dir: str, out_dir: str, checkpoint: str,
                     files_per_trigger: int = 1, callback=None) -> DataFrame:
    """Build the traces summary batch by batch; returns the final table."""
    schema = spark.read.parquet(index_dir).schema

    def on_batch(batch: DataFrame, epoch: int) -> None:
        lines = run_lines.join(batch, "path", "left_semi")
        docs = run_docs.join(batch, "path", "left_semi")
        rows = runs.traces_summary(lines, docs)
        # one folder per epoch, overwritten on replay: a batch re-run after a
        # failure replaces its own rows instead of appending duplicates
        rows.write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={epoch}"))
        if callback is not None:
            callback(spark.read.parquet(out_dir).drop("epoch"), epoch)

    query = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
                  .parquet(index_dir)
                  .writeStream.foreachBatch(on_batch)
                  .option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True)
                  .start())
    query.awaitTermination()
    return spark.read.parquet(out_dir).drop("epoch")


def run_table_stream_from_logs(spark: SparkSession, run_lines: DataFrame, run_docs: DataFrame,
                               batches: int = 4) -> DataFrame:
    base = scratch_dir(spark, "runstream")
    index = runs.run_index(run_lines, run_docs)
    index_dir = write_index(index, os.path.join(base, "index"), batches)
    return stream_run_table(spark, run_lines, run_docs, index_dir, os.path.join(base, "out"),
                            os.path.join(base, "checkpoint"))


def stream_run_archives(spark: SparkSession, directory: str, out_dir: str, checkpoint: str, files_per_trigger: int = 0,
                        callback=None, text_members=runlogs.TEXT_MEMBERS, json_members=runlogs.JSON_MEMBERS) -> DataFrame:
    """The traces summary of a folder of run archives, batch by batch of new files; returns the table so far.

    Each batch opens its own archives only, and each of them once.  The files seen stand in
    ``<checkpoint>/seen``, so a later call goes on where this one ended and a batch
    that failed is run again with the same files.  Takes up to ``files_per_trigger`` files a batch
    (0: all there are), until no new ones are left.
    """
    spark.dataSource.register(runlogs.RunArchiveDataSource)
    seen = f"{checkpoint.rstrip('/')}/seen"

    def on_batch(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()  # read once; the lines, the documents and the files are parts of it
        try:
            lines, docs, files = runlogs.split_run_rows(batch)
            runs.traces_summary(lines, docs, runs=files).write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={epoch}"))
        finally:
            batch.unpersist()
        if callback is not None:
            callback(spark.read.parquet(out_dir).drop("epoch"), epoch)

    while True:
        source = (spark.readStream.format("tracetide_runs").option("seenLog", seen).option("filesPerTrigger", files_per_trigger)
                       .options(**runlogs.member_options(text_members, json_members)).load(directory))
        query = source.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{checkpoint.rstrip('/')}/query").trigger(availableNow=True).start()
        query.awaitTermination()
        if not runlogs.new_archives(directory, seen):
            return spark.read.parquet(out_dir).drop("epoch")
