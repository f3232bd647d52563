"""Session helpers and tunables.

Tunables are read from the Spark conf so a cluster job can size them
without code changes:

* ``tracetide.block.rows``     rows per idx block for keyed next/previous
  columns (block + carry keeps one hot key from landing in one task).
* ``tracetide.bucket.rows``    rows per range bucket for global positions.
* ``tracetide.rolling.block``  minimum rows per block for rolling windows.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "tracetide.block.rows": 1 << 22,
    "tracetide.bucket.rows": 20_000_000,
    "tracetide.rolling.block": 1 << 17,
}


def conf_int(spark: SparkSession, key: str) -> int:
    value = spark.conf.get(key, None)
    return int(value) if value not in (None, "") else int(DEFAULTS[key])


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "tracetide") -> SparkSession:
    """Session for local runs and tests; on a cluster use the provided one."""
    master = master or os.environ.get("TRACETIDE_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("TRACETIDE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRACETIDE_DRIVER_MEMORY", "12g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` (or an already set SparkContext checkpoint dir)
    wins; only when neither is set (local tests) a fresh scratch folder is
    created.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tracetide-ckpt-")
    sc.setCheckpointDir(local)
    return local


def materialize(df):
    """Cut the lineage of a frame that several actions will read.

    A reliable checkpoint into the shared checkpoint folder: the upstream
    (scans, window shuffles) runs once, and a lost executor re-reads the
    checkpoint files instead of recomputing the upstream.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
