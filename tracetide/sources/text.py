"""Small text sources: file previews and whitespace process lists."""

from __future__ import annotations

import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import _list_archives, _open  # module-level: pickled by value with this module

PREVIEW_BYTES = 1 << 20
BATCH_ROWS = 1 << 12
BATCH_BYTES = 1 << 24


def preview(spark: SparkSession, path: str, limit: int = PREVIEW_BYTES) -> DataFrame:
    """SRC13: file length and up to ``limit`` characters of decoded text."""
    return (spark.read.format("binaryFile").load(path)
                 .select("path", "length",
                         F.substring(F.decode("content", "UTF-8"), 1, limit).alias("text")))


def preview_archives(spark: SparkSession, path: str, limit: int = PREVIEW_BYTES) -> DataFrame:
    """SRC13: member list of every archive below ``path`` with each member's
    length and the first ``limit`` bytes as text; only those bytes are read."""
    names = spark.createDataFrame(pa.table({"archive": pa.array(_list_archives(path), pa.string())}))
    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("length", pa.int64()), ("text", pa.string())])

    def look(batches):
        rows, held = [], 0
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with _open(path, archive) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    for info in tar:
                        if not info.isreg():
                            continue
                        head = tar.extractfile(info).read(limit)
                        rows.append((archive, info.name, info.size, head.decode("utf-8", "replace")))
                        held += len(head)
                        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return names.repartition(64).mapInArrow(look, "path string, member string, length long, text string")


def read_process_list(spark: SparkSession, path: str, header: list | None = None) -> DataFrame:
    """SRC16: whitespace-separated table; the last column takes the rest of the line.

    The columns are named by the file's first line; ``header`` overrides it.
    """
    lines = spark.read.text(path)
    if header is None:
        first_line = lines.orderBy(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).first()
        header = first_line["value"].split() if first_line else ["PID"]
    n = len(header)
    first = " ".join(header)
    body = lines.where(F.regexp_replace(F.trim("value"), r"\s+", " ") != first) \
                .where(F.length(F.trim("value")) > 0)
    parts = F.split(F.trim("value"), r"\s+", n)
    cols = [parts[i].alias(h) for i, h in enumerate(header[:-1])]
    last = F.regexp_replace(parts[n - 1], r"\s+", " ")
    return body.select(*cols, last.alias(header[-1]))


def flatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """SRC15: nested structs -> leaf columns named by their path."""
    from pyspark.sql import types as T

    def walk(schema, prefix):
        out = []
        for f in schema.fields:
            name = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, name)
            else:
                out.append(name)
        return out

    leaves = walk(df.schema, [])
    return df.select(*[F.col(".".join(f"`{p}`" for p in leaf)).alias(sep.join(leaf)) for leaf in leaves])


def synthetic_lines(spark: SparkSession, n: int = 100_000, seed: int = 1,
                    lanes: int = 160, categories: int = 20, tmax: float = 1e9) -> DataFrame:
    """SRC17: random segment frame (x0 = x1, lanes, categories) for demos."""
    x = F.rand(seed) * tmax
    y = F.floor(F.rand(seed + 1) * lanes).cast("double")
    return (spark.range(n).select(x.alias("x0"), y.alias("y0"), x.alias("x1"), (y + 0.5).alias("y1"),
                                  F.floor(F.rand(seed + 2) * categories).cast("int").alias("c"))
                 .orderBy("x0"))


def synthetic_lines_of(ids: DataFrame, column: str, lanes: int = 160, categories: int = 20, tmax: int = 10**9) -> DataFrame:
    """SRC17 in whole-number arithmetic: one segment for each id of a table, the same on every run and engine.

    Multiplicative steps by odd constants scatter neighbouring ids; ids are taken modulo 2**31.
    """
    i = F.pmod(F.col(f"`{column}`").cast("long"), F.lit(1 << 31))
    x = F.pmod(i * 48271 + 11, F.lit(tmax)).cast("double")
    y = F.pmod(i * 69621 + 7, F.lit(lanes)).cast("double")
    return ids.select(x.alias("x0"), y.alias("y0"), x.alias("x1"), (y + 0.5).alias("y1"),
                      F.pmod(i * 16807 + 3, F.lit(categories)).cast("int").alias("c")).orderBy("x0")
