"""Trace archives: uncompressed tar files with one ``.npz`` member per column.

Reading is a Python data source: archives are opened from the filesystem (no 2 GB
``binaryFile`` row), only the requested members are read, and rows are emitted as
Arrow batches with an explicit ``idx``.  A large archive is dealt to several
tasks, each of which reads its range of rows from every stored member by byte position.
Compressed members can only be read from their beginning: such an archive is
one task's, which streams all its columns side by side.  A reading task holds one
batch, a writing one the rows of an archive, bounded in bytes, and one column of it.
"""

from __future__ import annotations

import io
import os
import tarfile
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .raw import _filesystem, new_file, put_file  # module-level: pickled by value with this module

SPLIT_BYTES = 128 << 20
ARCHIVE_BYTES = 32 << 20  # values that a writing task holds


def _members(tar: tarfile.TarFile):
    """(member, column name in the file's name) of the ``.npz`` members."""
    for info in tar:
        if info.isreg() and os.path.splitext(info.name)[1] == ".npz":
            yield info, os.path.splitext(os.path.basename(info.name))[0]


class _ColumnStream:
    """One array of an archive, read in pieces."""

    def __init__(self, archive: zipfile.ZipFile, entry: zipfile.ZipInfo):
        self.name = entry.filename.removesuffix(".npy")
        self.stored = entry.compress_type == zipfile.ZIP_STORED
        self.file = archive.open(entry)
        shape, _, self.dtype = _array_header(self.file)
        if len(shape) != 1 or self.dtype.hasobject:
            raise ValueError(f"{self.name} is not a plain column")
        self.rows, self.data = shape[0], self.file.tell()

    def skip_to(self, row: int) -> None:
        self.file.seek(self.data + row * self.dtype.itemsize)

    def read(self, rows: int) -> np.ndarray:
        data = self.file.read(rows * self.dtype.itemsize)
        if len(data) < rows * self.dtype.itemsize:
            raise ValueError(f"{self.name} ends early")
        return np.frombuffer(data, dtype=self.dtype) if self.dtype.itemsize else np.empty(rows, self.dtype)


def _array_header(f):
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(f)


def _column_streams(tar: tarfile.TarFile, only=None) -> dict:
    """{column: stream} of the members, none of which is read yet; the last of a name counts."""
    cols = {}
    for info, name in list(_members(tar)):
        if only is None or name in only:
            archive = zipfile.ZipFile(tar.extractfile(info))
            for entry in archive.infolist():
                stream = _ColumnStream(archive, entry)
                cols[stream.name] = stream
    return cols


def _header_kinds(fileobj, only=None) -> dict:
    """{column: numpy kind} from the array headers; no array is decoded."""
    kinds = {}
    with tarfile.open(fileobj=fileobj, mode="r:") as tar:
        for info, name in _members(tar):
            if only is not None and name not in only:
                continue
            with zipfile.ZipFile(tar.extractfile(info)) as z:
                for entry in z.namelist():
                    with z.open(entry) as f:
                        kinds[entry.removesuffix(".npy")] = _array_header(f)[2].kind
    return kinds


def _kind_to_spark(kinds: set) -> T.DataType:
    """The type that holds a column of these numpy kinds."""
    if kinds <= {"b"}:
        return T.BooleanType()
    if kinds <= {"i", "u", "b"}:
        return T.LongType()
    if kinds <= {"f", "i", "u", "b"}:
        return T.DoubleType()
    return T.StringType()


def _list_infos(path: str) -> list:
    """File infos of the archives, sorted by path, by one listing."""
    import pyarrow.fs as pafs
    fs, root = _filesystem(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [info]
    infos = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((i for i in infos if i.type == pafs.FileType.File and i.path.endswith(".tar")), key=lambda i: i.path)


def _list_archives(path: str) -> list:
    return [i.path for i in _list_infos(path)]


def _archive_groups(path: str, most_files: int = 256, most_bytes: int = 128 << 20, names: list | None = None) -> list:
    """Archives in groups for a task each: small files together, a large one alone; a file that is gone has size 0."""
    infos = _list_infos(path) if names is None else _filesystem(path)[0].get_file_info(names)
    if not infos:
        return []
    groups, held = [[]], 0
    for info in infos:
        if groups[-1] and (held + (info.size or 0) > most_bytes or len(groups[-1]) >= most_files):
            groups.append([])
            held = 0
        groups[-1].append(info.path)
        held += info.size or 0
    return groups


def _open(path: str, name: str):
    fs, _ = _filesystem(path)
    return fs.open_input_file(name)


def archive_schema(spark: SparkSession, path: str, only=None) -> T.StructType:
    """Union of the columns of all archives, from the array headers (read by
    tasks, one archive each); a column that an archive lacks is NULL there."""
    archives = _list_archives(path)
    if not archives:
        raise FileNotFoundError(path)

    def look(batches):
        for pdf in batches:
            for archive in pdf["archive"]:
                with _open(path, archive) as f:
                    kinds = _header_kinds(f, only)
                yield pd.DataFrame(list(kinds.items()), columns=["name", "kind"])

    names = spark.createDataFrame([(a,) for a in archives], "archive string").repartition(min(len(archives), 1000))
    found: dict = {}
    for name, kind in names.mapInPandas(look, "name string, kind string").distinct().collect():
        found.setdefault(name, set()).add(kind)
    fields = [T.StructField("trace", T.StringType())]
    if "idx" not in found:
        fields.append(T.StructField("idx", T.LongType()))
    return T.StructType(fields + [T.StructField(k, _kind_to_spark(v)) for k, v in sorted(found.items())])


class ArchivePartition(InputPartition):
    def __init__(self, archive: str, share: int, shares: int):
        self.archive, self.share, self.shares = archive, share, shares


class ArchiveReader(DataSourceReader):
    BATCH_ROWS = 1 << 16  # the archive's path stands in each row

    def __init__(self, options: dict, schema: T.StructType):
        self.path = options["path"]
        self.schema = schema
        self.names = [f.name for f in schema.fields]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.batch = int(options.get("batchRows", self.BATCH_ROWS))

    def partitions(self):
        parts = []
        for info in _list_infos(self.path):
            shares = max(1, -(-(info.size or 0) // self.split))
            parts += [ArchivePartition(info.path, i, shares) for i in range(shares)]
        return parts

    def read(self, part: ArchivePartition):
        with _open(self.path, part.archive) as f, tarfile.open(fileobj=f, mode="r:") as tar:
            cols = _column_streams(tar, set(self.names) - {"trace"})
            n = next(iter(cols.values())).rows if cols else 0
            if any(c.rows != n for c in cols.values()):
                raise ValueError(f"{part.archive}: columns of different lengths")
            if all(c.stored for c in cols.values()):
                start, stop = n * part.share // part.shares, n * (part.share + 1) // part.shares
                for c in cols.values():
                    c.skip_to(start)
            elif part.share == 0:
                start, stop = 0, n
            else:
                return
            for lo in range(start, stop, self.batch):
                hi = min(stop, lo + self.batch)
                yield self._batch(part.archive, {k: c.read(hi - lo) for k, c in cols.items()}, lo, hi)

    def _batch(self, archive: str, cols: dict, lo: int, hi: int):
        import pyarrow as pa
        cols.setdefault("idx", np.arange(lo, hi, dtype="int64"))  # positional identity within the archive
        types = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        arrow_schema = pa.schema([(f.name, types[f.dataType.simpleString()]) for f in self.schema.fields])
        arrays = []
        for field in arrow_schema:
            if field.name == "trace":
                arrays.append(pa.repeat(pa.scalar(archive, pa.string()), hi - lo))
            elif field.name in cols:
                values = pa.array(cols[field.name])
                arrays.append(values if values.type == field.type else values.cast(field.type))
            else:
                arrays.append(pa.nulls(hi - lo, field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)


class TraceArchiveDataSource(DataSource):
    """``spark.read.format("tracetide_archive").schema(s).load(dir)``: one
    partition for each ``splitBytes`` of an archive, only the members named in the
    schema read, Arrow batches of <= ``batchRows`` rows."""

    @classmethod
    def name(cls):
        return "tracetide_archive"

    def schema(self):
        raise ValueError("pass the schema: archive_schema(spark, path)")

    def reader(self, schema):
        return ArchiveReader(self.options, schema)


def read_trace_archives(spark: SparkSession, path: str, only=None,
                        schema: T.StructType | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """SRC1 / SRC2: every ``.npz`` member of every archive under ``path``
    becomes a column; ``only`` keeps just the listed columns (others are
    never read). ``split_bytes``: size of an archive's part for one task, if its members are stored."""
    if only is not None:
        only = set(only) | {"idx"}
    schema = schema or archive_schema(spark, path, only)
    spark.dataSource.register(TraceArchiveDataSource)
    return spark.read.format("tracetide_archive").schema(schema).option("splitBytes", str(split_bytes)).load(path)


def archive_bytes(columns: dict, compressed: bool = True) -> bytes:
    """A trace archive: one ``.npz`` member per column; stored members can be read in parts."""
    out = io.BytesIO()
    _write_archive(out, columns.items(), compressed)
    return out.getvalue()


def _write_archive(out, columns, compressed: bool) -> None:
    """(name, values) of one column after the other, so that only one is held beside the rows."""
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, values in columns:
            buf = io.BytesIO()
            (np.savez_compressed if compressed else np.savez)(buf, **{name: np.asarray(values)})
            info = tarfile.TarInfo(f"data/{name}.npz")
            info.size = buf.tell()
            buf.seek(0)
            tar.addfile(info, buf)


def write_trace_archive(path: str, columns: dict, compressed: bool = True) -> None:
    """Test helper / small exports."""
    put_file(path, archive_bytes(columns, compressed))


def write_trace_archives(df: DataFrame, directory: str, rows_per_archive: int = 1 << 22, compressed: bool = True,
                         archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows each task holds as archives of at most ``rows_per_archive``
    rows and about ``archive_bytes`` of values in memory; returns (path, rows) per written archive.

    Files are named by partition and number, so a retried or speculative task
    writes the same files again instead of others beside them.
    """
    cols = df.columns

    def write(batches):
        from pyspark import TaskContext
        part, number, held, rows, size = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            path = f"{directory.rstrip('/')}/part-{part:05d}-{number:05d}.tar"
            with new_file(path) as out:
                _write_archive(out, ((c, pd.concat([p[c] for p in held], ignore_index=True).to_numpy()) for c in cols), compressed)
            return pd.DataFrame({"path": [path], "rows": [rows]})

        for pdf in batches:
            if not len(pdf):
                continue
            if held and (rows + len(pdf) > rows_per_archive or size >= archive_bytes):
                yield flush()
                number, held, rows, size = number + 1, [], 0, 0
            held.append(pdf)
            rows += len(pdf)
            size += int(pdf.memory_usage(index=False, deep=True).sum())
        if held:
            yield flush()

    return df.mapInPandas(write, "path string, rows long")
