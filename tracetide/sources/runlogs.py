"""Run logs: per-run text lines and JSON documents.

Two readers produce the same two tables:

* ``run_lines(path, member, line_no, line)`` -- every text line of a member;
* ``run_docs(path, member, doc_no, doc)``     -- JSON documents.

:func:`read_run_archives` reads real run archives (uncompressed tars, a data
source) and lists the runs by their files; :func:`run_logs_from_events` derives the two tables
from the driver's ``events`` table (one run per user) so that every run-table
query can be checked against SQL.
"""

from __future__ import annotations

import io
import json
import os
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .archive import _archive_groups, _filesystem, _list_archives, _open  # module-level: pickled by value with this module
from .raw import put_file

LINES_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("member", T.StringType()),
    T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])
DOCS_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("member", T.StringType()),
    T.StructField("doc_no", T.LongType()), T.StructField("doc", T.StringType())])

TEXT_MEMBERS = ("time.err", "run.out", "cpu-energy-meter.out")
JSON_MEMBERS = ("phoronix.json", "report.main.json")


def list_files(spark: SparkSession, directory: str, ext: str, regexp: str = ".*") -> DataFrame:
    """SRC11 / SRC12: recursive listing, extension equality, regex anchored at
    the path start, sorted; only metadata is read (content is pruned)."""
    from ..functions.scalar import basename, extension
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", f"*{ext}").load(directory)
               .select(F.regexp_replace("path", "^file:", "").alias("path"), "length"))
    df = df.where((extension(F.col("path")) == ext) & F.col("path").rlike("^(?:" + regexp + ")"))
    return df.withColumn("name", basename(F.col("path"))).orderBy("path")


class RunArchivePartition(InputPartition):
    def __init__(self, archives: list):
        self.archives = archives


class RunArchiveRows:
    """Rows (kind, path, member, no, text): ``F`` one for each file, ``L`` text
    lines, ``D`` JSON documents.  Without members to read no file is opened."""

    ROWS = 1 << 14
    CHARS = 1 << 23  # of the texts held for a batch

    def __init__(self, options: dict):
        self.path = options["path"]
        self.text = set(json.loads(options.get("textmembers", "[]")))
        self.docs = set(json.loads(options.get("jsonmembers", "[]")))

    def read(self, part: RunArchivePartition):
        """The rows of all archives of the task in batches, so that small archives share one."""
        schema = pa.schema([("kind", pa.string()), ("path", pa.string()), ("member", pa.string()), ("no", pa.int64()), ("text", pa.string())])
        rows, chars = [], 0
        for archive in part.archives:
            for row in self.read_one(archive):
                rows.append(row)
                chars += len(row[4] or "")
                if len(rows) >= self.ROWS or chars >= self.CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def read_one(self, archive: str):
        yield "F", archive, None, 0, None
        if not self.text and not self.docs:
            return
        seen: set = set()
        try:
            with _open(self.path, archive) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                for info in tar:  # headers; the contents of other members are skipped
                    base = os.path.basename(info.name)
                    if not info.isreg() or base in seen or base not in self.text | self.docs:
                        continue
                    seen.add(base)  # of equal names the first member counts
                    data = tar.extractfile(info)
                    if base in self.docs:
                        yield "D", archive, base, 0, data.read().decode("utf-8", "replace")
                        continue
                    for i, line in enumerate(io.TextIOWrapper(data, "utf-8", "replace", newline="\n")):
                        yield "L", archive, base, i, line.removesuffix("\n")
        except tarfile.TarError:
            return  # an unreadable archive keeps its row and has no logs


class RunArchiveReader(RunArchiveRows, DataSourceReader):
    def partitions(self):
        return [RunArchivePartition(g) for g in _archive_groups(self.path)]


def seen_archives(log: str) -> list:
    """The archives that streams with this log have taken up, in order."""
    import pyarrow.fs as pafs
    fs, root = _filesystem(log)
    names = []
    for info in sorted(fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
        if info.path.endswith(".json"):
            with fs.open_input_file(info.path) as f:
                names += json.loads(f.read())
    return names


def new_archives(path: str, log: str) -> list:
    return _not_in(_list_archives(path), seen_archives(log))


def _not_in(names: list, seen: list) -> list:
    known = set(seen)
    return [p for p in names if p not in known]


class RunArchiveStreamReader(RunArchiveRows, DataSourceStreamReader):
    """The same rows as a stream of new files.

    An offset is a number of files seen.  Which files those are stands in the log folder
    (option ``seenLog``): one entry for each time that files were found, written before
    the offset is given to Spark.  So a batch that is run again opens the same
    archives, and a batch opens none but its own.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.log, self.most = options["seenlog"], int(options.get("filespertrigger", "0"))

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        seen = seen_archives(self.log)
        found = _not_in(_list_archives(self.path), seen)
        found = found[:self.most] if self.most else found
        if found:
            put_file(f"{self.log.rstrip('/')}/{len(seen):012d}.json", json.dumps(found).encode())
        return {"files": len(seen) + len(found)}

    def partitions(self, start, end):
        return [RunArchivePartition(g) for g in _archive_groups(self.path, names=seen_archives(self.log)[start["files"]:end["files"]])]


class RunArchiveDataSource(DataSource):
    """``spark.read.format("tracetide_runs")`` and ``spark.readStream``: a task for a
    large run archive or a group of small ones, read by the tar headers from the file
    system; only declared members are decoded."""

    @classmethod
    def name(cls):
        return "tracetide_runs"

    def schema(self):
        return "kind string, path string, member string, no long, text string"

    def reader(self, schema):
        return RunArchiveReader(self.options)

    def streamReader(self, schema):
        return RunArchiveStreamReader(self.options)


def read_run_archives(spark: SparkSession, directory: str, regexp: str = ".*", text_members=TEXT_MEMBERS, json_members=JSON_MEMBERS):
    """SRC9 / SRC10 / RUN1 input from run archives: -> (run_lines, run_docs, runs).

    ``runs`` has a row for every archive, also for one without logs or one
    that cannot be read.  The members that the table's columns use are declared
    by the caller."""
    spark.dataSource.register(RunArchiveDataSource)

    def rows(texts, docs):  # each table reads its own members only
        return split_run_rows(spark.read.format("tracetide_runs").options(**member_options(texts, docs)).load(directory), regexp)

    return rows(text_members, [])[0], rows([], json_members)[1], rows([], [])[2]


def member_options(text_members, json_members) -> dict:
    return {"textMembers": json.dumps(list(text_members)), "jsonMembers": json.dumps(list(json_members))}


def split_run_rows(raw: DataFrame, regexp: str = ".*"):
    """(run_lines, run_docs, runs) from the rows of ``tracetide_runs``."""
    raw = raw.where(F.col("path").rlike("^(?:" + regexp + ")"))
    lines = raw.where("kind = 'L'").select("path", "member", F.col("no").alias("line_no"), F.col("text").alias("line"))
    docs = raw.where("kind = 'D'").select("path", "member", F.col("no").alias("doc_no"), F.col("text").alias("doc"))
    return lines, docs, raw.where("kind = 'F'").select("path")


def run_archive_bytes(members: list) -> bytes:
    """A run archive of (member name, text) in the given order."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, text in members:
            data = text.encode("utf-8")
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def write_run_archives(lines: DataFrame, docs: DataFrame, directory: str) -> DataFrame:
    """Write one archive for each run of the table form (``<directory>/<path>``);
    a member's lines are in order, of its documents the first is kept.  Files
    are named by the run, so a retried task replaces them."""
    text = lines.select("path", "member", F.col("line_no").alias("no"), F.col("line").alias("text"))
    first = docs.groupBy("path", "member").agg(F.min("doc_no").alias("no"), F.min_by("doc", "doc_no").alias("text"))
    rows = text.unionByName(first.select("path", "member", "no", "text"))

    def write(batches):
        run, members = None, []  # the members of one run: (name, lines)

        def finish():
            put_file(f"{directory.rstrip('/')}/{run}", run_archive_bytes([(f"logs/{m}", "\n".join(own)) for m, own in members]))
            return run

        for batch in batches:
            done = []
            for path, member, line in zip(*(batch.column(c).to_pylist() for c in ("path", "member", "text"))):
                if path != run:
                    if members:
                        done.append(finish())
                    run, members = path, []
                if not members or members[-1][0] != member:
                    members.append((member, []))
                members[-1][1].append(line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([finish()], pa.string())], names=["path"])

    # a run's rows lie together in one task, in order; the hash sorts faster than paths that begin alike
    rows = rows.repartition("path").sortWithinPartitions(F.xxhash64("path"), "path", "member", F.col("no").asc_nulls_last())
    return rows.select("path", "member", "text").mapInArrow(write, "path string")


# ---------------------------------------------------------------- from events

def run_path(user_id) -> "F.Column":
    """Run archive path of a user: POWER alternates, PHORONIX pairs users 2k, 2k+1."""
    power = F.when(user_id % 2 == 0, F.lit("powersave-y")).otherwise(F.lit("performance-n"))
    test = F.concat(F.lit("bench"), (F.floor(user_id / 2)).cast("string"))
    # users 2k and 2k+1 share a kernel, but for every fifth user
    kernel = F.when(user_id % 5 == 0, F.lit("k9")).otherwise(F.concat(F.lit("k"), (F.floor(user_id / 2) % 3).cast("string")))
    return F.concat(F.lit("runs/BENCH=phoronix/POWER="), power,
                    F.lit("/MONITORING=cpu-energy-meter/PHORONIX="), test, F.lit("/"), kernel,
                    F.lit("/1.tar"))


def run_logs_from_events(events: DataFrame):
    """Table form of run logs derived from ``events`` (one run per user)."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    v = F.format_string("%.2f", F.col("value"))
    base = events.select(run_path(F.col("user_id")).alias("path"), F.col("event_id"),
                         F.col("event_type"), k.alias("k"), v.alias("v"), F.col("value"))
    member = (F.when(F.col("event_type").isin("view", "click"), F.lit("cpu-energy-meter.out"))
               .when(F.col("event_type") == "purchase", F.lit("time.err"))
               .otherwise(F.lit("run.out")))
    cpu = (F.col("k") % 4).cast("string")
    line = (F.when(F.col("event_type") == "view", F.concat(F.lit("cpu"), cpu, F.lit("_package_joules="), F.col("v")))
             .when(F.col("event_type") == "click", F.concat(F.lit("cpu"), cpu, F.lit("_dram_joules="), F.col("v")))
             .when(F.col("event_type") == "purchase", F.col("v"))
             .when(F.col("event_type") == "signup",
                   F.concat(F.when(F.col("k") % 2 == 0, F.lit("    transactions:   ")).otherwise(F.lit("    Transactions:   ")), F.col("k").cast("string"), F.lit("   ("),
                            F.col("v"), F.lit(" per sec.)")))
             .otherwise(F.concat(F.lit("error "), F.col("k").cast("string"))))
    lines = base.select("path", member.alias("member"), F.col("event_id").alias("line_no"),
                        line.alias("line"))
    result = F.to_json(F.struct(F.array(F.struct(
        F.col("event_type").alias("test"),
        F.concat(F.lit("k="), (F.col("k") % 3).cast("string")).alias("arguments"),
        F.lit("ops").alias("units"),
        F.struct(F.struct(F.col("value").alias("value")).alias("schedrecord")).alias("results"))).alias("results")))
    report = F.to_json(F.struct(F.struct(
        F.concat(F.lit("4.19."), (F.col("k") % 5).cast("string")).alias("version")).alias("kernel")))
    docs = base.select("path",
                       F.when(F.col("event_type") == "signup", F.lit("report.main.json"))
                        .otherwise(F.lit("phoronix.json")).alias("member"),
                       F.col("event_id").alias("doc_no"),
                       F.when(F.col("event_type") == "signup", report).otherwise(result).alias("doc"))
    return lines, docs
