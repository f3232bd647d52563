"""SRC5 for files that are in time order, as recorders write them: merged and numbered without a shuffle.

The driver samples keys (timestamp, cpu, offset) at even steps of the files and cuts the time line
into ranges of about equal numbers of records. A task finds its range's ends in every file by
binary search (a few small reads), so it also knows how many records lie before the range: the numbers
are final at once. It then merges the files' runs in chunks of bounded size, whatever the range holds.
Ranges are cut by the whole key, so a timestamp that a third of all records share is split like any other.

The merged rows and numbers equal ``read_raw_trace``'s. A file that is not in time order is an
error (every record is compared with the one before it): read it with ``read_raw_trace``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .raw import RECORD, RawRecordsReader, _filesystem

MERGED_SCHEMA = "idx long, timestamp long, cpu long, pid long, event int, arg0 long, arg1 long"
SAMPLES_PER_RANGE = 8
MAX_RANGES = 4096  # more records make longer ranges, which a task still merges in bounded memory
BLOCK = 2048       # records read at once at the end of a binary search
MERGE_RECORDS = 1 << 20


class Run:
    """One file: its timestamps ascend, and its keys are (timestamp, cpu, base + position)."""

    def __init__(self, part):
        self.path, self.cpu, self.base, self.count = part.path, part.cpu, part.base, part.count

    def open(self, fs) -> "Run":
        """A copy with an open file (the reader itself is sent to tasks)."""
        run = Run(self)
        run.file = fs.open_input_file(self.path)
        return run

    def records(self, start: int, stop: int) -> np.ndarray:
        self.file.seek(start * RECORD.itemsize)
        return np.frombuffer(self.file.read((stop - start) * RECORD.itemsize), dtype=RECORD)

    def key(self, i: int) -> tuple:
        return int(self.records(i, i + 1)["timestamp"].astype("int64")[0]), self.cpu, self.base + i

    def lower_bound(self, key: tuple) -> int:
        """Number of records whose key is below ``key``."""
        lo, hi = 0, self.count
        while hi - lo > BLOCK:
            mid = (lo + hi) // 2
            if self.key(mid) < key:
                lo = mid + 1
            else:
                hi = mid
        times = self.records(lo, hi)["timestamp"].astype("int64")
        below = int(np.searchsorted(times, key[0], "left"))
        ties = int(np.searchsorted(times, key[0], "right"))
        # records of the key's own time: those of smaller (cpu, offset) are below it
        if (self.cpu, self.base + lo + ties) <= key[1:]:
            return lo + ties
        if self.cpu == key[1]:
            return lo + min(max(below, key[2] - self.base - lo), ties)
        return lo + (ties if self.cpu < key[1] else below)


class RangePartition(InputPartition):
    def __init__(self, low: tuple | None, high: tuple | None):
        self.low, self.high = low, high


class MergedRecordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_range = int(options.get("recordsPerRange", 1 << 22))
        self.merge = int(options.get("mergeRecords", MERGE_RECORDS))
        # the listing, with its checks and offsets, is the per-CPU source's; one part a file
        files = RawRecordsReader({"path": self.path, "recordsPerPartition": 1 << 36})
        self.runs = [Run(p) for p in files.partitions()]
        self.runs.sort(key=lambda r: (r.cpu, r.base))

    def partitions(self):
        total = sum(r.count for r in self.runs)
        ranges = min(-(-total // self.per_range), MAX_RANGES)
        if ranges <= 1:
            return [RangePartition(None, None)]
        fs, _ = _filesystem(self.path)
        step = max(1, total // (ranges * SAMPLES_PER_RANGE))

        def sample(numbered):
            number, run = numbered
            run = run.open(fs)
            # a start of its own for each file, so that many short files are sampled in step with long ones
            keys = [run.key(i) for i in range(number * 7919 % step, run.count, step)]
            run.file.close()
            return keys

        with ThreadPoolExecutor(16) as pool:
            keys = sorted(k for found in pool.map(sample, enumerate(self.runs)) for k in found)
        bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
        return [RangePartition(a, b) for a, b in zip([None, *bounds], [*bounds, None], strict=True)]

    def read(self, part: RangePartition):
        import pyarrow as pa
        fs, _ = _filesystem(self.path)
        runs = [r.open(fs) for r in self.runs]
        at = [0 if part.low is None else r.lower_bound(part.low) for r in runs]
        ends = [r.count if part.high is None else r.lower_bound(part.high) for r in runs]
        idx = sum(at)
        last = [r.key(i - 1)[0] if i else None for r, i in zip(runs, at, strict=True)]
        live = [n for n in range(len(runs)) if at[n] < ends[n]]
        chunk = max(64, self.merge // max(1, len(live)))
        held = {n: np.empty(0, dtype=RECORD) for n in live}
        while live:
            for n in live:
                if not len(held[n]):
                    stop = min(at[n] + chunk, ends[n])
                    held[n], at[n] = runs[n].records(at[n], stop), stop
                    times = held[n]["timestamp"].astype("int64")
                    if (last[n] is not None and times[0] < last[n]) or (times[1:] < times[:-1]).any():
                        raise ValueError(f"{runs[n].path} is not in time order: use read_raw_trace")
                    last[n] = times[-1]
            # all records up to the earliest last key of files that go on are held: they can leave
            going = [(int(held[n]["timestamp"].astype("int64")[-1]), n) for n in live if at[n] < ends[n]]
            limit = min(going) if going else None
            out, cpus = [], []
            for n in live:
                times = held[n]["timestamp"].astype("int64")
                # live is in order of (cpu, base), so at the limit's own time the files up to its own leave too
                cut = len(times) if limit is None else int(np.searchsorted(times, limit[0], "right" if n <= limit[1] else "left"))
                out.append(held[n][:cut])
                cpus.append(np.full(cut, runs[n].cpu, dtype="int64"))
                held[n] = held[n][cut:]
            rec, cpu = np.concatenate(out), np.concatenate(cpus)
            # runs lie in order of (cpu, offset): a stable merge by time gives the order of the whole key
            order = np.argsort(rec["timestamp"].astype("int64"), kind="stable")
            rec = rec[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(idx, idx + len(rec), dtype="int64")), pa.array(rec["timestamp"].astype("int64")),
                 pa.array(cpu[order])] + [pa.array(rec[c].astype(t)) for c, t in
                                          (("pid", "int64"), ("event", "int32"), ("arg0", "int64"), ("arg1", "int64"))],
                names=["idx", "timestamp", "cpu", "pid", "event", "arg0", "arg1"])
            idx += len(rec)
            live = [n for n in live if len(held[n]) or at[n] < ends[n]]
        for r in runs:
            r.file.close()


class MergedRecordsDataSource(DataSource):
    """``spark.read.format("tracetide_raw_merged").load(dir)``."""

    @classmethod
    def name(cls):
        return "tracetide_raw_merged"

    def schema(self):
        return MERGED_SCHEMA

    def reader(self, schema):
        return MergedRecordsReader(self.options)


def read_raw_merged(spark: SparkSession, directory: str, records_per_range: int = 1 << 22,
                    merge_records: int = MERGE_RECORDS) -> DataFrame:
    """SRC5 of time-ordered files: merged trace, ``idx`` 0..n-1 by (timestamp, cpu, offset).

    ``records_per_range``: records of a task in the mean; ``merge_records``: records a task holds at once.
    """
    spark.dataSource.register(MergedRecordsDataSource)
    return spark.read.format("tracetide_raw_merged").option("recordsPerRange", str(records_per_range)) \
        .option("mergeRecords", str(merge_records)).load(directory)
