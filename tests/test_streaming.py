"""Micro-batch run table: restart on the same checkpoint and incremental input."""

import os

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tracetide.plans import runs
from tracetide.sources.runlogs import run_logs_from_events
from tracetide.streaming.run_stream import stream_run_table
from tracetide.trace import load_events


def test_restart_and_incremental_batches(spark, tmp_path):
    lines, docs = run_logs_from_events(load_events(spark, SF_SMALL))
    index = runs.run_index(lines, docs)
    paths = sorted(r["path"] for r in index.collect())
    first, second = paths[: len(paths) // 2], paths[len(paths) // 2:]
    idx_dir, out, ck = str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([(p,) for p in first], "path string").write.parquet(os.path.join(idx_dir, "a"))
    t1 = stream_run_table(spark, lines, docs, os.path.join(idx_dir, "*"), out, ck)
    assert t1.count() == len(first)
    # restart with nothing new: no duplicates
    t2 = stream_run_table(spark, lines, docs, os.path.join(idx_dir, "*"), out, ck)
    assert t2.count() == len(first)
    # new index files arrive: only they are processed
    spark.createDataFrame([(p,) for p in second], "path string").write.parquet(os.path.join(idx_dir, "b"))
    t3 = stream_run_table(spark, lines, docs, os.path.join(idx_dir, "*"), out, ck)
    assert sorted(r["fname"] for r in t3.select("fname").collect()) == paths
    batch = runs.traces_summary(lines, docs)
    key = [c for c in batch.columns]
    assert t3.select(*key).exceptAll(batch).count() == 0 and batch.exceptAll(t3.select(*key)).count() == 0


def put(directory, name, text):
    from tracetide.sources.raw import put_file
    from tracetide.sources.runlogs import run_archive_bytes
    path = f"{directory}/runs/BENCH=phoronix/POWER=powersave-y/MONITORING=cpu-energy-meter/PHORONIX={name}/k1/1.tar"
    put_file(path, run_archive_bytes([("logs/time.err", text)]) if text is not None else b"not a tar" * 200)
    return path


def test_archive_stream_opens_only_new_files(spark, tmp_path):
    from tracetide.sources.runlogs import read_run_archives, seen_archives
    from tracetide.streaming.run_stream import stream_run_archives
    d, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    old = [put(d, f"a{k}", f"{k}.50\n") for k in range(5)]
    calls = []
    table = stream_run_archives(spark, d, out, ck, files_per_trigger=2, callback=lambda t, e: calls.append((e, t.count())))
    assert [n for _, n in calls] == [2, 4, 5] and sorted(r.fname for r in table.collect()) == old
    # a batch does not open the files of another: they can be spoilt, or gone
    lines, docs, files = read_run_archives(spark, d)
    want = {repr(r) for r in runs.traces_summary(lines, docs, runs=files).collect()}  # NaN equals itself in text
    put(d, "a0", None)
    os.remove(old[1])
    calls.clear()
    new = put(d, "b", "9.25\n")
    table = stream_run_archives(spark, d, out, ck, files_per_trigger=2, callback=lambda t, e: calls.append((e, t.count())))
    got = {repr(r) for r in table.collect()}
    assert [n for _, n in calls] == [6] and want <= got and sorted(r.fname for r in table.collect()) == sorted([*old, new])
    assert len(seen_archives(f"{ck}/seen")) == 6
    # nothing new: no batch
    calls.clear()
    assert stream_run_archives(spark, d, out, ck, callback=lambda t, e: calls.append(e)).count() == 6 and calls == []


def test_archive_stream_restarts_within_a_batch(spark, tmp_path):
    import pytest
    from tracetide.streaming.run_stream import stream_run_archives
    d, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    paths = [put(d, f"a{k}", f"{k}.50\n") for k in range(4)]

    def fails(table, epoch):
        if epoch == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream_run_archives(spark, d, out, ck, files_per_trigger=2, callback=fails)
    paths.append(put(d, "Z", "1.00\n"))  # it comes before the replayed batch, and is no part of it
    seen = []
    table = stream_run_archives(spark, d, out, ck, files_per_trigger=2, callback=lambda t, e: seen.append((e, t.count())))
    assert seen[0][0] == 1 and sorted(r.fname for r in table.collect()) == sorted(paths)
