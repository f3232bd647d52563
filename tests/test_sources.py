"""Sources through generated files in a temporary folder."""

import io
import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracetide.plans import runs
from tracetide.sources import archive, raw, runlogs, text
from tracetide.sources.dictionary import dictionary_table, vars_from_table


def test_archive_columns_and_selection(spark, tmp_path):
    d = tmp_path / "traces"
    d.mkdir()
    archive.write_trace_archive(str(d / "a.tar"), {"timestamp": np.array([5, 6, 7]), "cpu": np.array([0, 1, 0]),
                                                   "event": np.array([10, 2, 4])})
    archive.write_trace_archive(str(d / "b.tar"), {"timestamp": np.array([1, 2]), "cpu": np.array([3, 3]),
                                                   "event": np.array([0, 0])})
    df = archive.read_trace_archives(spark, str(d))
    got = sorted((os.path.basename(r["trace"]), r["idx"], r["timestamp"], r["cpu"], r["event"]) for r in df.collect())
    assert got == [("a.tar", 0, 5, 0, 10), ("a.tar", 1, 6, 1, 2), ("a.tar", 2, 7, 0, 4),
                   ("b.tar", 0, 1, 3, 0), ("b.tar", 1, 2, 3, 0)]
    only = archive.read_trace_archives(spark, str(d), only=["cpu"])
    assert set(only.columns) == {"trace", "idx", "cpu"}


def test_raw_records_merge_and_order(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    raw.write_raw_file(str(d / "0"), [(30, 1, 2, 0, 5), (10, 1, 4, 1, -1)])
    raw.write_raw_file(str(d / "1"), [(20, 2, 10, 0, 7)])
    t = raw.read_raw_trace(spark, str(d))
    got = [tuple(r) for r in t.orderBy("idx").collect()]
    assert got == [(0, 10, 0, 1, 4, 1, -1), (1, 20, 1, 2, 10, 0, 7), (2, 30, 0, 1, 2, 0, 5)]
    split = raw.read_raw_per_cpu(spark, str(d), records_per_partition=1)
    assert split.rdd.getNumPartitions() == 3
    assert sorted((r["cpu"], r["timestamp"]) for r in split.collect()) == [(0, 10), (0, 30), (1, 20)]
    (d / "2").write_bytes(b"\x00" * 25)
    with pytest.raises(Exception):
        raw.read_raw_per_cpu(spark, str(d)).collect()


def test_dictionary_files_merge(spark, tmp_path):
    old = tmp_path / "old_events.start"
    new = tmp_path / "traced_events.start"
    old.write_text("40 USER_EVT\n41 WAIT_PID\n")
    new.write_text("42 USER_EVT\n\n43 IGNORED\n")
    v = vars_from_table(dictionary_table(spark, [str(old), str(new)]))
    assert v["USER_EVT"] == "42" and v["WAIT_PID"] == "41" and v["TICK"] == "10" and "IGNORED" not in v


def _run_tar(path, members):
    with tarfile.open(path, "w") as tar:
        for name, data in members.items():
            b = data.encode()
            info = tarfile.TarInfo(f"x/{name}")
            info.size = len(b)
            tar.addfile(info, io.BytesIO(b))


def test_run_archives_to_summary(spark, tmp_path):
    base = tmp_path / "BENCH=phoronix" / "POWER=powersave-y" / "MONITORING=cpu-energy-meter" / "PHORONIX=redis" / "k1"
    base.mkdir(parents=True)
    doc = {"results": [{"test": "t1", "arguments": "a", "units": "u", "results": {"schedrecord": {"value": 2.5}}},
                       {"test": "t2", "arguments": "b", "units": "u", "results": {"schedrecord": {"value": "4.0"}}}]}
    _run_tar(str(base / "1.tar"), {
        "time.err": "noise\n12.25\n13.0\n",
        "run.out": "    transactions:   100   (45.67 per sec.)\n",
        "cpu-energy-meter.out": "\n".join([f"cpu{i}_package_joules={i}.5" for i in range(4)]
                                          + [f"cpu{i}_dram_joules=0.25" for i in range(3)]) + "\n",
        "phoronix.json": json.dumps(doc),
        "report.main.json": json.dumps({"kernel": {"version": "4.19.0"}}),
    })
    lines, docs, _ = runlogs.read_run_archives(spark, str(tmp_path))
    row = runs.traces_summary(lines, docs).first().asDict()
    assert row["POWER"] == "powersave-y" and row["PHORONIX"] == "redis" and row["MONITORING"] == "cpu-energy-meter"
    assert row["usr_bin_time"] == 12.25 and row["sysbench_trps"] == 45.67
    assert row["cpu3_package_joules"] == 3.5 and np.isnan(row["cpu3_dram_joules"])
    assert row["total_package_joules"] == 8.0 and np.isnan(row["total_dram_joules"]) and np.isnan(row["total_joules"])
    assert (row["phoro_test0"], row["phoro_value0"], row["phoro_test1"], row["phoro_value1"]) == ("t1", 2.5, "t2", 4.0)
    assert row["kernel"] == "4.19.0"
    files = runlogs.list_files(spark, str(tmp_path), ".tar", runs.TRACE_PATH_PATTERN).collect()
    assert len(files) == 1 and files[0]["length"] > 0


def test_text_helpers(spark, tmp_path):
    p = tmp_path / "ps.txt"
    p.write_text("  PID USER   COMMAND\n  12 root   /bin/sh -c  echo hi\n 7 me x\n")
    got = [tuple(r) for r in text.read_process_list(spark, str(p), ["PID", "USER", "COMMAND"]).collect()]
    assert got == [("12", "root", "/bin/sh -c echo hi"), ("7", "me", "x")]
    pv = text.preview(spark, str(p), limit=5).first()
    assert pv["length"] == p.stat().st_size and pv["text"] == "  PID"
    lines = text.synthetic_lines(spark, 1000, seed=3)
    r = lines.agg(F.count("*").alias("n"), F.max("y0").alias("m")).first()
    assert r["n"] == 1000 and r["m"] <= 159


def test_dictionary_from_dir(spark, tmp_path):
    from tracetide.sources.dictionary import dictionary_from_dir
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "old_events.start").write_text("50 OLD_ONLY\n51 BOTH\n")
    (tmp_path / "traced_events.start").write_text("52 BOTH\n")
    v = vars_from_table(dictionary_from_dir(spark, str(tmp_path), ["old_events.start", "traced_events.start"]))
    assert v["OLD_ONLY"] == "50" and v["BOTH"] == "52" and v["EXEC"] == "0"
