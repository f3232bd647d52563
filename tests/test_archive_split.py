"""Trace archives read in parts: stored members by several tasks, compressed ones as a stream."""

import io
import tarfile

import numpy as np
import pytest

from tracetide.sources import archive


def columns(n):
    rnd = np.random.default_rng(n)
    return {"timestamp": np.sort(rnd.integers(0, 10**12, n)), "cpu": rnd.integers(0, 8, n).astype("int32"),
            "load": rnd.random(n), "up": rnd.random(n) < 0.5, "name": np.array([f"n{i % 13}" for i in range(n)], dtype="<U5")}


def tasks(df):
    return [p for p in df.rdd.mapPartitions(lambda rows: [[r["idx"] for r in rows]]).collect() if p]


@pytest.mark.parametrize("compressed", [False, True])
def test_large_archive_is_read_by_position(spark, tmp_path, compressed):
    n = 10_007
    cols = columns(n)
    archive.write_trace_archive(str(tmp_path / "a.tar"), cols, compressed)
    archive.write_trace_archive(str(tmp_path / "b.tar"), columns(3), compressed)
    df = archive.read_trace_archives(spark, str(tmp_path), split_bytes=40_000)
    rows = sorted((r for r in df.collect() if r["trace"].endswith("a.tar")), key=lambda r: r["idx"])
    assert [r["idx"] for r in rows] == list(range(n))
    for name, values in cols.items():
        assert [r[name] for r in rows] == values.tolist()
    held = tasks(df.where(df["trace"].endswith("a.tar")))
    assert len(held) > 5 if not compressed else len(held) == 1
    only = archive.read_trace_archives(spark, str(tmp_path), only=["load"], split_bytes=40_000)
    assert sorted(r["load"] for r in only.collect()) == sorted([*cols["load"], *columns(3)["load"]])


def test_batches_join_up_and_own_idx_is_kept(spark, tmp_path):
    n = 1000
    archive.write_trace_archive(str(tmp_path / "a.tar"), {"idx": np.arange(n) * 2, "v": np.arange(n) % 7}, False)
    schema = archive.archive_schema(spark, str(tmp_path))
    for split in (900, 1 << 30):
        reader = archive.ArchiveReader({"path": str(tmp_path), "splitBytes": str(split), "batchRows": "64"}, schema)
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [r["idx"] for r in got] == list(range(0, 2 * n, 2)) and [r["v"] for r in got] == [i % 7 for i in range(n)]
        assert all(b.num_rows <= 64 for p in reader.partitions() for b in reader.read(p))


def test_lengths_that_differ_mixed_storage_and_empty_archives(spark, tmp_path):
    archive.write_trace_archive(str(tmp_path / "bad.tar"), {"a": np.arange(3), "b": np.arange(4)}, False)
    with pytest.raises(Exception, match="different lengths"):
        archive.read_trace_archives(spark, str(tmp_path / "bad.tar")).collect()
    with tarfile.open(tmp_path / "mixed.tar", "w") as tar:
        for name, save in (("a", np.savez), ("b", np.savez_compressed)):
            buf = io.BytesIO()
            save(buf, **{name: np.arange(50)})
            info = tarfile.TarInfo(f"d/{name}.npz")
            info.size = len(buf.getvalue())
            tar.addfile(info, io.BytesIO(buf.getvalue()))
    got = archive.read_trace_archives(spark, str(tmp_path / "mixed.tar"), split_bytes=500).collect()
    assert sorted((r["idx"], r["a"], r["b"]) for r in got) == [(i, i, i) for i in range(50)]
    archive.write_trace_archive(str(tmp_path / "none.tar"), {"a": np.empty(0, dtype="int64")}, False)
    assert archive.read_trace_archives(spark, str(tmp_path / "none.tar"), split_bytes=100).count() == 0


def test_a_writing_task_holds_a_bounded_number_of_bytes(spark, tmp_path):
    """Wide or many rows of one task are cut into archives by their bytes, and read back in small batches."""
    df = spark.range(0, 1_300_000, 1, 1).selectExpr("id idx", "id * 3 a", "id * 5 b", "cast(id as double) c")
    done = archive.write_trace_archives(df, str(tmp_path)).collect()
    assert sum(r["rows"] for r in done) == 1_300_000 and max(r["rows"] for r in done) * 32 < 34 << 20
    assert archive.ArchiveReader.BATCH_ROWS * (4 * 8 + 200) < 16 << 20  # the archive's path stands in each row
    got = archive.read_trace_archives(spark, str(tmp_path)).selectExpr("count(*)", "sum(a)", "sum(b)", "sum(c)", "count(distinct idx)").first()
    s = 1_300_000 * 1_299_999 // 2
    assert tuple(got) == (1_300_000, 3 * s, 5 * s, float(s), 1_300_000)
