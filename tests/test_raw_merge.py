"""Time-ordered record files merged by range: rows and numbers of the sorting reader."""

import random

import pytest

from tracetide.sources import raw, raw_merge


def write(root, seed, files, most, span):
    rnd = random.Random(seed)
    root.mkdir()
    total = 0
    for n in range(files):
        folder = root / f"part{n % 3}"
        folder.mkdir(exist_ok=True)
        rows = sorted(rnd.choice([7, rnd.randrange(span)]) for _ in range(rnd.randrange(most)))
        raw.write_raw_file(str(folder / str(n // 3 * 5 % 11)), [(t, rnd.randrange(9), rnd.randrange(18), 0, -n) for t in rows])
        total += len(rows)
    return total


@pytest.mark.parametrize("seed, files, most, span, per_range, merge", [
    (1, 9, 400, 1000, 50, 1), (2, 9, 400, 5, 37, 200), (3, 1, 900, 50, 64, 1), (4, 12, 60, 10**9, 1, 1), (5, 9, 400, 1000, 1 << 22, 1 << 20)])
def test_merge_equals_the_sorting_reader(spark, tmp_path, monkeypatch, seed, files, most, span, per_range, merge):
    monkeypatch.setattr(raw_merge, "BLOCK", 4)
    total = write(tmp_path / "raw", seed, files, most, span)
    expected = sorted(tuple(r) for r in raw.read_raw_trace(spark, str(tmp_path / "raw")).collect())
    df = raw_merge.read_raw_merged(spark, str(tmp_path / "raw"), per_range, merge)
    assert len(expected) == total and sorted(tuple(r) for r in df.collect()) == expected
    parts = df.rdd.mapPartitions(lambda rows: [[r["idx"] for r in rows]]).collect()
    held = sorted(p for p in parts if p)
    assert [i for p in held for i in p] == list(range(total))  # each task's rows lie in order and without a gap
    if per_range < 100:
        assert max(map(len, held)) < total / 2  # the time 7, which half of all records share, is split


def test_merge_plan_has_no_exchange_and_no_sort(spark, tmp_path):
    write(tmp_path / "raw", 6, 6, 50, 100)
    text = raw_merge.read_raw_merged(spark, str(tmp_path / "raw"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Sort" not in text


def test_lower_bound_counts_smaller_keys(tmp_path, monkeypatch):
    import pyarrow.fs as pafs
    monkeypatch.setattr(raw_merge, "BLOCK", 2)
    rnd = random.Random(8)
    times = sorted(rnd.randrange(12) for _ in range(100))
    raw.write_raw_file(str(tmp_path / "3"), [(t, 0, 0, 0, 0) for t in times])
    part = raw.RawRecordsPartition(str(tmp_path / "3"), 3, 0, 100, 1000)
    run = raw_merge.Run(part).open(pafs.LocalFileSystem())
    keys = [(t, 3, 1000 + i) for i, t in enumerate(times)]
    for t in range(-1, 13):
        for cpu in (2, 3, 4):
            for off in (0, 1000, 1037, 1050, 1099, 1100, 5000):
                assert run.lower_bound((t, cpu, off)) == sum(k < (t, cpu, off) for k in keys)


def test_files_out_of_order_and_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert raw_merge.read_raw_merged(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    raw.write_raw_file(str(tmp_path / "bad" / "0"), [(t, 0, 0, 0, 0) for t in [1, 2, 9, 3, 4, 5, 6, 10, 11]])
    raw.write_raw_file(str(tmp_path / "bad" / "1"), [(t, 0, 0, 0, 0) for t in range(20)])
    for per_range in (3, 1 << 20):
        with pytest.raises(Exception, match="not in time order"):
            raw_merge.read_raw_merged(spark, str(tmp_path / "bad"), per_range).collect()
