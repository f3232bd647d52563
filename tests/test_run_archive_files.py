"""Many small run archives: work by the file, not by the square of their number."""

from pyspark.sql import functions as F

from tracetide.sources import runlogs as R
from tracetide.sources import text as X
from tracetide.sources.raw import put_file


class Counted(list):
    seen = 0

    def __iter__(self):
        Counted.seen += 1
        return super().__iter__()


def test_new_files_are_found_in_one_pass(tmp_path, monkeypatch):
    names = [f"/x/{i}.tar" for i in range(500)]
    monkeypatch.setattr(R, "_list_archives", lambda path: names)
    monkeypatch.setattr(R, "seen_archives", lambda log: Counted(names[:300]))
    reader = R.RunArchiveStreamReader({"path": "/x", "seenlog": str(tmp_path)})
    assert reader.latestOffset() == {"files": 500} and R.new_archives("/x", str(tmp_path)) == names[300:]
    assert Counted.seen <= 4  # once for each of the 500 names before


def test_small_archives_share_batches(tmp_path):
    for i in range(40):
        put_file(f"{tmp_path}/{i:02d}.tar", R.run_archive_bytes([("a/time.err", "1.0\n2.0"), ("a/report.main.json", "{}")]))
    put_file(f"{tmp_path}/40.tar", b"no tar " * 200)
    reader = R.RunArchiveReader({"path": str(tmp_path), **{k.lower(): v for k, v in R.member_options(["time.err"], ["report.main.json"]).items()}})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [b.num_rows for b in batches] == [161]
    rows = batches[0].to_pylist()
    assert [(r["kind"], r["member"], r["no"], r["text"]) for r in rows[:4]] == [
        ("F", None, 0, None), ("L", "time.err", 0, "1.0"), ("L", "time.err", 1, "2.0"), ("D", "report.main.json", 0, "{}")]


def test_written_runs_of_mixed_rows(spark, tmp_path):
    """Rows of many runs in any order: each run's members whole and in order, also over batch ends."""
    lines = spark.range(30_000).select(F.concat(F.lit("r/"), (F.col("id") % 7).cast("string"), F.lit(".tar")).alias("path"), F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("member"),
                                       (-F.col("id")).alias("line_no"), F.col("id").cast("string").alias("line"))
    docs = spark.createDataFrame([("r/0.tar", "d.json", 5, "five"), ("r/0.tar", "d.json", 2, "two"), ("r/8.tar", "d.json", 1, "one")], "path string, member string, doc_no long, doc string")
    done = R.write_run_archives(lines.orderBy(F.rand(1)), docs, str(tmp_path)).collect()
    assert sorted(r.path for r in done) == [f"r/{i}.tar" for i in (0, 1, 2, 3, 4, 5, 6, 8)]
    got = {(r.path.split("/")[-1], r.member): (r.length, r.text) for r in X.preview_archives(spark, str(tmp_path)).collect()}
    for run in range(7):
        for m in range(3):
            body = "\n".join(str(i) for i in reversed(range(30_000)) if i % 7 == run and i % 3 == m)
            assert got[f"{run}.tar", f"logs/m{m}"] == (len(body), body)
    assert got["0.tar", "logs/d.json"] == (3, "two") and got["8.tar", "logs/d.json"] == (3, "one") and len(got) == 23
