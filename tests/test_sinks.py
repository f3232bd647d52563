"""Sinks: the result cache notices a rewritten trace, side columns join without a shuffle."""

import os

import pytest
from pyspark.sql import functions as F

from tracetide.sources import side_columns, sinks, versions

SPEC = {"c": [{"label": "a"}]}


def frame_of(spark, path):
    return spark.read.parquet(path).select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1).alias("c"))


def test_cache_notices_a_rewritten_trace(spark, tmp_path):
    trace, root = str(tmp_path / "trace"), str(tmp_path / "cache")
    spark.range(5).write.parquet(trace)
    assert sinks.cache_get(spark, root, trace, SPEC) is None
    sinks.cache_put(root, trace, SPEC, frame_of(spark, trace), {"len": 5})
    got, state = sinks.cache_get(spark, root, trace, SPEC)
    assert got.count() == 5 and state == {"len": 5} and dict(got.dtypes)["c"] == "int"
    assert sinks.cache_get(spark, root, trace, {"c": []}) is None
    spark.range(7).write.mode("overwrite").parquet(trace)
    assert sinks.cache_get(spark, root, trace, SPEC) is None
    sinks.cache_put(root, trace, SPEC, frame_of(spark, trace), {"len": 7})
    assert sinks.cache_get(spark, root, trace, SPEC)[0].count() == 7


def test_cache_entry_counts_once_it_is_published(spark, tmp_path, monkeypatch):
    trace, root = str(tmp_path / "trace"), str(tmp_path / "cache")
    spark.range(5).write.parquet(trace)

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(sinks, "publish", lost)
    with pytest.raises(RuntimeError):
        sinks.cache_put(root, trace, SPEC, frame_of(spark, trace), {})
    monkeypatch.undo()
    assert sinks.cache_get(spark, root, trace, SPEC) is None
    key = sinks.cache_put(root, trace, SPEC, frame_of(spark, trace), {"n": 1})
    sinks.cache_put(root, trace, SPEC, frame_of(spark, trace).limit(2), {"n": 2})
    frame, state = sinks.cache_get(spark, root, trace, SPEC)
    assert (frame.count(), state) == (2, {"n": 2})
    assert versions.delete_superseded(spark, os.path.join(root, key)) == 1
    assert sinks.cache_get(spark, root, trace, SPEC)[1] == {"n": 2}


def test_cache_does_not_publish_a_frame_of_an_older_trace(spark, tmp_path):
    trace, root = str(tmp_path / "trace"), str(tmp_path / "cache")
    spark.range(5).write.parquet(trace)
    key = sinks.cache_key(spark, trace, SPEC)
    frame = spark.createDataFrame(frame_of(spark, trace).collect())
    spark.range(6).write.mode("append").parquet(trace)
    assert sinks.cache_put(root, trace, SPEC, frame, {}, key=key) is None
    assert sinks.cache_get(spark, root, trace, SPEC) is None


def test_cache_errors_are_not_misses(spark, tmp_path):
    trace, root = str(tmp_path / "trace"), str(tmp_path / "cache")
    spark.range(5).write.parquet(trace)
    key = sinks.cache_put(root, trace, SPEC, frame_of(spark, trace), {})
    base = os.path.join(root, key)
    with open(os.path.join(base, "published", "9" * 20 + "-x"), "w"):
        pass  # a published name without its version
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.cache_get(spark, root, trace, SPEC)


@pytest.fixture(autouse=True)
def same_options_after(spark):
    names = ("spark.sql.legacy.bucketedTableScan.outputOrdering", "spark.sql.requireAllClusterKeysForCoPartition")
    old = {name: spark.conf.get(name) for name in names}
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


@pytest.fixture()
def side_root(spark, tmp_path):
    root = str(tmp_path / "side")
    trace = spark.range(5000).select(F.col("id").alias("idx"), (F.col("id") % 7).alias("cpu"), (F.col("id") * 3).alias("timestamp"))
    side_columns.write_side_trace(trace.orderBy(F.hash("idx")), root, bucket_rows=640)
    return root


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_side_columns_join_without_exchange_or_sort(spark, side_root):
    base = side_columns.read_side_trace(spark, side_root)
    side_columns.add_side_column(base.withColumn("a", F.col("cpu") + 1), "a", side_root)
    side_columns.add_side_column(base.where("idx % 2 = 0").withColumn("b.c", F.col("cpu") * 2), "b.c", side_root)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = side_columns.read_side_trace(spark, side_root, ["cpu"], ["a", "b.c"])
        text = physical(df)
        assert text.count("SortMergeJoin") == 2
        assert "Exchange" not in text and "Sort [" not in text
        assert "timestamp" not in text
        rows = {r["idx"]: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(rows) == 5000 and df.columns == ["idx", "cpu", "a", "b.c"]
    assert all(r["a"] == i % 7 + 1 and r["b.c"] == (None if i % 2 else i % 7 * 2) for i, r in rows.items())


def test_side_column_is_replaced_as_a_whole_and_read_by_another_session(spark, side_root, monkeypatch):
    base = side_columns.read_side_trace(spark, side_root)
    side_columns.add_side_column(base.withColumn("a", F.lit(1)), "a", side_root)
    with monkeypatch.context() as m:
        m.setattr(side_columns, "publish", lambda *_: None)  # a writer that is lost
        side_columns.add_side_column(base.withColumn("a", F.lit(2)), "a", side_root)
    assert side_columns.read_side_trace(spark, side_root, [], ["a"]).agg(F.max("a")).first()[0] == 1
    side_columns.add_side_column(base.withColumn("a", F.lit(3)), "a", side_root)
    for row in spark.sql("SHOW TABLES LIKE 'tracetide_*'").collect():
        spark.sql(f"DROP TABLE {row['tableName']}")  # the catalog of a new session does not know them
    df = side_columns.read_side_trace(spark, side_root, ["cpu"], ["a"])
    assert df.agg(F.min("a"), F.max("a"), F.count("cpu")).first()[:] == (3, 3, 5000)
    with pytest.raises(FileNotFoundError):
        side_columns.read_side_trace(spark, side_root, side=["none"])


def test_side_columns_follow_the_layout_of_the_trace(spark, side_root):
    side_columns.add_side_column(side_columns.read_side_trace(spark, side_root).withColumn("a", F.lit(1)), "a", side_root)
    side_columns.write_side_trace(spark.range(10).select(F.col("id").alias("idx")), side_root, bucket_rows=2)
    with pytest.raises(ValueError, match="another layout"):
        side_columns.read_side_trace(spark, side_root, side=["a"])


def test_side_trace_of_no_rows_and_of_rows_without_idx(spark, tmp_path):
    for n, rows in enumerate(([], [(None, 1), (1, 2)])):
        root = str(tmp_path / str(n))
        trace = spark.createDataFrame(rows, "idx long, cpu long")
        side_columns.write_side_trace(trace, root)
        side_columns.add_side_column(trace.withColumn("a", F.col("cpu") * 10), "a", root)
        got = side_columns.read_side_trace(spark, root, side=["a"]).collect()
        assert sorted(((r.idx, r.cpu, r.a) for r in got), key=repr) == sorted([(i, c, None if i is None else c * 10) for i, c in rows], key=repr)
