"""Stored frames: a viewport reads few rows and finds what a scan finds."""

import math

import pytest
from pyspark.sql import functions as F

from tracetide.operators import frame_ops as fo
from tracetide.sources import frames, text


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def scanned(spark, df):
    """(rows, rows that the scan handed on) -- what row-group statistics let pass."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        rows = rows_of(df)
        plan = df._jdf.queryExecution().executedPlan()
        return rows, plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_points_zoom(spark, tmp_path):
    n = 60_000
    points = spark.range(n).select((F.pmod(F.col("id") * 48271, F.lit(10007))).cast("double").alias("x"),
                                   (F.pmod(F.col("id") * 69621, F.lit(997))).cast("double").alias("y"),
                                   F.lit(1).alias("c"), F.col("id").alias("pid"))
    path = str(tmp_path / "p")
    frames.write_frame(points, path, files=4, row_group_bytes=1 << 14)
    box = (1000.0, 1400.0, 100.0, 160.0)
    got, read = scanned(spark, frames.read_viewport(spark, path, *box))
    assert got == rows_of(points.where(fo.point_viewport(*box))) and got
    assert read < n / 8
    assert spark.read.parquet(path).count() == n


@pytest.mark.parametrize("overlap", [False, True])
def test_segments_zoom_with_long_ones_nulls_and_reversed_ends(spark, tmp_path, overlap):
    n = 60_000
    x = F.pmod(F.col("id") * 48271, F.lit(10007)).cast("double")
    y = F.pmod(F.col("id") * 69621, F.lit(97)).cast("double")
    length = F.when(F.col("id") % 1000 == 0, 9000.0).when(F.col("id") % 7 == 0, -3.0).otherwise(2.0)
    segments = spark.range(n).select(x.alias("x0"), y.alias("y0"),
                                     F.when(F.col("id") % 5000 == 1, F.lit(float("nan"))).when(F.col("id") % 5000 == 2, None)
                                     .otherwise(x + length).alias("x1"), (y + 0.5).alias("y1"), F.col("id"))
    path = str(tmp_path / "s")
    frames.write_frame(segments, path, files=4, row_group_bytes=1 << 14)
    box = (3000.0, 3300.0, 20.0, 30.0)
    condition = fo.segment_viewport_overlap(*box) if overlap else fo.segment_viewport(*box)
    got, read = scanned(spark, frames.read_viewport(spark, path, *box, overlap=overlap))
    assert got == rows_of(segments.where(condition)) and got
    assert read < n / 4


def test_overlap_agrees_with_the_box_test(spark):
    values = [None, float("nan"), -1.0, 0.0, 0.5, 1.0, 2.0]
    pairs = spark.createDataFrame([(a, b, 0.0, 0.0) for a in values for b in values], "x0 double, x1 double, y0 double, y1 double")
    old = (F.least("x0", "x1") <= 1.0) & (F.greatest("x0", "x1") >= 0.0)
    assert rows_of(pairs.where(old)) == rows_of(pairs.where(fo.segment_viewport_overlap(0.0, 1.0, -1.0, 1.0)))


def test_frames_of_no_rows_one_point_and_one_value(spark, tmp_path):
    schema = "x double, y double, c int"
    for n, rows in enumerate(([], [(1.0, 2.0, 0)], [(1.0, 2.0, 0)] * 3000, [(None, 1.0, 0), (math.nan, 1.0, 0), (1.0, 1.0, 0)])):
        path = str(tmp_path / str(n))
        frame = spark.createDataFrame(rows, schema)
        frames.write_frame(frame, path, files=3)
        assert spark.read.parquet(path).count() == len(rows)
        assert rows_of(frames.read_viewport(spark, path, 0.0, 5.0, 0.0, 5.0)) == rows_of(frame.where(fo.point_viewport(0.0, 5.0, 0.0, 5.0)))
    parts = spark.read.parquet(str(tmp_path / "2")).groupBy(F.input_file_name()).count().collect()
    assert len(parts) == 3 and max(r["count"] for r in parts) < 2000  # equal rows do not stay in one file


def test_synthetic_lines_of_ids(spark):
    ids = spark.createDataFrame([(0,), (-1,), (2**40,), (None,)], "id long")
    rows = text.synthetic_lines_of(ids, "id").collect()
    assert len(rows) == 4
    known = [r for r in rows if r["x0"] is not None]
    assert all(0 <= r["x0"] < 1e9 and r["x0"] == r["x1"] and 0 <= r["y0"] < 160 and r["y1"] == r["y0"] + 0.5 and 0 <= r["c"] < 20 for r in known)
