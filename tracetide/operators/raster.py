"""Rasterisation of point / segment frames into per-pixel category counts.

The raster is sparse: ``(px, py, c, n)`` rows for non-empty cells only.
Both rasters aggregate with a map-side partial count before the shuffle, so
the shuffled volume is bounded by the canvas size per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hex_channel


def _pixel(v: Column, lo: float, hi: float, size: int) -> Column:
    """Continuous pixel coordinate: (v - lo) * size / (hi - lo)."""
    span = float(hi) - float(lo)
    if span == 0:
        return F.lit(0.0)
    return (v.cast("double") - F.lit(float(lo))) * F.lit(float(size)) / F.lit(span)


def _cell(f: Column, size: int) -> Column:
    """Pixel index; the upper bound falls in the last pixel."""
    return F.least(F.floor(f), F.lit(size - 1)).cast("int")


def point_raster(frame: DataFrame, x_range, y_range, width: int, height: int) -> DataFrame:
    """AGG7: count points per pixel and category; points outside the ranges drop."""
    (xmin, xmax), (ymin, ymax) = x_range, y_range
    inside = F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax)
    return (frame.where(inside)
                 .select(_cell(_pixel(F.col("x"), xmin, xmax, width), width).alias("px"),
                         _cell(_pixel(F.col("y"), ymin, ymax, height), height).alias("py"),
                         F.col("c").cast("int").alias("c"))
                 .groupBy("px", "py", "c").agg(F.count(F.lit(1)).alias("n")))


def clip_segments(frame: DataFrame, x_range, y_range) -> DataFrame:
    """Liang-Barsky clipping of (x0,y0)-(x1,y1) to the viewport, as columns.

    Adds ``cx0, cy0, cx1, cy1``; segments entirely outside are dropped.
    """
    (xmin, xmax), (ymin, ymax) = x_range, y_range
    x0, y0 = F.col("x0").cast("double"), F.col("y0").cast("double")
    dx = F.col("x1").cast("double") - x0
    dy = F.col("y1").cast("double") - y0
    edges = [(-dx, x0 - F.lit(float(xmin))), (dx, F.lit(float(xmax)) - x0),
             (-dy, y0 - F.lit(float(ymin))), (dy, F.lit(float(ymax)) - y0)]
    reject = F.lit(False)
    lows, highs = [F.lit(0.0)], [F.lit(1.0)]
    for p, q in edges:
        reject = reject | ((p == 0) & (q < 0))
        lows.append(F.when(p < 0, q / F.when(p != 0, p)))
        highs.append(F.when(p > 0, q / F.when(p != 0, p)))
    t0, t1 = F.greatest(*lows), F.least(*highs)
    staged = frame.withColumns({"_tt_t0": t0, "_tt_t1": t1, "_tt_rej": reject})
    t0c, t1c = F.col("_tt_t0"), F.col("_tt_t1")
    return (staged.where(~F.col("_tt_rej") & (t0c <= t1c))
                  .withColumns({"cx0": x0 + t0c * dx, "cy0": y0 + t0c * dy,
                                "cx1": x0 + t1c * dx, "cy1": y0 + t1c * dy})
                  .drop("_tt_t0", "_tt_t1", "_tt_rej"))


def segment_raster(frame: DataFrame, x_range, y_range, width: int, height: int) -> DataFrame:
    """AGG8: every pixel a (clipped) segment crosses counts once.

    Pixels along the segment follow a DDA between the end pixels with
    ``n = max(|dx|, |dy|)`` steps, rounding half up in integer arithmetic.
    """
    (xmin, xmax), (ymin, ymax) = x_range, y_range
    clipped = clip_segments(frame, x_range, y_range)
    ends = clipped.select(
        _cell(_pixel(F.col("cx0"), xmin, xmax, width), width).alias("ax"),
        _cell(_pixel(F.col("cy0"), ymin, ymax, height), height).alias("ay"),
        _cell(_pixel(F.col("cx1"), xmin, xmax, width), width).alias("bx"),
        _cell(_pixel(F.col("cy1"), ymin, ymax, height), height).alias("by"),
        F.col("c").cast("int").alias("c"))
    # equal ends are counted before they are spread over their pixels; the
    # number of different ends is bounded by the canvas, not by the rows
    ends = ends.groupBy("ax", "ay", "bx", "by", "c").agg(F.count(F.lit(1)).alias("_tt_m"))
    ddx, ddy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    steps = F.greatest(F.abs(ddx), F.abs(ddy))
    staged = ends.withColumns({"_tt_dx": ddx, "_tt_dy": ddy, "_tt_n": steps})
    i = F.col("_tt_i")
    n = F.col("_tt_n")

    def along(a: str, d: str) -> Column:
        # a + round_half_up(d * i / n) == a + floor((2*d*i + n) / (2*n))
        return F.col(a) + F.when(n == 0, F.lit(0)).otherwise(
            F.floor((F.col(d) * i * 2 + n) / (n * 2)).cast("int"))

    return (staged.withColumn("_tt_i", F.explode(F.sequence(F.lit(0), F.col("_tt_n"))))
                  .select(along("ax", "_tt_dx").alias("px"), along("ay", "_tt_dy").alias("py"), "c", "_tt_m")
                  .groupBy("px", "py", "c").agg(F.sum("_tt_m").alias("n")))


def shade(raster: DataFrame, categories: DataFrame) -> DataFrame:
    """AGG9: per pixel, count-weighted mean of the category colours (r, g, b
    rounded half up), opaque (alpha 255) wherever the total count is > 0."""
    pal = categories.select(F.col("c").cast("int").alias("c"),
                            hex_channel(F.col("color"), 0).alias("r"),
                            hex_channel(F.col("color"), 1).alias("g"),
                            hex_channel(F.col("color"), 2).alias("b"))
    joined = raster.join(F.broadcast(pal), on="c", how="inner")  # one row per category: bounded
    total = F.sum("n")

    def channel(ch: str) -> Column:
        s = F.sum(F.col("n") * F.col(ch))
        return F.floor((s * 2 + total) / (total * 2)).cast("int").alias(ch)

    return (joined.groupBy("px", "py")
                  .agg(channel("r"), channel("g"), channel("b"),
                       F.lit(255).alias("a"), total.cast("bigint").alias("n")))


def legend(category_counts: DataFrame) -> DataFrame:
    """AGG10: (c, label, color, n) of the categories that have rows."""
    return category_counts.where(F.col("n") > 0).select("c", "label", "color", "n")
