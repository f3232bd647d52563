"""Stored point and segment frames that a viewport reads in part (EXP17 / EXP18).

Rows are written in the order of a space-filling curve: each axis is cut into cells of about equal
numbers of rows, the bits of the two cell numbers are interleaved, and files and row groups
follow that order. The viewport's own condition then skips row groups by their minima and maxima, and
still decides each row that is read. Segments are ordered by their first end, long ones apart
from short ones (by powers of two of the cell width), so that one long segment does not widen the
range of a row group of short ones. Rows with a null or NaN coordinate lie apart too, as a NaN would hide the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame_ops import is_segments, point_viewport, segment_viewport, segment_viewport_overlap

BITS = 6
QUANTILE_ERROR = 1 / 512
LONGEST = 8


def _cell(value: Column, bounds: list) -> Column:
    """Number of bounds at or below the value: at most ``2 ** BITS - 1`` literals, whatever the data."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value)) if bounds else F.lit(0)


def _interleaved(x: Column, y: Column) -> Column:
    z = F.lit(0)
    for bit in range(BITS):
        for shift, axis in ((1, x), (0, y)):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(axis, bit).bitwiseAND(F.lit(1)), 2 * bit + shift))
    return z


def _length_class(start: str, end: str, bounds: list) -> Column:
    """0 for segments up to a mean cell, then one class for each doubling, the last one open."""
    width = (bounds[-1] - bounds[0]) / len(bounds) if len(bounds) > 1 else 0.0
    if width <= 0:
        return F.lit(0)
    ratio = F.abs(F.col(end) - F.col(start)) / F.lit(width)
    return F.when(ratio <= 1, 0).otherwise(F.least(F.ceil(F.log2(ratio)), F.lit(LONGEST))).cast("int")


def write_frame(frame: DataFrame, path: str, files: int | None = None, row_group_bytes: int = 8 << 20) -> None:
    """Store a frame in the order of the curve.

    ``files``: number of files (default: ``spark.sql.shuffle.partitions``). ``row_group_bytes`` is the
    unit that a viewport can skip. The frame is read three times (quantiles, the sample of the range partitioning,
    the write): pass a stored one if it is dear. Rows that are equal in all columns are spread over
    files like any others.
    """
    segments = is_segments(frame)
    axes = ("x0", "y0") if segments else ("x", "y")
    ends = ("x1", "y1") if segments else ()
    sound = F.lit(True)
    for name in axes + ends:
        sound = sound & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    quantiles = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    found = frame.where(sound).select(*[F.col(a).cast("double").alias(a) for a in axes]) \
        .approxQuantile(list(axes), quantiles, QUANTILE_ERROR) or [[], []]
    bounds = [sorted(set(b)) for b in found]
    z = _interleaved(*[_cell(F.col(a).cast("double"), b) for a, b in zip(axes, bounds)])
    apart = F.lit(0)
    if segments:
        apart = F.greatest(_length_class("x0", "x1", bounds[0]), _length_class("y0", "y1", bounds[1]))
    n = files or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.when(sound, apart).otherwise(-1), F.when(sound, z).otherwise(-1), F.col(axes[0])]
    # the last key parts rows that are equal in everything else
    frame.repartitionByRange(n, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order) \
        .write.option("parquet.block.size", row_group_bytes).mode("overwrite").parquet(path)


def read_viewport(spark: SparkSession, path: str, xmin, xmax, ymin, ymax, overlap: bool = False) -> DataFrame:
    """Rows of a stored frame in the viewport; the condition is the one of a plain frame.

    ``overlap`` takes every segment whose box meets the viewport, otherwise EXP18 as stated.
    """
    frame = spark.read.parquet(path)
    if not is_segments(frame):
        return frame.where(point_viewport(xmin, xmax, ymin, ymax))
    return frame.where((segment_viewport_overlap if overlap else segment_viewport)(xmin, xmax, ymin, ymax))
