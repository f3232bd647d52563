"""Operations on point / segment frames: interactive filter, viewports,
category exclusion, lanes, ranges, statistics and the hover sample."""

from __future__ import annotations

import tokenize
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import compile_query, decimal_exact, env_of, quoted
from ..vars import substitute

HOVER_MAX_ROWS = 100_000


@dataclass
class QueryResult:
    frame: DataFrame
    query: str
    applied: bool
    error: str | None = None


def apply_query(frame: DataFrame, text: str, variables: dict | None = None,
                listeners=()) -> QueryResult:
    """EXP16 / UDF5: ``$NAME`` substitution, blank -> identity; an invalid query
    or one with no rows falls back to the unfiltered frame.  Each listener is
    called with the result (e.g. to refresh statistics)."""
    result = _apply_query(frame, text, variables)
    for listener in listeners:
        listener(result)
    return result


def _apply_query(frame: DataFrame, text: str, variables: dict | None) -> QueryResult:
    try:
        text = substitute(text, variables or {}) if variables is not None else text
    except (KeyError, ValueError) as e:
        return QueryResult(frame, text, False, f"substitution: {e}")
    if text.strip() == "":
        return QueryResult(frame, text, False)
    try:
        filtered = frame.where(compile_query(text, env_of(frame)))
        filtered.schema  # analysis errors show here, before any job
    except (SyntaxError, KeyError, ValueError, TypeError, tokenize.TokenError, AnalysisException) as e:
        return QueryResult(frame, text, False, f"{type(e).__name__}: {e}")
    # a job that fails (an arithmetic error, a lost executor) is not a bad query: let it fail
    if filtered.isEmpty():
        return QueryResult(frame, text, False, "no rows")
    return QueryResult(filtered, text, True)


def point_viewport(xmin, xmax, ymin, ymax) -> Column:
    """EXP17: inclusive box on points."""
    return F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax)


def segment_viewport(xmin, xmax, ymin, ymax) -> Column:
    """EXP18 as stated: the first end inside, or the segment spanning the box,
    on each axis (the second end is not tested)."""
    def axis(a0, a1, lo, hi):
        inside = (F.col(a0) >= lo) & (F.col(a0) <= hi)
        spans = (F.col(a0) <= lo) & (F.col(a1) >= hi)
        return inside | spans
    return axis("x0", "x1", xmin, xmax) & axis("y0", "y1", ymin, ymax)


def segment_viewport_overlap(xmin, xmax, ymin, ymax) -> Column:
    """EXP18 variant: true interval overlap of the segment's box with the viewport (plain
    comparisons, so that a scan can skip by them)."""
    def axis(a0, a1, lo, hi):
        return ((F.col(a0) <= hi) | (F.col(a1) <= hi)) & ((F.col(a0) >= lo) | (F.col(a1) >= lo))
    return axis("x0", "x1", xmin, xmax) & axis("y0", "y1", ymin, ymax)


def hidden_categories(spec: dict) -> list:
    return [i for i, c in enumerate(spec["c"]) if c.get("hide_hovertool")]


def exclude_categories(frame: DataFrame, hidden: list) -> DataFrame:
    """EXP19: drop rows of categories flagged ``hide_hovertool``."""
    return frame.where(~F.col("c").isin(hidden)) if hidden else frame


def lanes(frame: DataFrame, lane_col: str = "y0", px_height: int = 4) -> DataFrame:
    """EXP20 / AGG11: number of distinct lanes, figure height and the y clamp."""
    n = F.count_distinct(quoted(lane_col))
    return frame.agg(n.cast("bigint").alias("lanes"),
                     ((n + 2) * px_height).cast("bigint").alias("height"),
                     F.lit(-1).cast("bigint").alias("ymin_clamp"),
                     (n + 1).cast("bigint").alias("ymax_clamp"))


def clamp_ranges(ranges: DataFrame) -> DataFrame:
    """Apply the lane clamp to a ranges row that carries ``lanes``."""
    return ranges.withColumns({
        "ymax": F.least(F.col("ymax"), (F.col("lanes") + 1).cast("double")),
        "ymin": F.greatest(F.col("ymin"), F.lit(-1.0)),
    })


def is_segments(frame: DataFrame) -> bool:
    return {"x0", "x1", "y0", "y1"} <= set(frame.columns)


def data_ranges(frame: DataFrame) -> DataFrame:
    """AGG4 / AGG5 / AGG6: one row (xmin, xmax, ymin, ymax) in a single pass."""
    if is_segments(frame):
        return frame.agg(
            F.least(F.min("x0"), F.min("x1")).cast("double").alias("xmin"),
            F.greatest(F.max("x0"), F.max("x1")).cast("double").alias("xmax"),
            F.least(F.min("y0"), F.min("y1")).cast("double").alias("ymin"),
            F.greatest(F.max("y0"), F.max("y1")).cast("double").alias("ymax"))
    return frame.agg(F.min("x").cast("double").alias("xmin"), F.max("x").cast("double").alias("xmax"),
                     F.min("y").cast("double").alias("ymin"), F.max("y").cast("double").alias("ymax"))


def category_stats(frame: DataFrame) -> DataFrame:
    """AGG1: per category ``c``: mean, sum and count of every other column,
    named ``<col>.mean`` / ``<col>.sum`` / ``<col>.count``.  NaN/NULL are
    skipped, infinities are values.  Sums of integers, and of doubles that are
    short decimals below 1e15, are exact (decimal) before the final double;
    other doubles are summed as doubles."""
    aggs = []
    for f in frame.schema.fields:
        if f.name == "c":
            continue
        col = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = F.when(~F.isnan(col), col)
            short = decimal_exact(v)
            total = F.when(F.bool_and(F.coalesce(short, F.lit(True))), F.sum(F.when(short, v.try_cast("decimal(38,10)"))).cast("double")) \
                .otherwise(F.sum(v.cast("double")))
        else:
            v = col
            total = F.sum(v.cast("decimal(38,0)")).cast("double")
        cnt = F.count(v)
        aggs += [(total / F.when(cnt > 0, cnt.cast("double"))).alias(f"{f.name}.mean"),
                 F.coalesce(total, F.lit(0.0)).alias(f"{f.name}.sum"),
                 cnt.cast("bigint").alias(f"{f.name}.count")]
    return frame.groupBy("c").agg(*aggs)


def hover_sample(frame: DataFrame, viewport: Column, hidden: list,
                 max_rows: int = HOVER_MAX_ROWS, seed: int = 7, keys: list | None = None) -> DataFrame:
    """WIN8: rows in the viewport outside hidden categories; when more than
    ``max_rows`` match, about ``max_rows`` of them chosen by a seeded hash of
    the row's values, or of its ``keys`` (the same rows on every run, whatever
    the partitioning)."""
    rows = exclude_categories(frame.where(viewport), hidden)
    n = rows.count()
    if n > max_rows:
        scale = 1 << 32
        values = F.concat_ws("|", F.lit(str(seed)), *[quoted(c).cast("string") for c in (keys or rows.columns)])
        h = F.conv(F.substring(F.md5(values.cast("binary")), 1, 8), 16, 10).cast("bigint")
        return rows.where(h < F.lit(int(scale * max_rows / n)))
    return rows


def scatter(frame: DataFrame, x: str, y: str, position: str = "index") -> DataFrame:
    """RUN5: any two columns (or the row position ``index``) as x, y."""
    from .order import with_position
    needs_pos = position in (x, y)
    df = frame
    if needs_pos:
        order_col = "fname" if "fname" in frame.columns else frame.columns[0]
        df = with_position(frame, [order_col], position)
    return df.select(quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y"))


@dataclass
class InteractiveView:
    query: QueryResult
    ranges: tuple
    stats: DataFrame
    hover: DataFrame
    raster: DataFrame


def interactive_view(frame: DataFrame, text: str, variables: dict | None, width: int, height: int,
                     hidden: list = (), viewport: tuple | None = None) -> InteractiveView:
    """The interactive update: apply the query (with fallback), cut the lineage
    of the result once, then its statistics, hover sample and raster over the
    viewport (default: the result's own range)."""
    from ..config import materialize
    from . import raster as _raster
    res = apply_query(materialize(frame), text, variables)
    result = res.frame if not res.applied else materialize(res.frame)
    r = data_ranges(result).first()
    box = viewport or (r["xmin"], r["xmax"], r["ymin"], r["ymax"])
    if is_segments(result):
        view = segment_viewport(*box)
        img = _raster.segment_raster(result, box[:2], box[2:], width, height)
    else:
        view = point_viewport(*box)
        img = _raster.point_raster(result, box[:2], box[2:], width, height)
    return InteractiveView(res, box, category_stats(result), hover_sample(result, view, list(hidden)), img)
