"""Helpers shared by the corpus operators: byte-level words, hashes, tables.

Texts are handled as the UTF-8 bytes of an Arrow column, several documents in
one numpy buffer, so tokenising, hashing and shingling are vectorised and no
Python object is made per word.
"""

from __future__ import annotations

import atexit
import gc
import pickle
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 19


def worker_cache(owner: str) -> dict:
    """A dictionary of the Python process for ``owner``; another owner's things go.

    Functions are shipped to the workers by value, so a module global would be
    built again in every task; and workers are used again by later stages.
    """
    kept = sys.modules.setdefault("_tracetide_worker_cache", types.ModuleType("_tracetide_worker_cache")).__dict__
    if owner != "broadcast" and kept.get("owner") != owner:
        kept["owner"], kept["held"] = owner, {}
    return kept if owner == "broadcast" else kept["held"]

def broadcast(spark: SparkSession, value):
    """A function that gives ``value`` in any task: sent once to each executor, its classes by value."""
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        cache = worker_cache("broadcast")
        if cache.get("broadcast", (None,))[0] != key:
            cache["broadcast"] = key, pickle.loads(sent.value)
        return cache["broadcast"][1]

    return get


SHINGLE = 5

U64 = np.uint64


_MADE: list = []


def _remove_made() -> None:
    for spark, path in _MADE:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session has ended before
            return


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the cluster; it goes when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_remove_made)
    _MADE.append((spark, path))
    return path


# While a table is written: small batches to the Python workers and from Parquet, so
# that rows with whole texts or sets do not add up.
_WHILE_STORING = {"spark.sql.execution.arrow.maxBytesPerBatch": "16m", "spark.sql.parquet.columnarReaderBatchSize": "512"}
_ROW_GROUP = 32 << 20


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back.

    Used instead of checkpoint() where the columnar, compressed form matters.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = {k: spark.conf.get(k, None) for k in _WHILE_STORING}
    try:
        for k, v in _WHILE_STORING.items():
            spark.conf.set(k, v)
        df.write.option("parquet.block.size", str(_ROW_GROUP)).parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote, once all that reads them has been written.

    The driver's garbage is collected too: Spark keeps the shuffle files of a finished query
    until the driver has let go of its plan.
    """
    spark = frames[0].sparkSession
    for df in frames:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _MADE.remove((spark, df.stored_path))
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def doc_crc(col="doc_id"):
    """crc32 of the id written as decimal text (the fold rule of the queries)."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def splitmix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_u64(n: int, seed: int, skip: int = 0) -> np.ndarray:
    """Numbers ``skip`` to ``skip + n - 1`` of the sequence of ``seed``."""
    return splitmix(np.arange(skip + 1, skip + n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string/binary array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_chunks(col, limit: int = CHUNK_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) of at most about ``limit`` bytes."""
    data, off = column_bytes(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAB_POS = 64
_TAB = random_u64(_TAB_POS * 256, 0x5EED)


def words_of(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = _SPACE):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each document in the buffer, A-Z lowered.

    ``breaks`` marks the bytes that part words, if others are wanted.

    Returns (lowered bytes, word starts, word ends, document of each word).
    """
    n = len(data)
    if n == 0:
        e = np.empty(0, np.int64)
        return data, e, e, e
    low = _LOWER[data]
    word = ~breaks[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    # empty documents share an offset: the last document starting there holds the bytes
    doc = np.searchsorted(off, starts, "right") - 1
    return low, starts, ends, doc


def byte_breaks(*word_ranges: tuple[int, int]) -> np.ndarray:
    """Marks of the bytes that part words: all outside ``word_ranges`` (first, last)."""
    out = np.ones(256, bool)
    for lo, hi in word_ranges:
        out[lo:hi + 1] = False
    return out


def word_array(data: np.ndarray, off: np.ndarray, breaks: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of the buffer as an Arrow string array, A-Z lowered, and the document of each."""
    low, starts, ends, doc = words_of(data, off, breaks)
    cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    packed = np.ascontiguousarray(low[~breaks[data]]) if len(data) else low
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(packed)]), doc


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit tabulation hash of each word (position in word x byte)."""
    if len(starts) == 0:
        return np.empty(0, U64)
    length = ends - starts
    total = int(length.sum())
    begin = np.cumsum(length) - length
    pos = np.arange(total, dtype=np.int64) - np.repeat(begin, length)
    byte = low[np.repeat(starts, length) + pos]
    val = _TAB[(pos & (_TAB_POS - 1)) * 256 + byte]
    if int(length.max()) > _TAB_POS:
        val = val * ((pos >> 6).astype(U64) * U64(0x9E3779B97F4A7C16) + U64(1))
    return splitmix(np.add.reduceat(val, begin) + length.astype(U64) * U64(0xD6E8FEB86659FD93))


_MIXERS = random_u64(SHINGLE, 0xABCD) | U64(1)


def shingles_of(wh: np.ndarray, doc: np.ndarray, n_docs: int, size: int = SHINGLE):
    """Hashes of the shingles of ``size`` (at most SHINGLE) words: (hash, document), not yet distinct.

    A document of fewer words has its whole word sequence as one shingle.
    """
    n = len(wh)
    if n == 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    counts = np.bincount(doc, minlength=n_docs)
    out_h, out_d = [], []
    if n >= size:
        full = np.flatnonzero(doc[:n - size + 1] == doc[size - 1:])
        h = np.zeros(n - size + 1, U64)
        for k in range(size):
            h += wh[k:n - size + 1 + k] * _MIXERS[k]
        out_h.append(splitmix(h[full]))
        out_d.append(doc[full])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(doc, short)
        h = np.full(len(short), 0x51A7, U64) + counts[short].astype(U64)
        for k in range(size - 1):
            has = counts[short] > k
            h[has] += wh[first[has] + k] * _MIXERS[k]
        out_h.append(splitmix(h ^ U64(0xF00DF00DF00DF00D)))
        out_d.append(short)
    return np.concatenate(out_h), np.concatenate(out_d)


def distinct_by_doc(h: np.ndarray, doc: np.ndarray):
    """Distinct (document, hash) pairs, ordered by document, then hash."""
    if len(h) == 0:
        return h, doc
    order = np.lexsort((h, doc)) if len(np.unique(doc)) > 1 else np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def i64(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node in ``edges``.

    Alternating large-star / small-star rounds; each round is a pair of
    aggregates, so no component is ever gathered.  The edge list is cut with a
    checkpoint in each round.  Stars of a hot node are plain aggregates and
    joins whose small side is one row per node.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u to u's minimum
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v")
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, to u's minimum
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        same = e.exceptAll(nxt).isEmpty() and nxt.count() == e.count()
        e = nxt
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
