"""Exact substring deduplication with a sparse suffix array (deep-shallow sorting).

A byte goes if it lies in a 400-byte string that starts anywhere else too.

1. Anchors.  The anchor of a 400-byte string is its leftmost 200-byte gram of
   smallest hash.  Equal strings have equal anchors at equal places, so only
   suffixes at anchors (one in about 100 bytes) are compared, and only with
   suffixes of an equal gram.  The strings of one anchor are neighbours: a
   segment, at most 600 bytes long.
2. Counts.  Segments are counted by gram and by content with map-side combine,
   so any number of copies costs one row for each task.  A segment that occurs
   twice is covered as a whole.
3. Suffix array.  The distinct segments of a gram are sorted by the suffixes at
   their anchors: multikey quicksort of 8-byte characters to a shallow depth,
   then blind tries for groups that still agree.  Neighbours' common prefixes
   (R bytes to the right of the anchor), joined from the longest down, and the
   common extension to the left (L) give every maximal match; it is kept where
   L + R reaches 400.
4. Groups of more than MAX_GROUP distinct segments are split by their 400-byte
   strings, counted with map-side combine, so no group is gathered.

Defined results: null text counts as empty; texts under 400 bytes lose nothing;
repeated rows are copies of each other; a null id is kept, but rows with it are
not told apart, so they are left as they are and match nothing, unless they are
named by :func:`numbered`; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_chunks, i64, random_u64, splitmix, stored, worker_cache

LENGTH = 400
GRAM = 200
SHALLOW = 32
MAX_GROUP = 4096
PIECE = 1 << 19  # bytes looked at together; position bits of an anchor's rank
_POS_BITS = 22
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def _powers(n: int):
    """Powers of the base and of its inverse, kept in the worker."""
    cache = worker_cache("suffix_dedup")
    if "powers" not in cache or len(cache["powers"][0]) < n:
        inv = U64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n, _BASE, U64), np.full(n, inv, U64)
        up[0] = down[0] = 1
        cache["powers"] = np.cumprod(up), np.cumprod(down)
    return cache["powers"]


_BYTE = random_u64(512, 0x5FF1C).reshape(2, 256)


def _sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[which][data] * up[:len(data)], out=out[1:])
    return out


def _hash_at(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    return splitmix((sums[end] - sums[start]) * down[start])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours (blockwise prefix and suffix minima)."""
    n = len(x)
    size = -(-n // w) * w
    y = np.full(size, np.iinfo(np.uint64).max, U64)
    y[:n] = x
    y = y.reshape(-1, w)
    pre = np.minimum.accumulate(y, axis=1).ravel()
    suf = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[:n - w + 1], pre[w - 1:n])


def _pieces(data, off, length):
    """(document, first byte, last byte) of pieces, each string in exactly one piece."""
    for d in range(len(off) - 1):
        s, e = int(off[d]), int(off[d + 1])
        while e - s >= length:
            stop = min(e, s + PIECE)
            yield d, s, stop
            s = stop - length + 1


def segments_of(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Segments of the documents in the buffer: (document, key, content, first start, strings, anchor - first start)."""
    out = []
    group, held = [], 0

    def flush():
        # short documents are looked at together, then strings that cross a border are left out
        buf = np.concatenate([data[s:e] for _, s, e in group]) if len(group) > 1 else data[group[0][1]:group[0][2]]
        size = np.array([e - s for _, s, e in group])
        end = np.cumsum(size)
        sums = _sums(buf)
        pos = np.arange(len(buf) - gram + 1)
        rank = _hash_at(sums, pos, pos + gram)
        low = U64((1 << _POS_BITS) - 1)
        best = _window_min((rank & ~low) | pos.astype(U64), length - gram + 1)
        at = (best & low).astype(np.int64)
        start = np.arange(len(at))
        owner = np.searchsorted(end, start, "right")
        ok = start + length <= end[owner]
        start, at, owner = start[ok], at[ok], owner[ok]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(start)))
        lo, anchor, own = start[first], at[first], owner[first]
        content = _hash_at(_sums(buf, 1), lo, lo + count - 1 + length) + count.astype(U64)
        doc = np.array([g[0] for g in group])[own]
        begin = np.array([g[1] for g in group])[own] - off[doc]
        out.append((doc, rank[anchor], content, lo - (end - size)[own] + begin, count, anchor - lo))

    for d, s, e in _pieces(data, off, length):
        if held + e - s > PIECE and group:
            flush()
            group, held = [], 0
        group.append((d, s, e))
        held += e - s
    if group:
        flush()
    return out


def segment_pass(src: DataFrame, length: int, gram: int) -> DataFrame:
    names = ["key", "content", "doc_id", "lo", "n", "rel"]

    def run(batches):
        for batch in batches:
            for i, j, data, off in byte_chunks(batch.column(1), PIECE):
                ids = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                for doc, key, content, lo, n, rel in segments_of(data, off, length, gram):
                    yield pa.RecordBatch.from_arrays([pa.array(i64(key)), pa.array(i64(content)), pa.array(ids[doc]), pa.array(lo),
                                                      pa.array(n.astype(np.int32)), pa.array(rel.astype(np.int32))], names=names)

    return src.mapInArrow(run, "key bigint, content bigint, doc_id bigint, lo bigint, n int, rel int")


# --- suffix sorting -------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] does not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _Node:
    __slots__ = ("depth", "kids", "leaf", "items")

    def __init__(self, depth, leaf=None):
        self.depth, self.kids, self.leaf, self.items = depth, {}, leaf, None


def blind_trie_sort(items: list[int], text: list[bytes], depth: int) -> list[int]:
    """Order of ``items`` (which agree on ``depth`` bytes) by a trie of branching bytes only.

    A suffix is led down by single bytes, compared in full with the leaf it
    meets, and put in where the two part.
    """

    def char(i, at):
        t = text[i]
        return t[at] if at < len(t) else -1

    def leaf(i):
        node = _Node(1 << 60, i)
        node.items = [i]
        return node

    root = leaf(items[0])
    for i in items[1:]:
        node = root
        while node.leaf is None:
            node = node.kids.get(char(i, node.depth)) or next(iter(node.kids.values()))
        other = node.leaf
        at = depth + common_prefix(text[i][depth:], text[other][depth:])
        if at == len(text[i]) == len(text[other]):
            node.items.append(i)
            continue
        parent, node = None, root
        while node.leaf is None and node.depth < at:
            parent, node = node, node.kids[char(i, node.depth)]
        if node.leaf is None and node.depth == at:
            node.kids[char(i, at)] = leaf(i)
            continue
        fork = _Node(at)
        fork.kids = {char(other, at): node, char(i, at): leaf(i)}
        if parent is None:
            root = fork
        else:
            parent.kids[char(i, parent.depth)] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.leaf is not None:
            out += node.items
        else:
            stack += [node.kids[c] for c in sorted(node.kids, reverse=True)]
    return out


def deep_shallow_sort(text: list[bytes], start: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Suffix order of ``text``, whose first ``start`` bytes agree."""
    out, stack = [], [(list(range(len(text))), start)]
    while stack:
        items, depth = stack.pop()
        if len(items) == 1 or depth < 0:
            out += items
            continue
        if depth >= start + shallow:
            out += blind_trie_sort(items, text, depth)
            continue
        pivot = text[items[len(items) // 2]][depth:depth + 8]
        less, same, more = [], [], []
        for i in items:
            c = text[i][depth:depth + 8]
            (same if c == pivot else less if c < pivot else more).append(i)
        if more:
            stack.append((more, depth))
        stack.append((same, depth + 8 if len(pivot) == 8 else -1))  # shorter ones end here and are equal
        if less:
            stack.append((less, depth))
    return out


def matches_of_group(left: list[bytes], right: list[bytes], length: int, gram: int) -> list[list[tuple[int, int]]]:
    """Maximal matches (L, R) with L + R >= length of each segment with any other one.

    ``left``: bytes before the anchor, reversed; ``right``: bytes from the
    anchor, which agree on the first ``gram``.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in left]
    order = deep_shallow_sort(right, gram)
    joins = sorted(((gram + common_prefix(right[a][gram:], right[b][gram:]), k) for k, (a, b) in enumerate(zip(order[:-1], order[1:], strict=True))), key=lambda x: -x[0])
    by_left = sorted(range(len(left)), key=lambda i: left[i])
    rank = [0] * len(left)
    for r, i in enumerate(by_left):
        rank[i] = r
    head = list(range(len(order)))
    sets = [[rank[i]] for i in order]

    def find(k):
        while head[k] != k:
            head[k] = head[head[k]]
            k = head[k]
        return k

    for r, k in joins:
        a, b = find(k), find(k + 1)
        if len(sets[a]) > len(sets[b]):
            a, b = b, a
        big = sets[b]
        for x in sets[a]:
            at = bisect_left(big, x)
            for y in big[max(0, at - 1):at + 1]:
                i, j = by_left[x], by_left[y]
                ext = common_prefix(left[i], left[j])
                if ext + r >= length:
                    out[i].append((ext, r))
                    out[j].append((ext, r))
        sets[b] = sorted(big + sets[a])
        sets[a] = []
        head[a] = b
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def sorted_groups(reps: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, content, spans relative to the segment's first byte) of groups of a bounded size."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def solve(rows):
        left = [t[:rel][::-1] for _, rel, t in rows]
        right = [t[rel:] for _, rel, t in rows]
        got = matches_of_group(left, right, length, gram)
        return [(c, _union([(rel - x, rel + r) for x, r in g])) for (c, rel, _), g in zip(rows, got, strict=True) if g]

    def run(batches):
        last, rows = None, []
        for batch in batches:
            keys, contents, spans = [], [], []

            def close():
                if len(rows) > 1:
                    for c, got in solve(rows):
                        keys.append(last)
                        contents.append(c)
                        spans.append([{"a": a, "b": b} for a, b in got])

            for key, c, rel, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != last:
                    close()
                    last, rows = key, []
                rows.append((c, rel, t))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contents, pa.int64()), pa.array(spans, kind)], names=["key", "content", "spans"])
        keys, contents, spans = [], [], []
        if len(rows) > 1:
            for c, got in solve(rows):
                keys.append(last)
                contents.append(c)
                spans.append([{"a": a, "b": b} for a, b in got])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contents, pa.int64()), pa.array(spans, kind)], names=["key", "content", "spans"])

    parts = reps.select("key", "content", "rel", "bytes").repartition("key").sortWithinPartitions("key", "content")
    return parts.mapInArrow(run, "key bigint, content bigint, spans array<struct<a:int,b:int>>")


def split_groups(reps: DataFrame, length: int) -> DataFrame:
    """As sorted_groups, for groups too large to gather: their strings are counted one by one."""
    names = ["key", "content", "at", "w1", "w2"]

    def run(batches):
        for batch in batches:
            for key, c, n, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = np.frombuffer(t, np.uint8)
                at = np.arange(n)
                w1, w2 = (_hash_at(_sums(data, k), at, at + length) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, c)), pa.array(at.astype(np.int32)),
                                                  pa.array(i64(w1)), pa.array(i64(w2))], names=names)

    strings = reps.select("key", "content", "n", "bytes").mapInArrow(run, "key bigint, content bigint, at int, w1 bigint, w2 bigint")
    twice = strings.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    hit = strings.join(twice, ["w1", "w2"]).groupBy("key", "content").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return hit.select("key", "content", F.transform("at", lambda x: F.struct(x.alias("a"), (x + length).cast("int").alias("b"))).alias("spans"))


def cut_bytes(docs: DataFrame, segs_of: DataFrame, length: int) -> DataFrame:
    """Bytes of the segments named in ``segs_of`` (key, content, doc_id, lo, n, rel)."""
    want = segs_of.groupBy("doc_id").agg(F.collect_list(F.struct("key", "content", "lo", "n", "rel")).alias("want"))
    names = ["key", "content", "n", "rel", "bytes"]

    def run(batches):
        for batch in batches:
            for t, want in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = t.as_buffer()
                yield pa.RecordBatch.from_arrays([pa.array([w["key"] for w in want], pa.int64()), pa.array([w["content"] for w in want], pa.int64()),
                                                  pa.array([w["n"] for w in want], pa.int32()), pa.array([w["rel"] for w in want], pa.int32()),
                                                  pa.array([raw[w["lo"]:w["lo"] + w["n"] - 1 + length].to_pybytes() for w in want], pa.binary())], names=names)

    return docs.join(want, "doc_id").select("t", "want").mapInArrow(run, "key bigint, content bigint, n int, rel int, bytes binary")


def repeated_spans(src: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, spans): byte spans [a, b) that repeated strings cover, for documents that have any.

    ``src``: doc_id (unique), t (binary).
    """
    segs = stored(segment_pass(src, length, gram))
    keys = segs.groupBy("key").agg(F.count("*").alias("c"), F.min("content").alias("c0"), F.max("content").alias("c1"))
    # written, so that both sides of the join are plain shuffles, whose hot keys Spark splits
    keys = stored(keys.where("c > 1").select("key", (F.col("c0") < F.col("c1")).alias("mixed")))
    hits = stored(segs.join(keys, "key"))
    whole = hits.where("not mixed").select("doc_id", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + length).alias("b"))

    mixed = hits.where("mixed").drop("mixed")
    reps = mixed.groupBy("key", "content").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "lo", "n", "rel")).alias("r"))
    reps = stored(reps.select("key", "content", "c", "r.*"))
    hot = reps.groupBy("key").count().where(F.col("count") > max_group).select("key")
    texts = stored(cut_bytes(src, reps, length))
    few, many = texts.join(hot, "key", "left_anti"), texts.join(hot, "key", "left_semi")
    solved = sorted_groups(few, length, gram).unionByName(split_groups(many, length))
    solved = reps.select("key", "content", "c").join(solved, ["key", "content"], "left")
    solved = stored(solved.where("c > 1 or spans is not null"))
    got = mixed.join(solved, ["key", "content"])
    full = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1 + length).cast("int").alias("b")))
    got = got.select("doc_id", "lo", F.explode(F.when(F.col("c") > 1, full).otherwise(F.col("spans"))).alias("s"))
    got = got.select("doc_id", (F.col("lo") + F.col("s.a")).alias("a"), (F.col("lo") + F.col("s.b")).alias("b"))
    return whole.unionByName(got).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def numbered(docs: DataFrame, doc_id: str = "doc_id", name: str = "row") -> DataFrame:
    """``docs`` with ``name``, a number of each row's own: the id, or if ids are null or shared a number that is written once."""
    ids = docs.groupBy(F.col(doc_id).cast("bigint").alias("id")).count()
    if ids.where("id is null or count > 1").isEmpty():
        return docs.withColumn(name, F.col(doc_id))
    return stored(docs.withColumn(name, F.monotonically_increasing_id()))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                max_group: int = MAX_GROUP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept (bytes), kept_text, n_bytes, removed (spans), n_removed, plus the ``keep`` columns.

    ``kept_text`` leaves out characters of which only some bytes were removed.
    """
    base = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.coalesce(docs[text].cast("string").cast("binary"), F.lit(b"")).alias("t"),
                       *[docs[c].alias(f"__keep_{c}") for c in keep])
    src = base.select("doc_id", "t").where("doc_id is not null")
    joined = base.join(repeated_spans(src, length, gram, max_group), "doc_id", "left")
    kept_cols = [f"__keep_{c}" for c in keep]
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        for batch in batches:
            ids, raw, spans = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            kept, size, removed, lost = [], [], [], []
            for t, got in zip(raw, spans, strict=True):
                t = t.as_py()
                cut = _union([(s["a"], s["b"]) for s in got]) if got else []
                at, out = 0, []
                for a, b in cut:
                    out.append(t[at:a])
                    at = b
                out.append(t[at:])
                kept.append(b"".join(out))
                size.append(len(t))
                removed.append([{"a": a, "b": b} for a, b in cut])
                lost.append(len(t) - len(kept[-1]))
            text = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.binary()), text, pa.array(size, pa.int64()), pa.array(removed, kind),
                                              pa.array(lost, pa.int64()), *batch.columns[3:]],
                                             names=["doc_id", "kept", "kept_text", "n_bytes", "removed", "n_removed", *kept_cols])

    rows = joined.select("doc_id", "t", "spans", *kept_cols)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept_cols).schema.fields) if keep else ""
    return rows.mapInArrow(run, "doc_id bigint, kept binary, kept_text string, n_bytes bigint, removed array<struct<a:bigint,b:bigint>>, n_removed bigint" + fields)
