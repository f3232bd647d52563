"""N-gram Jaccard join: exact links at a similarity of 0.75, by signature trees.

A document's set holds its distinct 5-word shingles (64-bit hashes).  Two sets
link when ``100 * |x & y| >= 75 * |x | y|``, so two linked sets of sizes n and
m share at least ``3/7 (n + m)`` tokens and one of the first
``n - ceil(3n/4) + 1`` tokens of each under any common order.

1. Equal sets form one class (by fingerprint), so copies cost one row.
2. Every class emits its first tokens.  The order puts tokens that many
   documents hold last (a fixed number of them is broadcast; each task counts
   those that several documents of one 512 KB piece hold), so groups of a very
   common passage do not form.  Rarer shared tokens can still form large groups.
3. In every token group each member is paired with the one before it and with
   the first; the pairs that link are components.  Groups of near copies are
   connected here with two pairs for each member, not with all pairs.
4. Groups that still hold several components go through a signature tree: its
   nodes hold OR-combined bitmaps, size ranges and the components below, and a
   dual traversal drops node pairs that are of one component or cannot reach
   the overlap asked for.  A group of more than BLOCK classes is cut into blocks
   by size class and component, and each block, and each pair of blocks whose
   sizes allow links, is a task's work of its own.
5. What is left is verified on the whole sets; components of the links that
   hold are the result.  No link is lost: steps 2 and 4 only drop pairs that
   cannot link or whose components are joined already.

Defined results: null or blank text has an empty set, links with nothing and
is its own component; one to four words are one shingle; repeated rows and
copies share a class; a row without an id gets the component of the rows with
its set, or null, and links nothing; rows of one id are taken to have one text;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (U64, broadcast, byte_chunks, components, discard, distinct_by_doc, i64, shingles_of, splitmix, stored, word_hashes,
                     words_of)

FREQUENT = 100_000  # broadcast bound: tokens moved to the end of the order
PER_TASK = 50_000  # of each task's most frequent tokens
SKETCH_BITS = 2048
LEAF = 16
BLOCK = 4096  # classes of a token group that are looked at as one; larger groups are cut
LEAST_TOKENS = 64  # of its groups' tokens, the smallest ones that a row carries
PAIRS_HELD = 200_000  # candidate pairs put out at a time
BROADCAST_IDS = 1_000_000  # ids (8 bytes each) that may be broadcast


def _sets(col):
    """Yield (first row, documents, set sizes, set starts, sorted tokens) by chunk."""
    for i, j, data, off in byte_chunks(col):
        low, s, e, doc = words_of(data, off)
        h, d = shingles_of(word_hashes(low, s, e), doc, j - i)
        h, d = distinct_by_doc(h, d)
        n = np.bincount(d, minlength=j - i)
        yield i, j - i, n, np.cumsum(n) - n, h


def _sum_by_doc(values: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), U64)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(values, start[some])
    return out


def _fingerprints(h, n, start):
    return (splitmix(_sum_by_doc(splitmix(h ^ U64(0x1234567)), n, start) + n.astype(U64)),
            splitmix(_sum_by_doc(splitmix(h + U64(0x7654321)), n, start)))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of size n of which a linked set shares at least one."""
    return n - (3 * n + 3) // 4 + 1


def _sketches(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Bitmap of each set."""
    bits = np.zeros((len(n), SKETCH_BITS), np.uint8)
    bits[np.repeat(np.arange(len(n)), n), (h & U64(SKETCH_BITS - 1)).astype(np.int64)] = 1
    return [r.tobytes() for r in np.packbits(bits, axis=1)]


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("t"))


def fingerprint_pass(src: DataFrame) -> DataFrame:
    """Rows of documents (kind 0: doc_id, n, fp1, fp2, bitmap) and of frequent tokens (kind 1: token, count)."""
    names = ["kind", "doc_id", "n", "fp1", "fp2", "sketch"]

    def run(batches):
        seen_t, seen_c, held = [], [], 0
        for batch in batches:
            for i, m, n, start, h in _sets(batch.column(1)):
                f1, f2 = _fingerprints(h, n, start)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), batch.column(0).slice(i, m), pa.array(n.astype(np.int64)),
                                                  pa.array(i64(f1)), pa.array(i64(f2)), pa.array(_sketches(h, n), pa.binary())], names=names)
                t, c = np.unique(h, return_counts=True)
                t, c = t[c > 1], c[c > 1]
                seen_t.append(t)
                seen_c.append(c)
                held += len(t)
                if held > 1_000_000:
                    t, c = _merge(seen_t, seen_c)
                    seen_t, seen_c, held = [t], [c], 0
        t, c = _merge(seen_t, seen_c)
        z = np.zeros(len(t), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), np.int8)), pa.array(i64(t)), pa.array(c.astype(np.int64)),
                                          pa.array(z), pa.array(z), pa.nulls(len(t), pa.binary())], names=names)

    def _merge(ts, cs):
        t = np.concatenate(ts) if ts else np.empty(0, U64)
        c = np.concatenate(cs) if cs else np.empty(0, np.int64)
        t, inv = np.unique(t, return_inverse=True)
        c = np.bincount(inv, weights=c, minlength=len(t)).astype(np.int64)
        if len(t) > PER_TASK:
            top = np.sort(np.argsort(-c, kind="stable")[:PER_TASK])
            t, c = t[top], c[top]
        return t, c

    return src.mapInArrow(run, "kind tinyint, doc_id bigint, n bigint, fp1 bigint, fp2 bigint, sketch binary")


def prefix_pass(src: DataFrame, frequent) -> DataFrame:
    """(token, cid, n) of the first tokens of each set; copies in one task only once."""

    def run(batches):
        freq = frequent()
        seen: set = set()
        for batch in batches:
            for _, m, n, start, h in _sets(batch.column(1)):
                f1, _ = _fingerprints(h, n, start)
                new = np.zeros(m, bool)
                for k, f in enumerate(f1.tolist()):
                    if n[k] and f not in seen:
                        seen.add(f)
                        new[k] = True
                if len(seen) > 500_000:
                    seen.clear()
                if not new.any():
                    continue
                doc = np.repeat(np.arange(m), n)
                take = new[doc]
                hh, dd = h[take], doc[take]
                if len(freq):
                    at = np.minimum(np.searchsorted(freq, hh), len(freq) - 1)
                    late = freq[at] == hh
                    order = np.argsort(dd * 2 + late, kind="stable")
                    hh, dd = hh[order], dd[order]
                cnt = np.where(new, n, 0)
                rank = np.arange(len(dd)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                keep = rank < prefix_length(n)[dd]
                dd = dd[keep]
                yield pa.RecordBatch.from_arrays([pa.array(i64(hh[keep])), pa.array(i64(f1)[dd]), pa.array(n[dd].astype(np.int64))],
                                                 names=["token", "cid", "n"])

    return src.mapInArrow(run, "token bigint, cid bigint, n bigint")


def chained(prefix: DataFrame) -> DataFrame:
    """Rows of token groups of two and more classes, each with the class before it and the group's first.

    Classes come in the order of their fingerprints, so the first one is the
    same in most groups of a cluster of near copies.
    """
    names = ["token", "cid", "n", "prev", "prev_n", "head", "head_n"]

    def out(*cols):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=names)

    def run(batches):
        last = None  # the row that waits for its successor: token, cid, n, prev, prev_n, head, head_n
        for batch in batches:
            if not batch.num_rows:
                continue
            token, cid, n = (batch.column(k).to_numpy() for k in range(3))
            if last is not None:
                token, cid, n = (np.concatenate([[v], x]) for v, x in zip(last, (token, cid, n), strict=False))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
            token, cid, n = token[new], cid[new], n[new]
            inside = token[1:] == token[:-1]
            prev, prev_n = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64)
            prev[1:][inside], prev_n[1:][inside] = cid[:-1][inside], n[:-1][inside]
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(token))))
            head, head_n = cid[first], n[first]
            if last is not None:
                prev[0], prev_n[0] = last[3], last[4]
                head[0], head_n[0] = last[5], last[6]
            emit = prev_n > 0
            emit[:-1] |= inside
            emit[-1] = False
            cols = (token, cid, n, prev, prev_n, head[group], head_n[group])
            last = [x[-1] for x in cols]
            yield out(*(x[emit] for x in cols))
        if last is not None and last[4] > 0:
            yield out(*(np.array([x], np.int64) for x in last))

    parts = prefix.repartition("token").sortWithinPartitions("token", "cid")
    return parts.mapInArrow(run, "token bigint, cid bigint, n bigint, prev bigint, prev_n bigint, head bigint, head_n bigint")


def _wide(tokens: np.ndarray) -> bytes:
    """Bitmap of four to eight bits a token; larger ones fold onto smaller ones."""
    size = 64 << max(0, (4 * len(tokens) - 1).bit_length() - 6)
    bits = np.zeros(size, np.uint8)
    bits[(tokens & U64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _most_common(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """Upper bound of the overlap of two sets of sizes n and m by their wide bitmaps."""
    if len(x) > len(y):
        x = np.bitwise_or.reduce(x.reshape(-1, len(y)), axis=0)
    elif len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def whole_sets(src: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, wide, tokens) of the documents in ``ids`` (doc_id); wide: a bitmap that grows with the set."""
    names = ["rep", "wide", "tokens"]

    def run(batches):
        for batch in batches:
            for i, m, n, start, h in _sets(batch.column(1)):
                parts = [h[s:s + k] for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, m), pa.array([_wide(p) for p in parts], pa.binary()),
                                                  pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    few = ids.count() <= BROADCAST_IDS  # else a sort-merge join
    return src.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(run, "rep bigint, wide binary, tokens binary")


def needed(n, m):
    """Least overlap at which sets of sizes n and m link."""
    return (3 * (n + m) + 6) // 7


def sketch_survivors(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow the overlap asked for."""
    left = sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches):
        for batch in batches:
            a, b, na, sa, nb, sb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "na", "sa", "nb", "sb"))
            if not len(a):
                continue
            x = np.frombuffer(b"".join(sa.to_pylist()), np.uint8).reshape(len(a), -1).view(U64)
            y = np.frombuffer(b"".join(sb.to_pylist()), np.uint8).reshape(len(a), -1).view(U64)
            na, nb = na.to_numpy(), nb.to_numpy()
            most = np.minimum(na - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            keep = most >= needed(na, nb)
            yield pa.RecordBatch.from_arrays([pa.array(a.to_numpy()[keep]), pa.array(b.to_numpy()[keep])], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, written once: by wide bitmaps first, then by the whole sets, so few sets are sent."""

    def joined(pairs, column):
        left = sets.select(F.col("rep").alias("a"), F.length("tokens").alias("na"), F.col(column).alias("xa"))
        right = sets.select(F.col("rep").alias("b"), F.length("tokens").alias("nb"), F.col(column).alias("xb"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb")

    def checked(test):
        def run(batches):
            for batch in batches:
                a, b, na, nb, xa, xb = batch.columns
                keep = [test(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), n // 8, m // 8)
                        for x, y, n, m in zip(xa, xb, na.to_pylist(), nb.to_pylist(), strict=True)]
                keep = np.array(keep, bool)
                yield pa.RecordBatch.from_arrays([pa.array(a.to_numpy()[keep]), pa.array(b.to_numpy()[keep])], names=["a", "b"])
        return run

    def may(x, y, n, m):
        return n > 0 and m > 0 and _most_common(x, y, n, m) >= needed(n, m)

    def does(x, y, n, m):
        if n > m:
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = int((y[at] == x).sum())
        return 100 * common >= 75 * (n + m - common)

    some = stored(joined(pairs, "wide").mapInArrow(checked(may), "a bigint, b bigint"))
    out = stored(joined(some, "tokens").mapInArrow(checked(does), "a bigint, b bigint"))
    discard(some)
    return out


class SignatureTree:
    """Nodes over members sorted by component and size: OR bitmap, size range, collision slack, components."""

    def __init__(self, n: np.ndarray, comp: np.ndarray, bits: np.ndarray):
        self.n, self.comp, self.bits = n, comp, bits
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.slack = n - ones
        # levels[0] are the leaves, each of LEAF members
        cuts = np.arange(0, len(n), LEAF)
        level = [np.bitwise_or.reduceat(bits, cuts, axis=0), np.minimum.reduceat(n, cuts), np.maximum.reduceat(n, cuts),
                 np.maximum.reduceat(self.slack, cuts), np.minimum.reduceat(comp, cuts), np.maximum.reduceat(comp, cuts)]
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), 4)
            level = [f.reduceat(x, cuts, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), level, strict=True)]
            self.levels.append(level)

    def level(self, depth: int):
        """The nodes at ``depth``; above the root is the root."""
        return self.levels[min(depth, len(self.levels) - 1)]

    def pairs(self, other: SignatureTree | None = None):
        """Member pairs (i, j) of different components that may link; dual traversal from the root.

        With ``other``, i is a member of this tree and j one of the other.
        """
        same, other = other is None, other or self
        top = max(len(self.levels), len(other.levels)) - 1
        p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for depth in range(top, -1, -1):
            x, y = self.level(depth), other.level(depth)
            if depth < top:  # children of the pairs that are left, in one tree each unordered pair once
                k = np.arange(4)
                cp = (4 * p[:, None] + k).repeat(4, axis=1).ravel()
                cq = np.tile(4 * q[:, None] + k, (1, 4)).ravel()
                ok = (cp < len(x[0])) & (cq < len(y[0]))
                if same:
                    ok &= cp <= cq
                p, q = cp[ok], cq[ok]
            if not len(p):
                return
            step = 1 << 14
            kept = []
            for s in range(0, len(p), step):
                bits_a, lo_a, hi_a, slack_a, c0_a, c1_a = (v[p[s:s + step]] for v in x)
                bits_b, lo_b, hi_b, slack_b, c0_b, c1_b = (v[q[s:s + step]] for v in y)
                both = np.bitwise_count(bits_a & bits_b).sum(axis=1, dtype=np.int64)
                most = np.minimum(np.minimum(both + slack_a, both + slack_b), np.minimum(hi_a, hi_b))
                one = (c0_a == c1_a) & (c0_b == c1_b) & (c0_a == c0_b)
                apart = (4 * hi_a < 3 * lo_b) | (4 * hi_b < 3 * lo_a)
                kept.append(~one & ~apart & (most >= needed(lo_a, lo_b)))
            keep = np.concatenate(kept)
            p, q = p[keep], q[keep]
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            i, j = np.meshgrid(np.arange(a * LEAF, min((a + 1) * LEAF, len(self.n))), np.arange(b * LEAF, min((b + 1) * LEAF, len(other.n))), indexing="ij")
            i, j = i.ravel(), j.ravel()
            ok = (self.comp[i] != other.comp[j]) & (4 * self.n[i] >= 3 * other.n[j]) & (4 * other.n[j] >= 3 * self.n[i])
            if same:
                ok &= i < j
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            most = np.minimum(self.n[i] - np.bitwise_count(self.bits[i] & ~other.bits[j]).sum(axis=1, dtype=np.int64),
                              other.n[j] - np.bitwise_count(other.bits[j] & ~self.bits[i]).sum(axis=1, dtype=np.int64))
            ok = most >= needed(self.n[i], other.n[j])
            yield i[ok], j[ok]


def _leaf_pairs(size, comp, n, bits):
    """Member pairs of many groups of at most one leaf each, as SignatureTree.pairs gives them."""
    first = np.cumsum(size) - size
    for m in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(m, 1)
        base = first[size == m][:, None]
        i, j = (base + i).ravel(), (base + j).ravel()
        for s in range(0, len(i), 1 << 15):
            x, y = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
            ok = (comp[x] != comp[y]) & (4 * n[x] >= 3 * n[y]) & (4 * n[y] >= 3 * n[x])
            x, y = x[ok], y[ok]
            most = np.minimum(n[x] - np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype=np.int64),
                              n[y] - np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1, dtype=np.int64))
            ok = most >= needed(n[x], n[y])
            yield x[ok], y[ok]


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (token, comp, rep, n) with ``size``, their size class, and ``block``, of at most BLOCK rows of one token and size class.

    Sets link only if their size classes are the same or neighbours.  Rows are
    dealt by ranges of all columns, so a group of any size is spread over tasks.
    """
    names = ["block", "token", "size", "comp", "rep", "n"]

    def run(batches):
        block, seen, last = (TaskContext.get().partitionId() << 40) - 1, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (size[1:] != size[:-1])
            new[0] = last != (token[0], size[0])
            k = np.arange(len(token))
            at = k - np.maximum.accumulate(np.where(new, k, -seen))
            of = block + np.cumsum(at % BLOCK == 0)
            block, seen, last = int(of[-1]), int(at[-1]) + 1, (token[-1], size[-1])
            yield pa.RecordBatch.from_arrays([pa.array(of), *batch.columns], names=names)

    size = F.floor(F.log("n") / F.lit(math.log(1.34))).cast("bigint")  # 1.34 > 4 / 3
    parts = rows.select("token", size.alias("size"), "comp", "rep", "n").repartitionByRange("token", "size", "comp", "n", "rep")
    parts = parts.sortWithinPartitions("token", "size", "comp", "n", "rep")
    return parts.mapInArrow(run, "block bigint, token bigint, size bigint, comp bigint, rep bigint, n bigint")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs (x, y) of blocks of one token, also of a block with itself, whose sizes and components allow links."""
    of = blocks.groupBy("block", "token", "size").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    of = stored(of)
    left = of.select("token", "size", *[F.col(c).alias(f"{c}_x") for c in ("block", "lo", "hi", "c0", "c1")])
    right = of.select("token", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("size"), F.col("size").alias("size_y"),
                      *[F.col(c).alias(f"{c}_y") for c in ("block", "lo", "hi", "c0", "c1")])
    both = left.join(right, ["token", "size"]).where("size_y <> size or block_x <= block_y")
    both = both.where("4 * hi_x >= 3 * lo_y and 4 * hi_y >= 3 * lo_x and not (c0_x = c1_x and c0_y = c1_y and c0_x = c0_y)")
    return both.select(F.col("block_x").alias("x"), F.col("block_y").alias("y"))


def units_of_groups(small: DataFrame, large: DataFrame | None, about: DataFrame) -> DataFrame:
    """Rows (x, y, side, token, comp, rep, n, sketch, tokens) of the units (kind, x, y) that trees are built of.

    A unit is a token group of ``small`` (kind 0), or one or two blocks of a group of ``large`` (kind 1).
    """
    unit = ["kind", "x", "y", "side", "token", "comp", "rep", "n", "sketch", "tokens"]
    out = small.join(about, "rep").select(F.lit(0).alias("kind"), F.col("token").alias("x"), F.col("token").alias("y"), F.lit(0).alias("side"), *unit[4:])
    if large is None:
        return out
    blocks = stored(in_blocks(large))
    pairs = stored(block_pairs(blocks))
    sides = pairs.select("x", "y", F.lit(0).alias("side"), F.col("x").alias("block")).union(pairs.where("x <> y").select("x", "y", F.lit(1), "y"))
    return out.union(blocks.join(about, "rep").join(sides, "block").withColumn("kind", F.lit(1)).select(*unit))


def tree_candidates(rows: DataFrame) -> DataFrame:
    """Candidate pairs of the units in ``rows`` (see units_of_groups), each of at most 2 * BLOCK rows.

    ``tokens`` are the smallest groups of the row's class.  A pair that meets in
    several groups is left out where both rows name a smaller common one; the
    pair's smallest group always puts it out.
    """

    def out(rep, token, tokens, found):
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        sets: dict = {}

        def groups(k):
            if k not in sets:
                sets[k] = frozenset(tokens[k].as_py())
            return sets[k]

        first = np.array([min(groups(x) & groups(y), default=token[x]) >= token[x] for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
        i, j = i[first], j[first]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], names=["a", "b"])

    def pairs_of(new, side, comp, n, bits):
        cuts = np.flatnonzero(new)
        size = np.diff(np.append(cuts, len(n)))
        two = np.add.reduceat(side, cuts) > 0
        small = (size <= LEAF) & ~two
        at = np.flatnonzero(np.repeat(small, size))
        for i, j in _leaf_pairs(size[small], comp[at], n[at], bits[at]):
            yield at[i], at[j]
        for s, m, both in zip(cuts[~small].tolist(), size[~small].tolist(), two[~small].tolist(), strict=True):
            k = s + int((side[s:s + m] == 0).sum())
            tree = SignatureTree(n[s:k], comp[s:k], bits[s:k])
            for i, j in tree.pairs(SignatureTree(n[k:s + m], comp[k:s + m], bits[k:s + m]) if both else None):
                yield s + i, (k if both else s) + j

    def solve(new, side, token, comp, rep, n, sketch, tokens):
        bits = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(n), -1).view(U64)
        found, held = [], 0
        for i, j in pairs_of(new, side, comp, n, bits):
            found.append((i, j))
            held += len(i)
            if held > PAIRS_HELD:
                yield out(rep, token, tokens, found)
                found, held = [], 0
        if found:
            yield out(rep, token, tokens, found)

    def starts(batch):
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in (batch.column(c).to_numpy() for c in range(3))], axis=0)
        return new

    def run(batches):
        held, last = [], None  # batches of an open unit, its key
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = int(np.flatnonzero(starts(batch))[-1])
            if held and (cut or last != key(batch, 0)):
                yield from _all([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield from _all([batch.slice(0, cut)])
            held.append(batch.slice(cut))
            last = key(batch, -1)
        if held:
            yield from _all(held)

    def key(batch, k):
        return tuple(batch.column(c).to_numpy()[k] for c in range(3))

    def _all(held):
        t = pa.Table.from_batches(held).combine_chunks()
        yield from solve(starts(t), *(t.column(k).to_numpy() for k in range(3, 8)), t.column(8).to_pylist(), t.column(9).combine_chunks())

    parts = rows.repartition("kind", "x", "y").sortWithinPartitions("kind", "x", "y", "side", "comp", "n", "rep")
    return parts.mapInArrow(run, "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    src = _texts(docs, doc_id, text)
    first = stored(fingerprint_pass(src))
    members = first.where("kind = 0").select("doc_id", "n", "fp1", "fp2")
    frequent = first.where("kind = 1").groupBy(F.col("doc_id").alias("token")).agg(F.sum("n").alias("c"))
    top = frequent.orderBy(F.desc("c"), "token").limit(FREQUENT).toPandas()["token"].to_numpy(np.int64)
    shared = broadcast(spark, np.sort(top.view(U64)))

    classes = stored(members.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    ids = classes.select(F.col("fp1").alias("cid"), "rep", "n")
    rows = stored(chained(prefix_pass(src, shared)))

    # every class that shares a first token with another one
    shares = stored(rows.select("cid").distinct().join(ids, "cid"))
    sketches = shares.select("rep", "n").join(first.where("kind = 0").select(F.col("doc_id").alias("rep"), "sketch"), "rep").dropDuplicates(["rep"])
    sketches = stored(sketches)

    prev = shares.select(F.col("cid").alias("prev"), F.col("rep").alias("ra"))
    cur = shares.select("cid", F.col("rep").alias("rb"))
    near = lambda c: f"{c}_n > 0 and {c} <> cid and 4 * {c}_n >= 3 * n and 4 * n >= 3 * {c}_n"
    chain = rows.where(near("prev")).select("prev", "cid").union(rows.where(near("head")).select("head", "cid")).distinct()
    chain = chain.join(prev, "prev").join(cur, "cid").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    links = linked(src, sketch_survivors(chain, sketches))
    comp = components(links)

    known = shares.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = stored(known.select("cid", "rep", "n", F.coalesce("component", "rep").alias("comp")))
    tagged = rows.select("token", "cid").join(known.select("cid", "comp", "rep"), "cid")
    # tokens whose groups hold several components; of equal groups one is enough
    groups = tagged.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"),
                                         F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(1), "rep").cast("decimal(20,0)")).alias("h2"))
    several = groups.where("lo <> hi").groupBy("m", "h1", "h2").agg(F.min("token").alias("token")).select("token", "m")
    open_rows = opened = stored(rows.select("token", "cid").join(several, "token"))
    groups_of = open_rows.groupBy("cid").agg(F.slice(F.array_sort(F.collect_set("token")), 1, LEAST_TOKENS).alias("tokens"))
    about = known.select("cid", "rep").join(groups_of, "cid").select("rep", "tokens").join(sketches.select("rep", "sketch"), "rep")
    open_rows = open_rows.join(known, "cid").select("token", "m", "comp", "rep", "n")
    large = None if open_rows.where(F.col("m") > BLOCK).isEmpty() else stored(open_rows.where(F.col("m") > BLOCK).drop("m"))
    more = linked(src, tree_candidates(units_of_groups(open_rows.where(F.col("m") <= BLOCK).drop("m"), large, about)))
    comp = components(links.unionByName(more))
    discard(rows, shares, sketches, known, opened, *([large] if large is not None else []))

    of_class = classes.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = of_class.select("fp1", "fp2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = members.join(of_class, ["fp1", "fp2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def linked(src: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidate pairs that link, written once; what was written for it goes."""
    pairs = stored(pairs)
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = stored(whole_sets(src, ids))
    out = verified(pairs, sets)
    discard(sets, ids, pairs)
    return out
