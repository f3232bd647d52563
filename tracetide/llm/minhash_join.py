"""MinHash near-dedup: multi-index Hamming join of b-bit signatures, links confirmed on full sets.

A document's set holds its distinct 2-word shingles (64-bit hashes); two documents
link when ``100 * |x & y| >= 80 * |x | y|``.  The signature is ``SYMBOLS``
minima of the set under different hashes, ``BITS`` bits of each.  At a similarity
of 0.8 a symbol differs with probability 0.2, so the distance of two signatures
(symbols that differ) is 12.8 of 64 in the mean and over ``MAX_DISTANCE`` = 31 with
a probability of about 2e-8.

1. Equal sets are one class (128-bit fingerprint), so copies cost one row.
2. The signature is split into ``CHUNKS`` chunks.  Of two signatures at most
   MAX_DISTANCE apart, one chunk has at most ``ERRORS`` differing symbols
   (pigeonhole: CHUNKS * (ERRORS + 1) > MAX_DISTANCE).  Each chunk gives a key for every
   choice of ERRORS symbols that are left out, so the join on keys finds
   every pair within the distance.
3. Buckets of a key are dealt by ranges of (key, class), so a large bucket spreads
   over tasks.  Each class is paired with the one before it and with the
   bucket's first one in the task; the pairs that link make components.  Groups of near
   copies are connected here with two pairs for each member.
4. Buckets that still hold several components are joined exactly: pairs of different
   components whose sizes, signatures and bitmaps allow a link, put out once, in the
   smallest common bucket.  A bucket of more than ``BLOCK`` classes is cut into blocks by size,
   and each block and pair of blocks is a unit of its own.
5. Whole sets confirm the pairs; components of all links are the result.

Steps 3 to 5 lose no link: sizes and bitmaps are exact bounds, and a pair within one component
adds nothing.  Step 2 loses a link with the probability above.

Defined results: null or blank text has an empty set, links with nothing and is its
own component; one word is one shingle; repeated rows are copies.  A component is named
by its smallest doc_id; rows without a doc_id link like others and take over that name,
or null if the component has none, and are kept only then.  Very long
texts are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (U64, byte_chunks, components, distinct_by_doc, i64, random_u64, shingles_of, splitmix, stored, word_hashes, words_of)
from .jaccard_join import BLOCK, _fingerprints, _sketches, block_pairs, in_blocks

SHINGLE_WORDS = 2
SYMBOLS, BITS = 64, 16
CHUNKS, ERRORS = 16, 1
CHUNK = SYMBOLS // CHUNKS
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
BROADCAST_IDS = 1_000_000  # ids (8 bytes each) that may be broadcast
PAIRS_AT_ONCE = 1 << 15
_XOR, _MUL = random_u64(SYMBOLS, 0x51), random_u64(SYMBOLS, 0xB17) | U64(1)
_LEFT = [c * CHUNK + np.array(kept) for c in range(CHUNKS) for kept in itertools.combinations(range(CHUNK), CHUNK - ERRORS)]  # symbols of each key
_SALT = random_u64(len(_LEFT), 0xC4)


def _sets(col):
    """Yield (first row, documents, set sizes, set starts, sorted tokens) by chunk."""
    for i, j, data, off in byte_chunks(col):
        low, s, e, doc = words_of(data, off)
        h, d = distinct_by_doc(*shingles_of(word_hashes(low, s, e), doc, j - i, SHINGLE_WORDS))
        n = np.bincount(d, minlength=j - i)
        yield i, j - i, n, np.cumsum(n) - n, h


def signatures(h: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(sets x SYMBOLS) uint16: equal symbols of two sets are as likely as their Jaccard similarity."""
    out = np.zeros((len(n), SYMBOLS), np.uint16)
    some = n > 0
    if some.any():
        cuts = start[some]
        for k in range(SYMBOLS):
            out[some, k] = splitmix(np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], cuts)) >> U64(64 - BITS)
    return out


def keys_of(sig: np.ndarray) -> np.ndarray:
    """(sets x keys) uint64: one key for each chunk and choice of symbols left out."""
    out = np.empty((len(sig), len(_LEFT)), U64)
    for k, symbols in enumerate(_LEFT):
        value = np.full(len(sig), _SALT[k])
        for s in symbols:
            value = splitmix((value ^ sig[:, s]) * U64(0x9E3779B97F4A7C15))
        out[:, k] = value
    return out


def _matrix(col, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1)


def signature_pass(src: DataFrame) -> DataFrame:
    """(doc_id, n, fp1, fp2, sig, sketch) of every document."""
    names = ["doc_id", "n", "fp1", "fp2", "sig", "sketch"]

    def run(batches):
        for batch in batches:
            for i, m, n, start, h in _sets(batch.column(1)):
                f1, f2 = _fingerprints(h, n, start)
                sig = signatures(h, n, start)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, m), pa.array(n.astype(np.int64)), pa.array(i64(f1)), pa.array(i64(f2)),
                                                  pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(_sketches(h, n), pa.binary())], names=names)

    return src.mapInArrow(run, "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, sig binary, sketch binary")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, cid, prev, head) of the buckets with two and more classes; prev, head: itself where there is none.

    A bucket that reaches the border of a task's range is put out whatever its
    size there; its other rows are with a neighbour.
    """

    def keyed(batches):
        for batch in batches:
            keys = keys_of(_matrix(batch.column(1), np.uint16)) if batch.num_rows else np.empty((0, len(_LEFT)), U64)
            yield pa.RecordBatch.from_arrays([pa.array(i64(keys.ravel())), pa.array(np.repeat(batch.column(0).to_numpy(), len(_LEFT)))], names=["key", "cid"])

    def paired(batches):
        wait, border = None, None  # the last row (key, cid, prev, head, in a bucket of several); the first key
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            border = int(key[0]) if border is None else border
            if wait:
                key, cid = np.concatenate([[wait[0]], key]), np.concatenate([[wait[1]], cid])
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(key)))
            prev = np.where(new, cid, np.concatenate([cid[:1], cid[:-1]]))
            head, several = np.repeat(cid[first], size), np.repeat(size > 1, size)
            if wait:
                prev[0], head[:size[0]] = wait[2], wait[3]
                several[:size[0]] |= wait[4]
            cols = key, cid, prev, head, several
            wait = tuple(c[-1] for c in cols)
            put = several | (key == border)
            put[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(c[put]) for c in cols[:4]], names=["key", "cid", "prev", "head"])
        if wait:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in wait[:4]], names=["key", "cid", "prev", "head"])

    rows = classes.select("cid", "sig").mapInArrow(keyed, "key bigint, cid bigint")
    rows = rows.repartitionByRange("key", "cid").sortWithinPartitions("key", "cid")
    return rows.mapInArrow(paired, "key bigint, cid bigint, prev bigint, head bigint")


def may_link(n, m, sig_x, sig_y, bits_x, bits_y) -> np.ndarray:
    """Whether sizes, signatures and bitmaps of pairs allow a link; bitmaps bound the overlap from above."""
    ok = (5 * n >= 4 * m) & (5 * m >= 4 * n)
    at = np.flatnonzero(ok)
    at = at[(sig_x[at] != sig_y[at]).sum(axis=1) <= MAX_DISTANCE]
    x, y = bits_x[at], bits_y[at]
    most = np.minimum(n[at] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m[at] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    at = at[9 * most >= 4 * (n[at] + m[at])]
    out = np.zeros(len(n), bool)
    out[at] = True
    return out


def near_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that may link."""
    for side, c in (("a", "x"), ("b", "y")):
        pairs = pairs.join(classes.select(F.col("cid").alias(side), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "sig", "sketch")]), side)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            keep = may_link(col["n_x"].to_numpy(), col["n_y"].to_numpy(), *(_matrix(col[c], np.uint16) for c in ("sig_x", "sig_y")),
                            *(_matrix(col[c], U64) for c in ("sketch_x", "sketch_y")))
            yield pa.RecordBatch.from_arrays([pa.array(col[c].to_numpy()[keep]) for c in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def whole_units(batches, keys: int):
    """Tables of whole units (rows that agree in the first ``keys`` columns) from sorted batches."""
    held = []

    def starts(batch):
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in (batch.column(k).to_numpy() for k in range(keys))], axis=0)
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(starts(batch)[-1])
        same = held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in range(keys))
        if held and (cut or not same):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if same else held)
            held = []
            if not same and cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def pairs_within(unit: np.ndarray, side: np.ndarray, comp: np.ndarray, n: np.ndarray):
    """Yield index pairs (i, j) of one unit, of different components and of sizes that allow a link.

    Rows come by unit and size.  A unit with both sides pairs rows of different sides only.
    """
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    size = np.diff(np.append(first, len(unit)))
    end = np.repeat(first + size, size)
    two = np.repeat(np.maximum.reduceat(side, first) > 0, size)
    i, lag = np.arange(len(unit)), 0
    while len(i):
        lag += 1
        i = i[i + lag < end[i]]
        i = i[5 * n[i] >= 4 * n[i + lag]]  # sizes rise, so a row that is too small now stays so
        ok = (comp[i] != comp[i + lag]) & ~(two[i] & (side[i] == side[i + lag]))
        if ok.any():
            yield i[ok], i[ok] + lag


def bucket_pairs(units: DataFrame) -> DataFrame:
    """Pairs (a, b) of the units (kind, x, y, side, key, comp, cid, n, sig, sketch) that may link, each pair once."""
    schema = "a bigint, b bigint"

    def run(batches):
        for table in whole_units(batches, 3):
            table = table.combine_chunks()
            kind, x, y, side, key, comp, cid, n = (table.column(k).to_numpy() for k in range(8))
            new = np.ones(len(n), np.int64)
            new[1:] = (kind[1:] != kind[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            sig, bits = (_matrix(table.column(k), t) for k, t in ((8, np.uint16), (9, U64)))
            keys, key = keys_of(sig), key.view(U64)
            for i, j in pairs_within(np.cumsum(new), side, comp, n):
                for s in range(0, len(i), PAIRS_AT_ONCE):
                    p, q = i[s:s + PAIRS_AT_ONCE], j[s:s + PAIRS_AT_ONCE]
                    ok = may_link(n[p], n[q], sig[p], sig[q], bits[p], bits[q])
                    p, q = p[ok], q[ok]
                    least = np.where(keys[p] == keys[q], keys[p], U64(0xFFFFFFFFFFFFFFFF)).min(axis=1)
                    p, q = p[least == key[p]], q[least == key[p]]
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[p], cid[q])), pa.array(np.maximum(cid[p], cid[q]))], names=["a", "b"])

    rows = units.repartition("kind", "x", "y").sortWithinPartitions("kind", "x", "y", "n", "cid")
    return rows.mapInArrow(run, schema)


def confirmed(src: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, checked on the whole sets."""
    pairs = stored(pairs)
    used = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    ids = stored(used.join(classes.select("cid", "rep"), "cid").select(F.col("rep").alias("doc_id"), "cid"))
    some = ids.where("doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    few = some.count() <= BROADCAST_IDS  # else a sort-merge join
    texts = src.join(F.broadcast(some) if few else some, F.col("doc_id") == F.col("__id"), "left_semi")
    if not ids.where("doc_id is null").isEmpty():
        texts = texts.unionByName(src.where("doc_id is null"))

    def run(batches):
        for batch in batches:
            for _, _, n, start, h in _sets(batch.column(1)):
                f1, _ = _fingerprints(h, n, start)
                yield pa.RecordBatch.from_arrays([pa.array(i64(f1)), pa.array([h[s:s + k].tobytes() for s, k in zip(start.tolist(), n.tolist(), strict=True)], pa.binary())],
                                                 names=["cid", "tokens"])

    sets = texts.mapInArrow(run, "cid bigint, tokens binary").join(ids.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])
    sets = stored(sets)

    def check(batches):
        for batch in batches:
            a, b, ta, tb = batch.columns
            keep = [_linked(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in zip(ta, tb, strict=True)]
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a.to_numpy()[keep]), pa.array(b.to_numpy()[keep])], names=["a", "b"])

    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), "b")
    return stored(both.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint"))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if not (len(x) and len(y)):
        return False
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= 80 * (len(x) + len(y) - common)


def open_units(buckets: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold several components (see bucket_pairs); of equal buckets the smallest key."""
    comp = components(links)
    known = buckets.select("key", "cid").join(comp.select(F.col("node").alias("cid"), "component"), "cid", "left")
    known = known.select("key", "cid", F.coalesce("component", "cid").alias("comp"))
    members = [F.sum(F.xxhash64(F.lit(k), "cid").cast("decimal(20,0)")).alias(f"h{k}") for k in (0, 1)]
    groups = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), *members)
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # bucket_pairs compares keys as unsigned numbers
    groups = groups.where("lo <> hi").groupBy("m", "h0", "h1").agg(F.min(F.struct(unsigned.alias("u"), "key"))["key"].alias("key")).select("key", "m")
    rows = stored(known.join(groups, "key"))
    about = classes.select("cid", "n", "sig", "sketch")
    cols = ["kind", "x", "y", "side", "key", "comp", "cid", "n", "sig", "sketch"]
    out = rows.where(F.col("m") <= BLOCK).join(about, "cid").select(F.lit(0).alias("kind"), F.col("key").alias("x"), F.col("key").alias("y"), F.lit(0).alias("side"), *cols[4:])
    large = rows.where(F.col("m") > BLOCK)
    if large.isEmpty():
        return out
    blocks = stored(in_blocks(large.join(classes.select("cid", "n"), "cid").select(F.col("key").alias("token"), "comp", F.col("cid").alias("rep"), "n")))
    pairs = stored(block_pairs(blocks))
    sides = pairs.select("x", "y", F.lit(0).alias("side"), F.col("x").alias("block")).union(pairs.where("x <> y").select("x", "y", F.lit(1), "y"))
    named = blocks.select("block", F.col("token").alias("key"), "comp", F.col("rep").alias("cid"))
    return out.union(named.join(about, "cid").join(sides, "block").withColumn("kind", F.lit(1)).select(*cols))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("t"))
    members = stored(signature_pass(src))
    classes = members.where("n > 0").groupBy(F.col("fp1").alias("cid"), "fp2", "n")
    classes = stored(classes.agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")))
    buckets = stored(bucket_rows(classes))

    chain = buckets.where("prev <> cid").select(F.least("prev", "cid").alias("a"), F.greatest("prev", "cid").alias("b"))
    chain = chain.union(buckets.where("head <> cid").select(F.least("head", "cid"), F.greatest("head", "cid"))).distinct()
    links = confirmed(src, near_pairs(chain, classes), classes)
    more = confirmed(src, bucket_pairs(open_units(buckets, classes, links)), classes)

    comp = components(links.unionByName(more))
    of_class = classes.select("cid", "fp2", "n", "rep").join(comp.select(F.col("node").alias("cid"), "component"), "cid", "left")
    of_class = stored(of_class.select("cid", "fp2", "n", "rep", F.coalesce("component", "cid").alias("component")))
    name = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(name, "component").select(F.col("cid").alias("fp1"), "fp2", "n", "component_id")
    out = members.select("doc_id", "n", "fp1", "fp2").join(of_class, ["fp1", "fp2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
