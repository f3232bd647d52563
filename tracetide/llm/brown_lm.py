"""Language-model scoring with Brown classes.

A word model on classes: P(w | previous) = P(class | previous class) * P(w | class).

* Word counts cover every training document; they are summed by Spark and stay
  distributed.  The ``KNOWN_WORDS`` most frequent ones are broadcast (a fixed
  bound); all others are looked up by a join.
* Every word of at least ``OWN_COUNT`` occurrences is an item of its own (of the
  broadcast ones, that is); rarer words share ``BUCKETS`` items by their last
  bytes, so every word has a class.  The end of a text is an item with a class of
  its own.
* Classes are found by the exchange algorithm in two steps.  First the items of
  the ``HEAD_WORDS`` most frequent words and of the buckets move, one at a time, to
  the class that raises the likelihood of the class bigrams most, until none
  moves; their bigrams are a matrix of fixed size.  Then all items move, in at most
  ``ALL_ROUNDS`` rounds: Spark counts the classes before and after every item over
  all training documents, and each item goes to the class under which its
  neighbours are likeliest, the class bigrams of the round being fixed.  Only the
  items' classes come to the driver.  The rounds end when the likelihood no longer rises.
* Counts are discounted by an absolute amount.  What that frees goes to the buckets
  and there is the probability of a new word.  Class transitions are smoothed
  towards the class frequencies.

A text is its words, A-Z lowered, ``[^\\x20\\x09-\\x0D]+``, and one end.
Defined results: null and blank texts are an end alone; a null id is kept;
repeated rows are scored (and learned from) each time; equal counts are ordered
by the word's hash; with no training document, every word is new and all
probabilities are uniform guesses; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, broadcast, byte_chunks, discard, i64, splitmix, stored, word_hashes, words_of

KNOWN_WORDS = 250_000
OWN_COUNT = 4
HEAD_WORDS = 383
BUCKETS = 128
CLASSES = 48
ALL_ROUNDS = 3
BLOCK_ITEMS = 512  # items whose neighbour counts go together
BLOCK_CELLS = BLOCK_ITEMS * 2 * CLASSES
END_HASH = np.int64(0x454E44)  # stands for the end of a text
ROUNDS = 12
_FLUSH = 2_000_000


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes (int64) of the broadcast words, the end among them
    counts: np.ndarray
    own: np.ndarray  # sorted hashes of the words that are items; then come the buckets, then the end
    klass: np.ndarray  # class of each item
    trans: np.ndarray  # (class, class): log10 P(class | class before)
    emit: np.ndarray  # log10 P(item | its class)
    bucket_total: np.ndarray  # mass of each bucket: tokens of its rare words, and what its own words were discounted by
    bucket_words: np.ndarray  # distinct words of each bucket
    discount: float
    total: int  # N
    distinct: int  # V


def _bucket_of(low, starts, ends):
    """Bucket of each word by its last three bytes."""
    last = low[ends - 1].astype(U64)
    second = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(U64)
    third = np.where(ends - starts > 2, low[np.maximum(ends - 3, 0)], 0).astype(U64)
    return (splitmix(last + (second << U64(8)) + (third << U64(16)) + U64(1)) % U64(BUCKETS)).astype(np.int64)


def _merged(parts):
    h = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts])
    b = np.concatenate([p[2] for p in parts])
    h, first, inv = np.unique(h, return_index=True, return_inverse=True)
    return h, np.bincount(inv, weights=c, minlength=len(h)).astype(np.int64), b[first]


def word_counts(src: DataFrame) -> DataFrame:
    """(word, bucket, n) over ``src`` (t); the end has bucket -1."""
    names = ["word", "bucket", "n"]

    def run(batches):
        parts, held, docs = [], 0, 0
        for batch in batches:
            docs += batch.num_rows
            for _, _, data, off in byte_chunks(batch.column(0)):
                low, s, e, _ = words_of(data, off)
                if not len(s):
                    continue
                h, first, c = np.unique(i64(word_hashes(low, s, e)), return_index=True, return_counts=True)
                parts.append((h, c, _bucket_of(low, s[first], e[first])))
                held += len(h)
                if held > _FLUSH:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > _FLUSH // 2:
                        yield _batch(*parts[0])
                        parts, held = [], 0
        if parts:
            yield _batch(*_merged(parts))
        if docs:
            yield _batch(np.array([END_HASH]), np.array([docs]), np.array([-1]))

    def _batch(h, c, b):
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(b.astype(np.int32)), pa.array(c.astype(np.int64))], names=names)

    return src.mapInArrow(run, "word bigint, bucket int, n bigint").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))


def _items(h: np.ndarray, bucket: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The place in ``own`` (sorted hashes), or beyond it the bucket."""
    out = len(own) + bucket
    if len(own):
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        hit = own[at] == h
        out[hit] = at[hit]
    return out


def _sequence(data, off, docs):
    """Words and ends in text order: (hash, bucket, is end, document)."""
    low, s, e, doc = words_of(data, off)
    n = np.bincount(doc, minlength=docs)
    size = n + 1
    end_at = np.cumsum(size) - 1
    is_end = np.zeros(int(size.sum()), bool)
    is_end[end_at] = True
    h = np.full(len(is_end), END_HASH)
    bucket = np.full(len(is_end), BUCKETS)  # after the buckets: the item of the end
    if len(s):
        h[~is_end] = i64(word_hashes(low, s, e))
        bucket[~is_end] = _bucket_of(low, s, e)
    return h, bucket, is_end, np.repeat(np.arange(docs), size), size


def _previous(x: np.ndarray, start):
    """The value before each position; a text starts after an end."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[0] = start
    return out


def bigram_counts(src: DataFrame, head: np.ndarray) -> np.ndarray:
    """Item bigrams over ``src`` (t), of the words ``head`` (sorted), the buckets of all others and the end."""
    names, items = ["cell", "n"], len(head) + BUCKETS + 1

    def run(batches):
        cells = np.zeros(items * items, np.int64)
        for batch in batches:
            for i, j, data, off in byte_chunks(batch.column(0)):
                h, bucket, _, _, _ = _sequence(data, off, j - i)
                item = _items(h, bucket, head)
                cells += np.bincount(_previous(item, items - 1) * items + item, minlength=items * items)
        hit = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(cells[hit])], names=names)

    got = src.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(items * items)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy()
    return out.reshape(items, items)


def item_sequences(src: DataFrame, own: np.ndarray) -> DataFrame:
    """(items): the items of some texts of ``src`` (t) in a row, as int32 bytes; each text closes with the end's."""
    shared = broadcast(src.sparkSession, own)

    def run(batches):
        own = shared()
        for batch in batches:
            for i, j, data, off in byte_chunks(batch.column(0)):
                h, bucket, _, _, _ = _sequence(data, off, j - i)
                yield pa.RecordBatch.from_arrays([pa.array([_items(h, bucket, own).astype(np.int32).tobytes()], pa.binary())], names=["items"])

    return src.mapInArrow(run, "items binary")


def block_counts(sequences: DataFrame, shared) -> DataFrame:
    """(block, at, n): classes before (side 0) and after (1) each item, by blocks of ``BLOCK_ITEMS`` items: the cells
    ((item in the block, side, class) as one number, uint16) with their counts (int64).  Block -1: class bigrams."""
    names, schema = ["block", "at", "n"], "block int, at binary, n binary"

    def run(batches):
        klass = shared()
        cells = np.zeros(-(-len(klass) // BLOCK_ITEMS) * BLOCK_CELLS, np.int32)  # bounded: the items are
        pairs, held = np.zeros(CLASSES * CLASSES, np.int64), 0
        for batch in batches:
            for raw in batch.column(0):
                item = np.frombuffer(raw.as_buffer(), np.int32).astype(np.int64)
                here = klass[item]
                before = _previous(here, klass[-1])
                after = np.append(here[1:], 0)
                pairs += np.bincount(before * CLASSES + here, minlength=len(pairs))
                inner = item < len(klass) - 1
                if held + len(item) > 1 << 30:
                    yield from put(cells)
                    cells[:], held = 0, 0
                held += len(item)
                np.add.at(cells, item[inner] * 2 * CLASSES + before[inner], np.int32(1))
                np.add.at(cells, (item[inner] * 2 + 1) * CLASSES + after[inner], np.int32(1))
        yield from put(cells)
        yield row(-1, pairs)

    def put(cells):
        for block, own in enumerate(cells.reshape(-1, BLOCK_CELLS)):
            if own.any():
                yield row(block, own)

    def row(block, own):
        at = np.flatnonzero(own)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                                           pa.array([own[at].astype(np.int64).tobytes()], pa.binary())], names=names)

    def merge(batches):  # a task's blocks; all there are is a fixed number
        sums: dict = {}
        for batch in batches:
            for block, at, n in zip(batch.column("block").to_pylist(), batch.column("at"), batch.column("n"), strict=True):
                own = sums.setdefault(block, np.zeros(BLOCK_CELLS, np.int64))
                own[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.int64)
        for block, own in sums.items():
            yield row(block, own)

    return sequences.mapInArrow(run, schema).repartition("block").mapInArrow(merge, schema)


def neighbour_counts(sequences: DataFrame, shared) -> DataFrame:
    """(item, side, class, n) of :func:`block_counts`; item -1: class bigrams (side: the first)."""
    names = ["item", "side", "class", "n"]

    def run(batches):
        for batch in batches:
            for block, at, n in zip(batch.column("block").to_pylist(), batch.column("at"), batch.column("n"), strict=True):
                at, n = np.frombuffer(at.as_buffer(), np.uint16).astype(np.int32), np.frombuffer(n.as_buffer(), np.int64)
                first, klass = at // CLASSES, at % CLASSES
                item, side = (np.full(len(at), -1, np.int32), first) if block < 0 else (block * BLOCK_ITEMS + first // 2, first % 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((item, side, klass, n), (pa.int32(),) * 3 + (pa.int64(),), strict=True)], names=names)

    return block_counts(sequences, shared).mapInArrow(run, "item int, side int, class int, n bigint")


def best_classes(counts: DataFrame, pair: np.ndarray) -> DataFrame:
    """(item, class): the class under which the item's neighbours are likeliest, the class bigrams fixed; the end's is left out."""
    log = np.log(pair + 0.5)
    mass = np.log(pair.sum(axis=0) + 0.5 * CLASSES)

    def run(batches):
        for batch in batches:
            for block, at, n in zip(batch.column("block").to_pylist(), batch.column("at"), batch.column("n"), strict=True):
                sides = np.zeros(BLOCK_CELLS)
                sides[np.frombuffer(at.as_buffer(), np.uint16)] = np.frombuffer(n.as_buffer(), np.int64)
                left, right = sides.reshape(BLOCK_ITEMS, 2, CLASSES).transpose(1, 0, 2)
                value = left @ log + right @ log.T - 2 * left.sum(axis=1, keepdims=True) * mass
                seen = np.flatnonzero(left.any(axis=1) | right.any(axis=1))
                best = value[seen, :-1].argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array((block * BLOCK_ITEMS + seen).astype(np.int32)), pa.array(best.astype(np.int32))], names=["item", "class"])

    return counts.where("block >= 0").mapInArrow(run, "item int, class int")


def class_bigrams(counts: DataFrame) -> np.ndarray:
    pair = np.zeros(CLASSES * CLASSES)
    for r in counts.where("block = -1").collect():  # one row
        pair[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.int64)
    return pair.reshape(CLASSES, CLASSES)


def likelihood(pair: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for a term that no exchange changes."""
    return float(_h(pair).sum() - _h(pair.sum(axis=0)).sum() - _h(pair.sum(axis=1)).sum())


def exchange_all(src: DataFrame, own: np.ndarray, klass: np.ndarray, rounds: int = ALL_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all items after at most ``rounds`` rounds over ``src``, and the class bigrams."""
    spark, kept = src.sparkSession, None
    sequences = stored(item_sequences(src, own))  # texts are cut into words once, not in every round
    for left in range(rounds, -1, -1):
        counts = stored(block_counts(sequences, broadcast(spark, klass)))
        pair = class_bigrams(counts)
        if kept is not None and likelihood(pair) <= likelihood(kept[1]):
            discard(counts)
            break
        kept = klass, pair
        if left:
            moved = best_classes(counts, pair).toArrow()
            klass = klass.copy()
            klass[moved.column("item").to_numpy()] = moved.column("class").to_numpy()
        discard(counts)
    discard(sequences)
    return kept


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_classes(counts: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each item by the exchange algorithm; the last item keeps a class of its own (the last)."""
    k = len(counts)
    freq = counts.sum(axis=0)
    order = np.argsort(-freq[:-1], kind="stable")
    klass = np.empty(k, np.int64)
    klass[order] = np.arange(k - 1) % (classes - 1)
    klass[-1] = classes - 1
    onto = np.zeros((k, classes))
    onto[np.arange(k), klass] = 1
    n = onto.T @ counts @ onto
    for _ in range(rounds):
        moved = 0
        for w in order.tolist():
            if not freq[w]:
                continue
            old = klass[w]
            onto[w, old] = 0
            s = counts[w, w]
            right = counts[w] @ onto
            left = counts[:, w] @ onto
            n[old] -= right
            n[:, old] -= left
            n[old, old] -= s
            # w in class c: row and column c of the class bigrams grow by right and left
            gain = _h(n + right[None, :]) - _h(n)
            row = gain.sum(axis=1) - np.diag(gain)
            gain = _h(n + left[:, None]) - _h(n)
            col = gain.sum(axis=0) - np.diag(gain)
            d = np.diag(n)
            both = _h(d + left + right + s) - _h(d)
            out, into = n.sum(axis=1), n.sum(axis=0)
            cost = _h(out + right.sum() + s) - _h(out) + _h(into + left.sum() + s) - _h(into)
            value = (row + col + both - cost)[:-1]
            best = int(value.argmax())
            if value[best] <= value[old] + 1e-9:
                best = old
            moved += best != old
            klass[w] = best
            onto[w, best] = 1
            n[best] += right
            n[:, best] += left
            n[best, best] += s
        if not moved:
            break
    return klass


def _least_count(counts: DataFrame) -> int:
    """The least count that at most KNOWN_WORDS words reach (a histogram of 32 steps a doubling, no sort)."""
    step = F.floor(F.log2("n") * 32)
    hist = counts.groupBy(step.alias("s")).agg(F.count("*").alias("v"), F.min("n").alias("least")).collect()
    held, least = 0, 1 << 62
    for r in sorted(hist, key=lambda r: -r["s"]):
        held += r["v"]
        if held > KNOWN_WORDS:
            break
        least = r["least"]
    return least


def fit(src: DataFrame) -> tuple[Model, DataFrame]:
    """Model and the whole table of word counts, from every row of ``src`` (t)."""
    spark = src.sparkSession
    counts = stored(word_counts(src))
    stats = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("n1"),
                                         F.sum((F.col("n") == 2).cast("long")).alias("n2")).toPandas()
    total, distinct = int(stats["n"].sum()), int(stats["v"].sum())
    known = counts.where((F.col("n") >= _least_count(counts)) | (F.col("word") == int(END_HASH))).toArrow()
    words, cnt, bucket = (known.column(c).to_numpy().astype(np.int64) for c in ("word", "n", "bucket"))
    order = np.argsort(words)
    words, cnt, bucket = words[order], cnt[order], bucket[order]
    end_docs = int(cnt[words == END_HASH].sum())
    mine = (cnt >= OWN_COUNT) & (words != END_HASH)
    own, own_count, own_bucket = words[mine], cnt[mine], bucket[mine]
    real = stats[stats["bucket"] >= 0]
    n1, n2 = float(real["n1"].sum()), float(real["n2"].sum())
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    b_total, b_words = np.zeros(BUCKETS), np.zeros(BUCKETS)
    b_total[real["bucket"].to_numpy(np.int64)] = real["n"].to_numpy()
    b_words[real["bucket"].to_numpy(np.int64)] = real["v"].to_numpy()
    np.subtract.at(b_total, own_bucket, own_count - discount)

    top = np.sort(np.lexsort((own, -own_count))[:HEAD_WORDS])
    head = exchange_classes(bigram_counts(src, own[top]))
    klass = np.concatenate([head[len(top) + own_bucket], head[len(top):]])  # at first, that of the bucket
    klass[top] = head[:len(top)]
    klass, pair = exchange_all(src, own, klass)
    uni = np.concatenate([own_count - discount, b_total, [end_docs]]) + 1e-3  # each item has some mass
    of_class = np.bincount(klass, weights=uni, minlength=CLASSES)
    prior = of_class / of_class.sum()
    kappa = 10.0
    trans = np.log10(np.maximum((pair + kappa * prior) / (pair.sum(axis=1, keepdims=True) + kappa), 1e-300))  # a class may be empty
    emit = np.log10(uni / of_class[klass])
    return Model(words, cnt, own, klass, trans, emit, b_total, b_words, discount, total, distinct), counts


def _in_bucket(m: Model, c: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """log10 P(word | bucket) of words with count c (0: new)."""
    n, v = m.bucket_total[bucket], m.bucket_words[bucket]
    seen = np.maximum(c - m.discount, 1e-9) / np.maximum(n, 1e-9)
    new = np.where(n > 0, (m.discount * v + 1e-9) / np.maximum(n, 1e-9), 1.0)
    return np.log10(np.where(c > 0, seen, new))


def _base(m: Model, c: np.ndarray) -> np.ndarray:
    return np.log10((c + 0.1) / (m.total + 0.1 * (m.distinct + 1)))


def score(docs: DataFrame, model: Model, counts: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    spark = docs.sparkSession
    shared = broadcast(spark, model)
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("t"))
    schema = "rid bigint, doc_id bigint, n_tokens bigint, word bigint, bucket int, n bigint, known bigint, base double, model double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        m = shared()
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j, data, off in byte_chunks(batch.column(1)):
                docs_here = j - i
                h, bucket, is_end, doc, size = _sequence(data, off, docs_here)
                item = _items(h, bucket, m.own)
                klass = m.klass[item]
                logp = m.trans[_previous(klass, m.klass[-1]), klass] + m.emit[item]
                at = np.minimum(np.searchsorted(m.words, h), max(0, len(m.words) - 1))
                found = m.words[at] == h if len(m.words) else np.zeros(len(h), bool)
                found |= is_end
                c = np.where(found, m.counts[at] if len(m.words) else 0, 0)
                c[is_end & (m.words[at] != h if len(m.words) else True)] = 0
                in_bucket = (item >= len(m.own)) & ~is_end
                now = found & in_bucket
                logp[now] += _in_bucket(m, c[now], bucket[now])
                base = np.where(found, _base(m, c), 0.0)
                begin = np.cumsum(size) - size
                ids = batch.column(0).slice(i, docs_here)
                zero = pa.nulls(docs_here, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(rid + np.arange(docs_here)), ids, pa.array(size.astype(np.int64)), zero, pa.nulls(docs_here, pa.int32()), zero,
                    pa.array(np.add.reduceat((found & (c > 0)).astype(np.int64), begin)), pa.array(np.add.reduceat(base, begin)),
                    pa.array(np.add.reduceat(logp, begin))], names=names)
                rest = np.flatnonzero(~found)
                if len(rest):  # words beyond the broadcast ones: looked up by a join
                    order = rest[np.lexsort((h[rest], doc[rest]))]
                    first = np.ones(len(order), bool)
                    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                    start = np.flatnonzero(first)
                    k = len(start)
                    nul = pa.nulls(k, pa.int64())
                    fl = pa.nulls(k, pa.float64())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rid + doc[order[start]]), nul, nul, pa.array(h[order[start]]), pa.array(bucket[order[start]].astype(np.int32)),
                        pa.array(np.diff(np.append(start, len(order))).astype(np.int64)), nul, fl, fl], names=names)
                rid += docs_here

    rows = stored(src.mapInArrow(run, schema))
    local = rows.where("word is null").select("rid", "doc_id", "n_tokens", "known", "base", "model")
    rare = rows.where("word is not null").select("rid", "word", "bucket", "n")
    rare = rare.join(counts.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    per = spark.createDataFrame([(k, float(model.bucket_total[k]), float(model.bucket_words[k])) for k in range(BUCKETS)], "bucket int, bn double, bv double")
    rare = rare.join(F.broadcast(per), "bucket")  # one row for each bucket: a fixed number
    d, norm = model.discount, model.total + 0.1 * (model.distinct + 1)
    bn = F.greatest(F.col("bn"), F.lit(1e-9))
    p = F.when(F.col("c") > 0, F.greatest(F.col("c") - d, F.lit(1e-9)) / bn).when(F.col("bn") > 0, (d * F.col("bv") + 1e-9) / bn).otherwise(1.0)
    rare = rare.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
                                   F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / norm)).alias("rare_base"),
                                   F.sum(F.col("n") * F.log10(p)).alias("rare_model"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return local.join(rare, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("model") + zero("rare_model")).alias("score"))
