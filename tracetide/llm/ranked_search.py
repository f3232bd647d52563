"""Ranked lexical search by dual trees: the best documents of every query item, exactly.

Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lowered.  With N documents that hold a term, L terms in all of them, n in one
document, df documents that hold a term and tf its occurrences in a document,

    w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    m = 50 + (50 n N) div L
    score = sum over the item's terms of  w * ((10^9 tf) div (1000 tf + 20 m))

1. One pass over the whole texts leaves (doc_id, n, term numbers, counts) for the
   terms that any item of a block of items holds; N, L and df are sums over it.
2. Each task takes its documents in blocks of at most ``DOCS`` documents and
   ``POSTINGS`` counts.  A block is a tree: documents that lean on the same term
   lie side by side, and a node holds for each term the largest value of
   any document below.  The items are a tree whose nodes hold the largest weight
   of each term.  Both trees are walked down together.  The sum of weight times
   value bounds the score of every (item, document) below a node pair; pairs
   whose bound is under the weakest kth score of the node's items are dropped as a
   whole.  What reaches the leaves is scored exactly.
3. A task puts out at most k documents of each item.  They are ranked in two
   steps, first in parts by a hash, so that no task ranks what all tasks found.

All scores are integers under 2^53 and sums of them are exact in doubles.

Items are a stated query set: they are read in blocks of at most ``ITEM_BYTES``
of text (one larger item is a block of its own), and all documents are
searched for each block.

Defined results: null or empty texts hold no term and are never found; an item
without a term, or whose terms no document holds, has no row.  Rows of one
item_id (null is one, too) are one item that has all their terms.  Repeated document rows
are ranked each; equal scores go by doc_id, null last, and then in any order of equal
rows.  Very long texts are read whole.  Empty tables give an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast, byte_breaks, byte_chunks, stored, word_array

K = 50
ITEM_BYTES = 8 << 20
DOCS = 2048
POSTINGS = 1 << 20
LEAF, FAN = 16, 4  # documents of a leaf, children of a node
PARTS = 64  # of each item's documents, in the first ranking
TERMS = byte_breaks((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def terms_of_texts(texts: list) -> tuple[pa.Array, np.ndarray]:
    """The terms of each text and the place of its text."""
    data = [(t or "").encode() for t in texts]
    off = np.cumsum([0, *map(len, data)])
    return word_array(np.frombuffer(b"".join(data), np.uint8), off, TERMS)


def document_vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that hold a term: int32 numbers and int64 counts of known terms, as bytes."""
    names = ["doc_id", "n", "terms", "tfs"]

    def run(batches):
        known = vocabulary()
        for batch in batches:
            for i, j, data, off in byte_chunks(batch.column(1)):
                words, doc = word_array(data, off, TERMS)
                n = np.bincount(doc, minlength=j - i)
                at = pc.index_in(words, value_set=known)
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                key, tf = np.unique(doc[hit] * len(known) + at.fill_null(0).to_numpy()[hit], return_counts=True)
                cuts = np.searchsorted(key, np.arange(j - i + 1) * len(known))
                term, some = (key % len(known)).astype(np.int32), np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array(n[some]),
                    pa.array([term[cuts[d]:cuts[d + 1]].tobytes() for d in some], pa.binary()),
                    pa.array([tf[cuts[d]:cuts[d + 1]].astype(np.int64).tobytes() for d in some], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms binary, tfs binary")


def document_counts(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """df of each term: summed in the tasks, then by Spark; one number for each term of the items comes to the driver."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    got = vectors.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(n_terms, np.int64)
    out[got["term"].to_numpy(np.int64)] = got["df"].to_numpy(np.int64)
    return out


class Levels:
    """A tree over leaves given as (term, leaf, value): level 0 has the leaves, each further one the maxima of FAN nodes."""

    def __init__(self, term: np.ndarray, leaf: np.ndarray, value: np.ndarray, n_leaves: int, n_terms: int):
        self.levels, self.n_terms = [], n_terms
        while True:
            order = np.lexsort((leaf, term))
            term, leaf, value = term[order], leaf[order], value[order]
            if len(term):
                first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (leaf[1:] != leaf[:-1])]))
                value = np.maximum.reduceat(value, first)
                term, leaf = term[first], leaf[first]
            self.levels.append((term, leaf, value, n_leaves))
            if n_leaves <= 1:
                return
            leaf, n_leaves = leaf // FAN, -(-n_leaves // FAN)

    def by_node(self, level: int):
        """Function node -> (terms, values)."""
        term, leaf, value, n = self.levels[level]
        order = np.argsort(leaf, kind="stable")
        cuts = np.searchsorted(leaf[order], np.arange(n + 1))
        return lambda k: (term[order[cuts[k]:cuts[k + 1]]], value[order[cuts[k]:cuts[k + 1]]])

    def by_term(self, level: int):
        """(cuts, nodes, values): the nodes that hold term t are nodes[cuts[t]:cuts[t + 1]]."""
        term, leaf, value, _ = self.levels[level]
        return np.searchsorted(term, np.arange(self.n_terms + 1)), leaf, value


def dot_all(terms: np.ndarray, weights: np.ndarray, postings, n: int) -> np.ndarray:
    """Sum of weight times value for each of n nodes."""
    cuts, nodes, values = postings
    size = cuts[terms + 1] - cuts[terms]
    total = int(size.sum())
    if not total:
        return np.zeros(n)
    begin = np.cumsum(size) - size
    at = np.arange(total) - np.repeat(begin - cuts[terms], size)
    return np.bincount(nodes[at], weights=values[at] * np.repeat(weights, size), minlength=n)


def dot_each(docs: np.ndarray, weight_of: np.ndarray, rows) -> np.ndarray:
    """Sum of weight times value for each of ``docs``, from the rows (cuts, terms, values) by document."""
    cuts, terms, values = rows
    size = cuts[docs + 1] - cuts[docs]
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(begin - cuts[docs], size)
    return np.bincount(np.repeat(np.arange(len(docs)), size), weights=values[at] * weight_of[terms[at]], minlength=len(docs))


class Block(NamedTuple):
    n: int
    doc_id: np.ndarray
    named: np.ndarray
    by_term: tuple  # (cuts, documents, values)
    by_doc: tuple  # (cuts, terms, values)


class ItemTree:
    """Items (item, term) in the order of their heaviest term, so that like items share nodes; ``weight`` by term."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, n_items: int):
        n_terms, self.weight = len(weight), weight.astype(float)
        weight = self.weight[term]
        top = np.full(n_items, -1)
        order = np.lexsort((-term, weight))
        top[item[order]] = term[order]  # the last one written is the heaviest
        self.place = np.argsort(top, kind="stable")
        at = np.empty(n_items, np.int64)
        at[self.place] = np.arange(n_items)
        self.tree = Levels(term, at[item], weight, n_items, n_terms)
        nodes = [self.tree.by_node(k) for k in range(len(self.tree.levels))]
        self.nodes = [[f(k) for k in range(level[3])] for f, level in zip(nodes, self.tree.levels, strict=True)]


class Searcher:
    """The k best documents of each item among all blocks seen so far."""

    def __init__(self, items: ItemTree, k: int):
        self.items, self.n_terms, self.k = items, len(items.weight), k
        n = len(items.place)
        self.best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(n)]  # score, doc_id, has an id
        self.least = np.ones(n)  # a document below it cannot be among the best
        self.scored = 0

    def take(self, doc_id: np.ndarray, named: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """A block of documents: their ids and, by document, the values of their terms."""
        n = len(doc_id)
        lean = np.full(n, -1)
        order = np.lexsort((value * self.items.weight[term], doc))
        lean[doc[order]] = term[order]
        rank = np.empty(n, np.int64)
        rank[np.argsort(lean, kind="stable")] = np.arange(n)
        of_rank = np.empty(n, np.int64)
        of_rank[rank] = np.arange(n)
        doc = rank[doc]
        tree = Levels(term, doc // LEAF, value, -(-n // LEAF), self.n_terms)
        by_term, by_doc = np.argsort(term, kind="stable"), np.argsort(doc, kind="stable")
        block = Block(n, doc_id[of_rank], named[of_rank], (np.searchsorted(term[by_term], np.arange(self.n_terms + 1)), doc[by_term], value[by_term]),
                      (np.searchsorted(doc[by_doc], np.arange(n + 1)), term[by_doc], value[by_doc]))
        floors = [self.least]
        while len(floors[-1]) > 1:
            floors.append(np.minimum.reduceat(floors[-1], np.arange(0, len(floors[-1]), FAN)))
        x, y = len(floors) - 1, len(tree.levels) - 1
        alive = {0: np.ones(tree.levels[y][3], bool)}  # item node -> document nodes that may hold a hit
        while True:
            postings, width = tree.by_term(y), tree.levels[y][3]
            for node in list(alive):
                bound = dot_all(*self.items.nodes[x][node], postings, width)
                alive[node] &= bound >= floors[x][node]
                if not alive[node].any():
                    del alive[node]
            if not (x or y):
                break
            if y:
                y -= 1
                alive = {node: np.repeat(a, FAN)[:tree.levels[y][3]] for node, a in alive.items()}
            if x:
                x -= 1
                alive = {child: a.copy() for node, a in alive.items() for child in range(FAN * node, min(FAN * node + FAN, len(floors[x])))}
        for item, leaves in alive.items():
            self.score(item, np.flatnonzero(np.repeat(leaves, LEAF)[:n]), block)

    def score(self, item: int, docs: np.ndarray, block: Block) -> None:
        """Exact scores of the documents that no bound has dropped; from their own terms if that is less work."""
        terms, weights = self.items.nodes[0][item]
        cuts = block.by_term[0]
        if (block.by_doc[0][docs + 1] - block.by_doc[0][docs]).sum() < (cuts[terms + 1] - cuts[terms]).sum():
            weight_of = np.zeros(self.n_terms)
            weight_of[terms] = weights
            score = dot_each(docs, weight_of, block.by_doc)
        else:
            score = dot_all(terms, weights, block.by_term, block.n)[docs]
        self.scored += len(docs)
        hit = score >= self.least[item]
        if not hit.any():
            return
        new = score[hit], block.doc_id[docs[hit]], block.named[docs[hit]]
        s, d, has = (np.concatenate([a, b]) for a, b in zip(self.best[item], new, strict=True))
        first = np.lexsort((d, ~has, -s))[:self.k]
        self.best[item] = s[first], d[first], has[first]
        if len(first) == self.k:
            self.least[item] = s[first[-1]]


def search_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """(item, doc_id, score): of each task at most k documents of each item; ``items`` are lists of texts."""
    spark = docs.sparkSession
    words, item = terms_of_texts([" ".join(t or "" for t in texts) for texts in items])
    known = words.dictionary_encode()
    vocabulary, n_terms = known.dictionary, len(known.dictionary)
    if not n_terms:
        return spark.createDataFrame([], "item bigint, doc_id bigint, score bigint")
    pair = np.unique(item * n_terms + known.indices.to_numpy())
    item, term = pair // n_terms, pair % n_terms
    vectors = stored(document_vectors(docs, broadcast(spark, vocabulary)))
    n_docs, n_all = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_counts(vectors, n_terms)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    tree = broadcast(spark, ItemTree(item, term, weight, len(items)))

    def blocks(batches):
        held, docs_held, size = [], 0, 0
        for batch in batches:
            bits = np.cumsum([len(t) // 4 for t in batch.column(2).to_pylist()])
            start = 0
            while start < batch.num_rows:
                before = bits[start - 1] if start else 0
                stop = min(batch.num_rows, start + DOCS - docs_held, max(start + 1, int(np.searchsorted(bits, before + POSTINGS - size, "right"))))
                held.append(batch.slice(start, stop - start))
                docs_held, size, start = docs_held + stop - start, size + int(bits[stop - 1] - before), stop
                if docs_held >= DOCS or size >= POSTINGS:
                    yield pa.Table.from_batches(held)
                    held, docs_held, size = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        found = Searcher(tree(), k)
        for block in blocks(batches):
            terms = [np.frombuffer(b, np.int32) for b in block.column(2).to_pylist()]
            tf = np.frombuffer(b"".join(block.column(3).to_pylist()), np.int64)
            doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            m = 50 + (50 * block.column(1).to_numpy() * n_docs) // n_all
            value = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
            ids = block.column(0).combine_chunks()
            found.take(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), doc, np.concatenate(terms).astype(np.int64), value.astype(float))
        for at, (score, doc_id, has) in enumerate(found.best):
            if len(score):
                item = np.full(len(score), found.items.place[at], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc_id.astype(np.int64), mask=~has), pa.array(score.astype(np.int64))],
                                                 names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def item_blocks(items: DataFrame, limit: int = ITEM_BYTES):
    """Yield lists of (item_id, [texts]) of at most about ``limit`` bytes, items in order of their ids."""
    held, size = {}, 0
    rows = items.where("text is not null").repartitionByRange("item_id").sortWithinPartitions("item_id")
    for row in rows.toLocalIterator():
        if row.item_id not in held and size >= limit:
            yield list(held.items())
            held, size = {}, 0
        held.setdefault(row.item_id, []).append(row.text)
        size += len(row.text.encode())
    if held:
        yield list(held.items())


def search(docs: DataFrame, items: DataFrame, *, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents with a score above 0."""
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    asked = items.select(items[item_id].cast("bigint").alias("item_id"), items[item_text].cast("string").alias("text"))
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    by_score = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for block in item_blocks(asked):
        ids = docs.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item bigint, item_id bigint")
        found = search_block(src, [texts for _, texts in block], k).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
        some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by_score))).where(F.col("rank") <= k).drop("rank")
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by_score))).where(F.col("rank") <= k)
        out = out.unionByName(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    return out
