"""Approximate nearest neighbours: a forest of random-projection trees.

* The trees are fitted on a sample of at most ``SAMPLE_ROWS`` vectors (chosen
  by a hash of the id): every node splits its points at the median of their
  projection on the line between two of them.  The forest has a fixed size and
  is broadcast.
* Every row is put into one leaf of each tree.
* A query goes through all trees with one priority queue: nodes are taken in
  order of their smallest margin to the splits above, until the leaves met hold
  a budget of rows.
* The budget is measured, not set: vectors of the sample are searched in it, and
  the budget is the one at which ``target_recall`` of their true neighbours are
  met.  Neighbours of the whole table are nearer than those of its sample, so
  they are met earlier.  Forests of each number of ``TREES`` are tried and the one
  with the smallest budget is taken.  One of them is a single tree, which meets
  every row once: a query is never compared with more rows than in a full scan,
  and with few where the vectors have any structure.
* In each leaf the candidates are ranked by their exact cosine; the best of all
  leaves are the answer.

Rows with one and the same vector tie, and of these only the smallest ids can
be among the k nearest, so more than k + 1 rows of a vector are not carried on
(a window limit, which Spark applies before the shuffle).  Equal query vectors
are searched once.  Leaves with many rows or queries are split into blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither do those of another length than most rows
(ties: the shorter); null ids take no part; ties go to the smaller id; a
repeated id is one row for each copy; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast, stored

TREES = (1, 8)
LEAF_SAMPLE = 100
SAMPLE_ROWS = 20_000  # documented bound of the fitting sample
TARGET_RECALL = 0.97  # of the sample's own neighbours; the answers' recall is tested
TRIALS = 200  # searches that measure the budget
BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048


class Tree:
    """Split nodes (normal, threshold, children); a child below 0 is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, seed: int, leaf: int):
        rng = np.random.default_rng(seed)
        self.normal, self.at, self.kids, self.size = [], [], [], []
        self.root = self._grow(sample, np.arange(len(sample)), leaf, rng)
        dim = sample.shape[1]
        self.normal = np.array(self.normal).reshape(-1, dim)
        self.at, self.kids = np.array(self.at), np.array(self.kids, np.int64).reshape(-1, 2)

    def _grow(self, x, rows, leaf, rng):
        if len(rows) > leaf:
            for _ in range(4):
                a, b = rng.choice(rows, 2, replace=False)
                normal = x[a] - x[b]
                length = np.linalg.norm(normal)
                if length < 1e-12:
                    continue
                normal = normal / length
                p = x[rows] @ normal
                at = float(np.median(p))
                left = p < at
                if 0 < left.sum() < len(rows):
                    me = len(self.at)
                    self.normal.append(normal)
                    self.at.append(at)
                    self.kids.append([0, 0])
                    self.kids[me][0] = self._grow(x, rows[left], leaf, rng)
                    self.kids[me][1] = self._grow(x, rows[~left], leaf, rng)
                    return me
        self.size.append(len(rows))
        return -len(self.size)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row, level by level."""
        node = np.full(len(x), self.root, np.int64)
        live = np.flatnonzero(node >= 0)
        while len(live):
            k = node[live]
            side = np.einsum("ij,ij->i", x[live], self.normal[k]) >= self.at[k]
            node[live] = self.kids[k, side.astype(np.int64)]
            live = live[node[live] >= 0]
        return -1 - node


class Forest:
    """Trees and ``want``, the rows of the sample that a search meets (with repeats over the trees)."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7):
        self.trees = [Tree(sample, seed + t, leaf) for t in range(trees)]
        self.first = np.cumsum([0] + [len(t.size) for t in self.trees])
        self.want = float("inf")

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): bucket of each row in each tree."""
        return np.stack([t.leaves(x) + self.first[k] for k, t in enumerate(self.trees)], axis=1)

    def search(self, q: np.ndarray) -> list[int]:
        """Buckets to look at, nearest splits first, over all trees."""
        margins = [t.normal @ q - t.at for t in self.trees]
        queue = [(-np.inf, k, t.root) for k, t in enumerate(self.trees)]
        out, held = [], 0
        while queue and held < self.want:
            worst, k, node = heapq.heappop(queue)
            tree = self.trees[k]
            if node < 0:
                out.append(int(self.first[k]) - 1 - node)
                held += tree.size[-1 - node]
                continue
            m = float(margins[k][node])
            side = int(m >= 0)
            heapq.heappush(queue, (worst, k, int(tree.kids[node, side])))
            heapq.heappush(queue, (max(worst, abs(m)), k, int(tree.kids[node, 1 - side])))
        return out


def fit(sample: np.ndarray, k: int, trees=TREES, leaf: int = LEAF_SAMPLE, target: float = TARGET_RECALL) -> Forest:
    """The forest with the smallest budget that meets ``target`` of the ``k`` nearest of TRIALS vectors of the sample."""
    distinct = np.unique(sample, axis=0)  # copies of a vector are in its own leaf: they say nothing
    forests = [Forest(sample, t, leaf) for t in trees]
    if len(distinct) < 2:
        return forests[0]
    near_k = min(k, len(distinct) - 1)
    asked = np.unique(np.linspace(0, len(distinct) - 1, TRIALS).astype(np.int64))
    sims = distinct[asked] @ distinct.T
    sims[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-sims, near_k - 1, axis=1)[:, :near_k]
    for forest in forests:
        where, sizes = forest.buckets(distinct), np.concatenate([t.size for t in forest.trees])
        met = np.empty(near.shape)  # rows met before the neighbour's first leaf is done
        for i, q in enumerate(asked.tolist()):
            order = forest.search(distinct[q])
            rows = np.empty(len(sizes))
            rows[order] = np.cumsum(sizes[order])
            met[i] = rows[where[near[i]]].min(axis=1)
        forest.want = max(float(np.quantile(met, target, method="higher")), (k + 1.0) * len(forest.trees))  # k others at least
    return min(forests, key=lambda f: f.want)


def _matrix(col) -> np.ndarray:
    if not len(col):
        return np.empty((0, 0))
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v (floats or doubles, as given) of the rows that take part."""
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = rows.select(rows[vec_id].cast("bigint").alias("id"), rows[vector].cast(kind).alias("v"))
    v = v.where("id is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    v = v.withColumn("len", F.size("v"))
    common = v.groupBy("len").count().orderBy(F.desc("count"), "len").limit(1).select("len")
    return v.join(F.broadcast(common), "len").drop("len")  # one row


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of row pairs, summed in the same way for equal vectors."""
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def best_of_block(qid, q, vid, x, k):
    """(query, id, score) of the k best rows of the block for each query; ties to smaller ids."""
    qn, xn = q / np.linalg.norm(q, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
    for s in range(0, len(q), 256):
        sims = qn[s:s + 256] @ xn.T
        if x.shape[0] > k:
            cut = np.partition(sims, len(x) - k, axis=1)[:, len(x) - k] - 1e-9
            i, j = np.nonzero(sims >= cut[:, None])
        else:
            i, j = (a.ravel() for a in np.indices(sims.shape))
        score = np.concatenate([_cosines(q[s + i[c:c + 65536]], x[j[c:c + 65536]]) for c in range(0, len(i), 65536)])
        order = np.lexsort((vid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        begin = np.concatenate([[0], np.flatnonzero(i[1:] != i[:-1]) + 1])
        rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
        keep = rank < k
        yield qid[s + i[keep]], vid[j[keep]], score[keep]


def nearest(rows: DataFrame, queries, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", trees=TREES,
            leaf_sample: int = LEAF_SAMPLE, sample_rows: int = SAMPLE_ROWS, target_recall: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query.

    ``queries``: condition on the column ``id`` that names the query rows.  A
    query is not its own neighbour.
    """
    spark = rows.sparkSession
    all_rows = usable(rows, vec_id, vector)
    k1 = k + 1
    same = Window.partitionBy("v").orderBy("id")
    kept = stored(all_rows.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= k1).drop("rn"))
    asked = stored(all_rows.where(queries))
    searches = stored(asked.groupBy("v").agg(F.min("id").alias("s")))  # equal query vectors are one search

    total = kept.count()
    sample = kept if total <= sample_rows else kept.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1_000_000)) < int(1e6 * sample_rows / total))
    got = sample.orderBy("id").toArrow().column("v").combine_chunks()
    x = _matrix(got)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.zeros((0, 1))
    shared = broadcast(spark, fit(unit, k, trees, leaf_sample, target_recall))

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1)
            m = _matrix(v)
            b = shared().buckets(m / np.linalg.norm(m, axis=1, keepdims=True))
            for t in range(b.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(b[:, t]), batch.column(0), v], names=["bucket", "id", "v"])

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1))
            found = [shared().search(q) for q in m / np.linalg.norm(m, axis=1, keepdims=True)]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.array([b for f in found for b in f], np.int64)), batch.column(0).take(pa.array(at)),
                                              batch.column(1).take(pa.array(at))], names=["bucket", "s", "qv"])

    kind = kept.schema["v"].dataType.simpleString()
    placed = kept.select("id", "v").mapInArrow(place, f"bucket bigint, id bigint, v {kind}")
    probes = stored(searches.select("s", "v").repartition(F.col("s")).mapInArrow(probe, f"bucket bigint, s bigint, qv {kind}"))
    # leaves are a fixed number, so their counts may go to the driver
    n_rows = {r[0]: r[1] for r in placed.groupBy("bucket").count().collect()}
    n_asks = {r[0]: r[1] for r in probes.groupBy("bucket").count().collect()}
    plan = [(b, -(-n_rows.get(b, 1) // BLOCK_ROWS), -(-n // BLOCK_QUERIES)) for b, n in n_asks.items()]
    grid = F.broadcast(spark.createDataFrame(plan or [(-1, 1, 1)], "bucket bigint, nr int, nq int"))
    part = lambda c, n: F.pmod(F.xxhash64(F.lit(5), c), F.col(n)).cast("int")
    row_blocks = placed.join(grid, "bucket").withColumn("r", part("id", "nr")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    ask_blocks = probes.join(grid, "bucket").withColumn("q", part("s", "nq")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))

    def rank(left, right):
        names = ["s", "id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({"s": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        out = list(best_of_block(left.column("s").to_numpy(), _matrix(left.column("qv").combine_chunks()), right.column("id").to_numpy(),
                                 _matrix(right.column("v").combine_chunks()), k1))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    found = ask_blocks.select("bucket", "r", "q", "s", "qv").groupBy("bucket", "r", "q").cogroup(
        row_blocks.select("bucket", "r", "q", "id", "v").groupBy("bucket", "r", "q")).applyInArrow(rank, "s bigint, id bigint, score double")
    # a row met in several trees counts once
    found = found.groupBy("s", "id").agg(F.max("score").alias("score"))
    best = found.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("score"), "id"))).where(F.col("rn") <= k1)
    out = asked.join(searches, "v").select(F.col("id").alias("query_id"), "s").join(best.select("s", F.col("id").alias("vec_id"), "score"), "s")
    out = out.where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
