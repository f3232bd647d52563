"""Toxicity by weak supervision.

* Voters.  Word forms and stems that mark toxic texts in a bounded sample of
  labelled rows are dealt over ``LEXICONS`` lexicon voters; pattern voters look
  at shape only (shouting, exclamation runs, lists, symbols, links, length).  A
  voter says toxic (1), clean (-1) or nothing (0).
* Label model.  A generative model of the votes, fitted by expectation-
  maximisation, gives each voter's accuracies by class; the voters' correlations
  given the class (beyond what the class explains) temper the weight of voters
  that say the same.  Its posteriors are the training labels.
* Classifier.  A logistic regression on hashed stems and word forms is trained
  on the posteriors and calibrated on the sample's labels.  Every whole text is
  scored by it in numpy batches; the model has a fixed size and is broadcast.

Only the sample (at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of the
id) is looked at for fitting.

Defined results: null and empty texts get the score of a text without any
feature; without labels, or with one kind of label only, every score is the
share of toxic labels (0 without any); labels other than 0 and 1 are not used;
repeated labels count each time; repeated rows are scored each time; a null id
is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, broadcast, byte_chunks, i64, splitmix, stored, words_of

TRAIN_ROWS = 20_000  # documented bound of the labelled sample
STEMS = (4, 5, 6)  # bytes of a stem; the whole form (up to 16 bytes) is a feature too
MIN_DOCS = 4
EVIDENCE = 30  # least likelihood ratio of a feature
FEATURES = 4096
LEXICON = 768
LEXICONS = 16
PATTERNS = 6
_SLOTS = 1 << 18

_BREAKS = np.ones(256, bool)
_BREAKS[97:123] = _BREAKS[65:91] = _BREAKS[128:] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@~^<>{}[]\\"]] = True


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def _features(data: np.ndarray, off: np.ndarray):
    """(hash, document) of every stem and form of every word, not yet distinct."""
    low, s, e, doc = words_of(data, off, _BREAKS)
    if not len(s):
        return np.empty(0, U64), np.empty(0, np.int64)
    pad = np.concatenate([low, np.zeros(16, np.uint8)]).astype(U64)
    n = e - s
    first, second = np.zeros(len(s), U64), np.zeros(len(s), U64)
    for k in range(8):
        first |= np.where(n > k, pad[s + k], U64(0)) << U64(8 * k)
        second |= np.where(n > k + 8, pad[s + k + 8], U64(0)) << U64(8 * k)
    hs, ds = [splitmix(splitmix(first + U64(99)) ^ second)], [doc]
    for p in STEMS:
        longer = n >= p
        hs.append(splitmix((first[longer] & U64((1 << 8 * p) - 1)) + U64(p << 56)))
        ds.append(doc[longer])
    return np.concatenate(hs), np.concatenate(ds)


def _pattern_votes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, PATTERNS) votes of 1, 0 and -1 from the text's shape."""
    m = len(off) - 1
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    size = np.maximum(np.diff(off), 1)
    pairs = np.zeros(len(data), bool)
    pairs[:-1] = (data[:-1] == 33) & (data[1:] == 33)
    out = np.zeros((m, PATTERNS), np.int8)
    out[:, 0] = np.where(count(_UPPER[data]) > 0.3 * size, -1, 0)
    out[:, 1] = np.where(count(pairs) > 3, -1, 0)
    out[:, 2] = np.where(count(data == 124) > 5, -1, 0)
    out[:, 3] = np.where(count(_SYMBOL[data]) > 0.03 * size, -1, 0)
    out[:, 4] = np.where(count((data >= 48) & (data < 58)) > 0.05 * size, -1, 0)
    out[:, 5] = np.where(size < 80, -1, 0)
    return out


def _lookup(table: np.ndarray, h: np.ndarray):
    """(positions in h, index in table) of the hashes that the sorted table holds."""
    if not len(table) or not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    slots = np.zeros(_SLOTS, bool)
    slots[(table & U64(_SLOTS - 1)).astype(np.int64)] = True
    hit = np.flatnonzero(slots[(h & U64(_SLOTS - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, h[hit]), len(table) - 1)
    ok = table[at] == h[hit]
    return hit[ok], at[ok]


def label_model(votes: np.ndarray, prior: float, labels: np.ndarray | None = None, trust: float = 0.5, rounds: int = 40):
    """Posterior of class 1 for each row of votes (-1, 0, 1), the voters' accuracies and correlations.

    Known labels, if given, anchor the accuracies with weight ``trust``: votes
    that only repeat each other do not tell the classes apart.
    """
    n, m = votes.shape
    positive = (votes == 1).sum(axis=1)
    post = np.where(positive > 0, 0.9, 0.1 * prior + 0.01)
    kinds = [(votes == v).astype(np.float64) for v in (-1, 0, 1)]
    weight, share = np.ones(m), np.clip(prior, 1e-4, 1 - 1e-4)  # the class share is known from the labels
    rates, corr = None, np.zeros((m, m))
    for it in range(rounds):
        rates = []
        one = post if labels is None else (1 - trust) * post + trust * labels
        for q in (1 - one, one):
            t = q.sum() + 1.5
            rates.append(np.stack([(q @ k + 0.5) / t for k in kinds], axis=1))  # (voters, 3)
        if it % 10 == 9:  # what the class does not explain
            v = votes.astype(np.float64)
            mean0, mean1 = rates[0] @ [-1, 0, 1], rates[1] @ [-1, 0, 1]
            r = v - (1 - post)[:, None] * mean0 - post[:, None] * mean1
            cov = r.T @ r / n
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = cov / sd[:, None] / sd[None, :]
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.maximum(np.abs(corr) - 0.1, 0).sum(axis=1))
        ratio = np.log(rates[1]) - np.log(rates[0])
        # a voter that says nothing adds nothing
        score = np.log(share / (1 - share)) + sum(kinds[j] @ (weight * ratio[:, j]) for j in (0, 2))
        post = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    return post, rates, corr


def logistic(doc: np.ndarray, feature: np.ndarray, target: np.ndarray, size: int, steps: int = 150, decay: float = 1e-3):
    """Weights and bias of a logistic regression on binary features, by Adam on all rows."""
    n = len(target)
    w, b = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(doc, weights=w[feature], minlength=n)
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        grad = np.append(np.bincount(feature, weights=g[doc], minlength=size) / n + decay * w, g.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.15 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the scores by the labels (Newton steps, slope kept positive)."""
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        r, w = p - y, p * (1 - p) + 1e-6
        g = np.array([(r * z).mean() + 1e-4 * (a - 1), r.mean()])
        h = np.array([[(w * z * z).mean() + 1e-4, (w * z).mean()], [(w * z).mean(), w.mean()]])
        da, dc = np.linalg.solve(h, g)
        a, c = max(a - np.clip(da, -1, 1), 0.05), c - np.clip(dc, -1, 1)
    return a, c


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from ``labels`` (only rows that may be learned from), joined to ``docs`` by id."""
    spark = docs.sparkSession
    lab = labels.select(labels[doc_id].cast("bigint").alias("k"), labels[toxic].cast("int").alias("y")).where("k is not null and y in (0, 1)")
    total = lab.count()
    if total > train_rows:
        lab = lab.where(F.pmod(F.xxhash64(F.lit(23), "k"), F.lit(1_000_000)) < int(1e6 * train_rows / total))
    src = docs.select(docs[doc_id].cast("bigint").alias("k"), docs[text].cast("string").alias("t"))
    # the sample of labels has a fixed bound; the documents are not shuffled
    sample = stored(src.join(F.broadcast(lab), "k").select("t", "y"))

    def toxic_docs(batches):
        for batch in batches:
            hs = [np.unique((_distinct(*_features(d, o)))[0], return_counts=True) for _, _, d, o in byte_chunks(batch.column(0))]
            for h, c in hs:
                yield pa.RecordBatch.from_arrays([pa.array(i64(h)), pa.array(c.astype(np.int64))], names=["f", "n"])

    count = lambda d: d.select("t").mapInArrow(toxic_docs, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
    n1, n0 = sample.where("y = 1").count(), sample.where("y = 0").count()
    if not n1 or not n0:
        share = n1 / max(1, n0 + n1)
        return Model(np.empty(0, U64), np.empty(0), float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0))
    both = count(sample.where("y = 1")).where(f"n >= {MIN_DOCS}").withColumnRenamed("n", "a").join(count(sample.where("y = 0")).withColumnRenamed("n", "b"), "f", "left")
    both = both.withColumn("b", F.coalesce("b", F.lit(0)))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    # a feature's evidence: the likelihood ratio of its own share of toxic documents to the sample's
    p, t = n1 / (n0 + n1), F.col("a") + F.col("b")
    part = lambda c, q: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (t * q))).otherwise(0.0)
    got = both.select("f", "a", "b", odds.alias("odds"), (2 * (part("a", p) + part("b", 1 - p))).alias("strength"))
    got = got.where(f"strength >= {EVIDENCE}").orderBy(F.desc("strength"), "f").limit(FEATURES).toPandas()
    order = np.argsort(got["f"].to_numpy(np.int64).view(U64))
    table = got["f"].to_numpy(np.int64).view(U64)[order]
    lex = got[(got["odds"] > 3) & (got["a"] >= 20 * got["b"])].head(LEXICON)
    voter_of = np.full(len(table), -1)
    voter_of[np.searchsorted(table, lex["f"].to_numpy(np.int64).view(U64))] = np.arange(len(lex)) % LEXICONS

    def look(batches):
        base = 0
        for batch in batches:
            for i, j, d, o in byte_chunks(batch.column(0)):
                h, doc = _distinct(*_features(d, o))
                at, f = _lookup(table, h)
                votes = np.zeros((j - i, LEXICONS + PATTERNS + 1), np.int8)
                hit = voter_of[f] >= 0
                votes[doc[at[hit]], voter_of[f[hit]]] = 1
                votes[:, LEXICONS:-1] = _pattern_votes(d, o)
                votes[:, -1] = -(votes[:, :LEXICONS].max(axis=1) == 0).astype(np.int8)  # no lexicon speaks
                cut = np.searchsorted(doc[at], np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array([v.tobytes() for v in votes], pa.binary()),
                                                  pa.array([f[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                                                 names=["y", "votes", "features"])
                base += j - i

    seen = sample.select("t", "y").mapInArrow(look, "y int, votes binary, features binary").toArrow()  # a bounded sample
    y = seen.column("y").to_numpy().astype(np.float64)
    votes = np.frombuffer(b"".join(seen.column("votes").to_pylist()), np.int8).reshape(len(y), -1)
    parts = [np.frombuffer(b, np.int32) for b in seen.column("features").to_pylist()]
    doc, feature = np.repeat(np.arange(len(y)), [len(p) for p in parts]), np.concatenate(parts).astype(np.int64)
    post, _, _ = label_model(votes, n1 / (n0 + n1), y)
    w, b = logistic(doc, feature, post, len(table))
    a, c = calibrate(b + np.bincount(doc, weights=w[feature], minlength=len(y)), y)
    return Model(table, a * w, a * b + c)


def _distinct(h: np.ndarray, doc: np.ndarray):
    """Distinct pairs, ordered by document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    shared = broadcast(docs.sparkSession, model)
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("t"))

    def run(batches):
        m = shared()
        for batch in batches:
            z = np.full(batch.num_rows, m.bias)
            for i, j, d, o in byte_chunks(batch.column(1)):
                h, doc = _features(d, o)
                at, f = _lookup(m.features, h)
                if len(at):
                    pair = np.unique(doc[at] * len(m.features) + f)
                    z[i:j] += np.bincount(pair // len(m.features), weights=m.weights[pair % len(m.features)], minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"])

    return src.mapInArrow(run, "doc_id bigint, score double")
