import collections
import math
import random
import re

import numpy as np
import pytest

from tracetide.llm import ranked_search as R

from . import helpers as H

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    return TERM.findall((text or "").encode().lower())


def brute(docs, items, k=50):
    """List of (item_id, rank, doc_id, score), by plain counting."""
    tf = [collections.Counter(terms(t)) for _, t in docs]
    size = [sum(c.values()) for c in tf]
    n_docs, n_all = sum(n > 0 for n in size), sum(size)
    df = collections.Counter(t for c in tf for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, want in asked.items():
        found = []
        for (d, _), c, n in zip(docs, tf, size, strict=True):
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_all)))
                        for t in want if c[t])
            if score > 0:
                found.append((-score, d is None, d, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r + 1, d, s) for r, (_, _, d, s) in enumerate(found[:k])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def fixture(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Éa", "日本", "naïve", "B2"]
    draw = lambda m: " ".join(words[min(int(rng.expovariate(0.12)), len(words) - 1)] for _ in range(m))
    docs = [(k, draw(rng.randint(0, 40))) for k in range(n)]
    docs += [(1000, None), (1001, ""), (1002, "-- _ !"), (1003, draw(3000)), (1004, "w1 " * 30_000), (1005, "b2"), (1005, "b2"), (1006, "B2"), (None, "b2"), (7, "w3 w3")]
    docs += [(2000 + k, "w5 w6 w7") for k in range(70)]  # more equal scores than an item has room for
    items = [(k, draw(rng.randint(1, 9))) for k in range(23)] + [(50, None), (51, ""), (52, "unseen"), (53, "w5 w6 w7"), (54, "b2"), (None, "w9"), (55, "w1"), (55, "w2 w2")]
    return docs, items


@pytest.mark.parametrize(("docs_in_block", "item_bytes", "k"), [(2048, 8 << 20, 50), (40, 60, 5), (7, 8 << 20, 50)])
def test_against_brute_force(spark, monkeypatch, docs_in_block, item_bytes, k):
    monkeypatch.setattr(R, "DOCS", docs_in_block)
    monkeypatch.setattr(R, "POSTINGS", 90 if docs_in_block == 7 else 1 << 20)
    monkeypatch.setattr(R.item_blocks, "__defaults__", (item_bytes,))
    docs, items = fixture()
    asked = H.frame(spark, items, ITEMS)
    assert got(R.search(H.frame(spark, docs).repartition(3), asked, k=k)) == brute(docs, items, k)


def test_item_blocks_keep_every_item(spark, monkeypatch):
    rows = [(k % 9, "x" * 50) for k in range(30)] + [(None, "y"), (3, None)]
    blocks = list(R.item_blocks(spark.createDataFrame(rows, ITEMS), 120))
    ids = [i for b in blocks for i, _ in b]
    assert len(blocks) > 2 and len(set(ids)) == len(ids) == 10 and sum(len(t) for b in blocks for _, t in b) == 31


def test_empty_tables_and_texts(spark):
    docs, items = fixture(20)
    none = H.frame(spark, [])
    assert got(R.search(none, H.frame(spark, items, ITEMS))) == []
    assert got(R.search(H.frame(spark, docs), H.frame(spark, [], ITEMS))) == []
    assert got(R.search(H.frame(spark, docs), H.frame(spark, [(1, "?"), (2, None)], ITEMS))) == []
    assert got(R.search(H.frame(spark, [(1, None), (2, " ")]), H.frame(spark, items, ITEMS))) == []


def block_of(rng, n, n_terms):
    doc, term = np.nonzero(rng.random((n, n_terms)) < 0.1)
    return doc, term, np.floor(rng.random(len(doc)) * 1e6)


def test_bounds_drop_whole_batches_and_no_hit():
    rng = np.random.default_rng(2)
    n_terms, n_items, k = 40, 30, 5
    item, term = np.nonzero(rng.random((n_items, n_terms)) < 0.1)
    weight = rng.integers(1, 9000, n_terms)
    tree = R.ItemTree(item, term, weight, n_items)
    found = R.Searcher(tree, k)
    score = np.zeros((n_items, 0))
    dense = np.zeros((n_items, n_terms))
    dense[item, term] = weight[term]
    n_seen = 0
    for step in range(12):
        doc, t, value = block_of(rng, 300, n_terms)
        value = np.floor(value / (1 + 9 * step))  # later blocks score lower
        x = np.zeros((n_terms, 300))
        x[t, doc] = value
        score = np.concatenate([score, dense @ x], axis=1)
        found.take(np.arange(n_seen, n_seen + 300), np.ones(300, bool), doc, t, value)
        n_seen += 300
    assert found.scored < 0.4 * n_items * n_seen
    for at, (s, d, _) in enumerate(found.best):
        own = score[tree.place[at]]
        order = np.lexsort((np.arange(n_seen), -own))[:k]
        order = order[own[order] > 0]
        assert d.tolist() == order.tolist() and s.tolist() == own[order].tolist()


def test_a_node_bounds_all_below_it():
    rng = np.random.default_rng(4)
    doc, term, value = block_of(rng, 100, 30)
    tree = R.Levels(term, doc, value, 100, 30)
    x = np.zeros((30, 100))
    x[term, doc] = value
    weights = rng.integers(1, 99, 30).astype(float)
    for level, (_, _, _, n) in enumerate(tree.levels):
        bound = R.dot_all(np.arange(30), weights, tree.by_term(level), n)
        assert (np.repeat(bound, R.FAN**level)[:100] >= weights @ x).all()
