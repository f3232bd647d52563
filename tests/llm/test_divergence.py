import collections
import random
import re

import numpy as np
import pytest

from tracetide.llm import divergence as D

from . import helpers as H

SCHEMA = "doc_id bigint, text string, lang string, source string"
WORD = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=10, top=10):
    """Set of (lang, source, part, item, value, rank), counted with plain dictionaries."""
    df, tf, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = [w.decode() for w in WORD.findall((text or "").encode().lower())]
        df[lang].update(set(words))
        tf[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)

        def freq(count, v=v, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}

        p = {s: freq(tf[lang, s]) for s in sources}
        q = freq(sum((tf[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            price = lambda a, b: (a - b) ** 2 // (a + b)
            pairs = [(o, sum(price(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, price(p[s][t], q[t])) for t in kept if tf[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])}
    return out


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def fixture(seed=0):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("al", "Be", "é", "日本", "ça", "x") for b in ("pha", "ta", "q", "ß", "ZZ")]
    rows = [(k, " ".join(rng.choice(words[:5 + 5 * (k % 5)]) + rng.choice([" ", "7", "_", "\x7f", "\n"]) for _ in range(rng.randint(0, 30))),
             rng.choice(["en", "en", "fr", None]), rng.choice(["web", "web", "web", "book", "news", None, ""])) for k in range(220)]
    rows += [(900, None, "en", "quiet"), (901, "", "en", "empty"), (902, "12 34 --", "de", "alone"), (903, None, None, None), (904, "alone", "xx", "a"),
             (905, "alpha " * 20_000, "en", "long"), (906, "z" * 60_000, "en", "long"), (None, "alpha beta", "en", "web")]
    return rows + [(907, "alpha alpha beta", "en", "copy")] * 12


@pytest.mark.parametrize(("block", "sources"), [(4096, 64), (4, 2)])
def test_against_brute_force(spark, monkeypatch, block, sources):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "SOURCES", sources)
    monkeypatch.setattr(D, "PAIRS_AT_ONCE", 3 if sources == 2 else 256)
    rows = fixture()
    assert got(D.audit(H.frame(spark, rows, SCHEMA).repartition(5))) == brute(rows)


def test_hot_source_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(D, "SOURCES", 4)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(6)), "en", "hot" if k % 3 == 0 else f"s{k % 17}") for k in range(300)]
    assert got(D.audit(H.frame(spark, rows, SCHEMA).repartition(7))) == brute(rows)


def test_no_kept_term_and_empty_table(spark):
    rows = [(1, "one", "en", "a"), (2, "two", "en", "b"), (3, None, "fr", "c")]
    assert got(D.audit(H.frame(spark, rows, SCHEMA))) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert got(D.audit(H.frame(spark, [], SCHEMA))) == set()


def test_ties_go_by_the_bytes_of_the_item(spark):
    # one term in each source alone and as often: equal values
    rows = [(k, f"{w} shared", "en", s) for s, w in (("é", "z"), ("z", "é"), ("a", "B"), ("ä", "日")) for k in range(10)]
    out = got(D.audit(H.frame(spark, rows, SCHEMA)))
    assert out == brute(rows)
    assert [r[3] for r in sorted((r for r in out if r[1] == "a" and r[2] == "pair"), key=lambda r: r[5])] == ["z", "ä", "é"]


def test_equal_subtrees_share_nodes_and_are_priced_once():
    counts = np.zeros((3, 1024), np.int64)
    counts[1, 5] = counts[2, 5] = 7
    forest = D.Forest(counts)
    assert [forest.width(k) for k in range(11)] == [2] * 11  # all zero, or the 7 somewhere: two nodes a level
    assert forest.roots[1] == forest.roots[2] != forest.roots[0]
    total = np.array([100, 107, 107])
    walk = D.Walk(forest, np.array([0, 0]), np.array([1, 2]), total[[0, 0]], total[[1, 2]])
    assert len(walk.price) == 2 and walk.top.tolist() == [0, 0]
    p, q = 1 + 10**9 * 2 // 100, 1 + 10**9 * 2 // 107
    r = 1 + 10**9 * 9 // 107
    assert walk.sums().tolist() == [1023 * ((p - q) ** 2 // (p + q)) + (p - r) ** 2 // (p + r)] * 2


def test_frequency_is_exact_where_products_pass_64_bits():
    c, total = np.array([0, 3, 10**13, 999_999_999_999]), np.array([7, 11, 3 * 10**13 + 1, 10**12 + 13])
    assert D.frequency(c, total).tolist() == [1 + 10**9 * (int(a) + 2) // int(b) for a, b in zip(c, total, strict=True)]


def test_best_terms_of_a_walk_are_those_of_a_sort():
    rng = np.random.default_rng(5)
    counts = np.concatenate([rng.poisson(rng.exponential(3, 300), (1, 300)), rng.poisson(3, (1, 300)), ], axis=0)
    counts = np.concatenate([counts, np.full((2, 212), -1)], axis=1)
    total = counts.clip(0).sum(axis=1) + 600
    walk = D.Walk(D.Forest(counts), np.array([0]), np.array([1]), total[:1], total[1:])
    (_, ids, value), = walk.best(10)
    p, q = D.frequency(counts[0, :300], np.full(300, total[0])), D.frequency(counts[1, :300], np.full(300, total[1]))
    want = np.where((counts[0, :300] > 0) & (p > q), (p - q) ** 2 // (p + q), -1)
    least = np.sort(want)[-10]
    assert sorted(zip(ids.tolist(), value.tolist(), strict=True)) == [(k, v) for k, v in enumerate(want.tolist()) if v >= least]
