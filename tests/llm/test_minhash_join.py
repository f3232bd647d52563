import collections
import random

import numpy as np
import pytest

from tracetide.llm import common, minhash_join as M

from . import helpers as H


def pairs_set(text):
    w = H.words(text)
    return {tuple(w[k:k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())


def brute(rows):
    """[(doc_id, n_shingles, component_id, kept)] in the order of the rows."""
    sets = [pairs_set(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    inv = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            inv[x].append(k)
    seen = {(a, b) for ks in inv.values() for b in ks for a in ks if a < b}
    for a, b in seen:
        common_ = len(sets[a] & sets[b])
        if 100 * common_ >= 80 * (len(sets[a]) + len(sets[b]) - common_):
            head[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        name = min((x for x in ids[find(k)] if x is not None), default=None) if sets[k] else i
        out.append((i, len(sets[k]), name, name is None or i == name))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(text, n, rng):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


def fixture(seed=0):
    rng = random.Random(seed)
    rows = H.documents_fixture()
    text = dict(rows)
    base = " ".join(f"b{rng.randrange(10**6)}" for _ in range(120))
    rows += [(20_000 + k, edited(base, rng.randint(0, 9), rng)) for k in range(60)]
    rows += [(21_000 + k, edited(text[0], rng.randint(0, 12), rng)) for k in range(40)]
    passage = " ".join(f"p{k}" for k in range(60))  # shared by many different documents, below the similarity
    rows += [(30_000 + k, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(10, 60)))) for k in range(80)]
    rows += [(40_000, "w"), (40_001, "W"), (40_002, "w w"), (40_003, "w w w"), (39_999, "w  w")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 9])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    from tracetide.llm import jaccard_join
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = fixture(block)
    assert got(M.near_duplicates(H.frame(spark, rows).repartition(5))) == brute(rows)


def test_rows_without_id_repeated_ids_and_empty_sets(spark):
    rng = random.Random(8)
    base = " ".join(f"b{k}" for k in range(80))
    near = [edited(base, 4, rng) for _ in range(3)]
    rows = [(9, base), (None, base), (4, near[0]), (None, near[1]), (None, "only here"), (None, "only here"), (None, None), (3, None), (3, " "), (5, "a b"), (5, "c d"),
            (2, "c d"), (None, "x" * 50_000), (8, near[2]), (8, near[2])]
    assert got(M.near_duplicates(H.frame(spark, rows).repartition(3))) == brute(rows)
    assert got(M.near_duplicates(H.frame(spark, []))) == []


def test_a_document_without_id_joins_two_others(spark):
    # a and c are too far from each other; b, which has no id, links with both
    words = [f"k{k}" for k in range(200)]
    a, b, c = (" ".join(words[s:s + 150]) for s in (0, 14, 28))
    assert got(M.near_duplicates(H.frame(spark, [(2, a), (None, b), (1, c)]))) == brute([(2, a), (None, b), (1, c)])
    assert {r[2] for r in brute([(2, a), (None, b), (1, c)])} == {1}


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 1 << 16, (400, M.SYMBOLS)).astype(np.uint16)
    other = sig.copy()
    for k in range(len(sig)):  # as many errors as are allowed, also spread evenly over the chunks
        if k % 2:
            at = rng.choice(M.SYMBOLS, M.MAX_DISTANCE, replace=False)
        else:
            at = np.concatenate([c * M.CHUNK + rng.choice(M.CHUNK, M.ERRORS + (c < M.CHUNKS - 1), replace=False) for c in range(M.CHUNKS)])
        other[k, at] ^= rng.integers(1, 1 << 16, len(at)).astype(np.uint16)
    assert ((sig != other).sum(axis=1) == M.MAX_DISTANCE).all()
    assert (M.keys_of(sig) == M.keys_of(other)).any(axis=1).all()


def test_signature_distance_follows_the_similarity():
    rng = np.random.default_rng(1)
    for n, shared in ((9, 8), (90, 80), (900, 800)):  # similarities of 0.8
        far = []
        for _ in range(150):
            h = common.splitmix(rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64))
            two = np.concatenate([np.sort(h[:n]), np.sort(h[n - shared:])])
            sig = M.signatures(two, np.array([n, n]), np.array([0, n]))
            far.append(int((sig[0] != sig[1]).sum()))
        assert abs(np.mean(far) - M.SYMBOLS * 0.2) < 1 and max(far) <= M.MAX_DISTANCE


def test_buckets_are_whole_over_task_borders(spark):
    sig = np.zeros(M.SYMBOLS, np.uint16).tobytes()
    rows = [(k, bytearray(sig)) for k in range(500)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = M.bucket_rows(spark.createDataFrame(rows, "cid bigint, sig binary").repartition(4)).groupBy("key").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == M.SYMBOLS and {r["count"] for r in got} == {500}


def test_whole_units_do_not_depend_on_the_batches():
    import pyarrow as pa

    rng = random.Random(2)
    keys = sorted(rng.randrange(12) for _ in range(90))
    for _ in range(60):
        cuts = sorted({0, 90, *(rng.randrange(90) for _ in range(rng.randint(0, 30)))})
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(range(a, b))], names=["k", "v"]) for a, b in zip(cuts, cuts[1:])]
        units = [t.to_pydict() for t in M.whole_units(iter(batches), 1)]
        assert [v for u in units for v in u["v"]] == list(range(90))
        assert all(set(a["k"]).isdisjoint(b["k"]) for a, b in zip(units, units[1:]))
