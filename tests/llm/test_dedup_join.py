import random
import tracemalloc

import numpy as np
import pytest

from tracetide.llm import common, decontam, jaccard_join, queries, suffix_dedup

from . import helpers as H


def test_words_and_shingles_match_plain_code():
    texts = ["A b\tC  d\x0be", "", " ", "é É x", "one two three four five six one two three four five six", "a" * 200 + " b" * 70, "x"]
    data = "".join(texts).encode()
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    low, s, e, doc = common.words_of(np.frombuffer(data, np.uint8), off)
    got = [[] for _ in texts]
    for a, b, d in zip(s, e, doc, strict=True):
        got[d].append(bytes(low[a:b]))
    assert got == [H.words(t) for t in texts]
    wh = common.word_hashes(low, s, e)
    assert len(set(wh.tolist())) == len({w for t in texts for w in H.words(t)})
    h, d = common.distinct_by_doc(*common.shingles_of(wh, doc, len(texts)))
    assert np.bincount(d, minlength=len(texts)).tolist() == [len(H.shingle_set(t)) for t in texts]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 199), (200, 199)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[200] == got[199] == 199
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def near_copies(base, n, rng):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("leaf", [16, 4])
def test_jaccard_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rng = random.Random(leaf)
    rows = H.documents_fixture()
    text = dict(rows)
    rows += [(20_000 + k, t) for k, t in enumerate(near_copies(text[0], 40, rng))]
    passage = " ".join(f"p{k}" for k in range(30))  # a passage that many different documents share
    rows += [(30_000 + k, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40)))) for k in range(60)]
    rng.shuffle(rows)
    got = jaccard_join.jaccard_components(H.frame(spark, rows).repartition(5)).toPandas()
    want = H.jaccard_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want and len(got) == len(rows)


def test_jaccard_edge_cases(spark):
    rows = [(7, "a b c"), (3, "A b C"), (9, "a b"), (3, "A b C"), (None, "a b c"), (None, "z"), (1, None), (2, " ")]
    got = sorted(jaccard_join.jaccard_components(H.frame(spark, rows)).collect(), key=str)
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == sorted(
        [(7, 1, 3), (3, 1, 3), (3, 1, 3), (9, 1, 9), (-1, 1, 3), (-1, 1, -1), (1, 0, 1), (2, 0, 2)])
    assert jaccard_join.jaccard_components(H.frame(spark, [])).count() == 0


def test_signature_tree_gives_every_pair_that_can_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = []
    for k in range(90):
        keep = rng.random(300) < rng.uniform(0.6, 1)
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 60, rng.integers(0, 200)).astype(np.uint64)])))
    sets.sort(key=len)
    n, comp = np.array([len(s) for s in sets]), np.arange(90) % 30
    bits = np.frombuffer(b"".join(jaccard_join._sketches(np.concatenate(sets), n)), np.uint8).reshape(90, -1).view(np.uint64)
    order = np.lexsort((n, comp))
    got = {tuple(sorted((order[a], order[b]))) for i, j in jaccard_join.SignatureTree(n[order], comp[order], bits[order]).pairs() for a, b in zip(i, j, strict=True)}
    for a in range(90):
        for b in range(a + 1, 90):
            common_n = len(np.intersect1d(sets[a], sets[b]))
            if comp[a] != comp[b] and 100 * common_n >= 75 * (n[a] + n[b] - common_n):
                assert (a, b) in got


def test_signature_tree_of_unlike_components_has_no_pairs():
    rng = np.random.default_rng(2)
    one, two = (rng.integers(0, 1 << 60, 300).astype(np.uint64) for _ in range(2))
    for m in (64, 128, 256):
        sets = [np.sort(one)] * m + [np.sort(two)] * 10
        n, comp = np.full(m + 10, 300), np.repeat([0, 1], [m, 10])
        bits = np.frombuffer(b"".join(jaccard_join._sketches(np.concatenate(sets), n)), np.uint8).reshape(m + 10, -1).view(np.uint64)
        assert not list(jaccard_join.SignatureTree(n, comp, bits).pairs())


def test_large_token_groups_are_cut_into_bounded_units(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "LEAST_TOKENS", 2)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)  # the passage stays in the prefixes
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(24))
    tails = [[f"q{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60))] for _ in range(60)]
    rows = [(k, " ".join([passage, *t])) for k, t in enumerate(tails)]
    # linked beyond the chain: one word of the tail is another one
    rows += [(100 + k, " ".join([passage, *t[:-3], f"z{k}", *t[-2:]])) for k, t in enumerate(tails[:30])]
    rng.shuffle(rows)
    units, plain = [], jaccard_join.tree_candidates

    def spy(found):
        units.extend(found.groupBy("kind", "x", "y").count().collect())
        return plain(found)

    monkeypatch.setattr(jaccard_join, "tree_candidates", spy)
    got = jaccard_join.jaccard_components(H.frame(spark, rows).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == H.jaccard_components(rows) and len(got) == len(rows)
    assert sum(u.kind == 1 for u in units) > 10 and all(u["count"] <= (16 if u.kind else 8) for u in units)


@pytest.mark.parametrize("sizes", [(90, 90), (90, 3), (70, 20)])
def test_pairs_of_two_signature_trees(sizes):
    rng = np.random.default_rng(sizes[1])
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    trees, sets = [], []
    for m in sizes:
        own = sorted((np.unique(base[rng.random(200) < rng.uniform(0.7, 1)]) for _ in range(m)), key=len)
        n, comp = np.array([len(x) for x in own]), np.sort(rng.integers(0, 20, m))
        bits = np.frombuffer(b"".join(jaccard_join._sketches(np.concatenate(own), n)), np.uint8).reshape(m, -1).view(np.uint64)
        trees.append(jaccard_join.SignatureTree(n, comp, bits))
        sets.append((own, comp))
    got = [p for i, j in trees[0].pairs(trees[1]) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got))
    for a, x in enumerate(sets[0][0]):
        for b, y in enumerate(sets[1][0]):
            common_n = len(np.intersect1d(x, y))
            if sets[0][1][a] != sets[1][1][b] and 100 * common_n >= 75 * (len(x) + len(y) - common_n):
                assert (a, b) in got


@pytest.mark.parametrize(("length", "gram", "max_group"), [(400, 200, 4096), (40, 16, 4096), (40, 16, 1), (12, 4, 3)])
def test_substrings_against_brute_force(spark, length, gram, max_group):
    rng = random.Random(length + max_group)
    rows = H.documents_fixture()
    text = dict(rows)
    rows += [(20_000 + k, t) for k, t in enumerate(near_copies(text[1], 12, rng))]
    rows += [(21_000 + k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for k in range(40)]
    passage = text[2][:length + 7]
    rows += [(22_000 + k, f"{rng.random()} {passage}{rng.random()}") for k in range(20)]
    got = suffix_dedup.deduplicate(H.frame(spark, rows).repartition(4), length=length, gram=gram, max_group=max_group, keep=("n_chars", "n")).collect()
    want = H.substring_dedup(rows, length)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) == want[r.doc_id]


def test_substrings_edge_cases(spark):
    x = "0123456789" * 50
    got = suffix_dedup.deduplicate(H.frame(spark, [(1, "q" + "".join(map(chr, range(200, 700)))), (1, "q" + "".join(map(chr, range(200, 700)))), (None, x), (2, None)])).collect()
    by = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got)
    assert by == [(0, 500, 0), (1, 1001, 1001), (1, 1001, 1001), (2, 0, 0)]
    assert suffix_dedup.deduplicate(H.frame(spark, [])).count() == 0


@pytest.mark.parametrize("ids", [(None, 7, None, 8, 9), (7, 7, 8, 8, 9), (1, 2, 3, 4, 5)])
def test_substring_query_judges_rows_with_no_id_of_their_own(spark, tmp_path, ids):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdé") for _ in range(450))
    texts = [f"first {passage} end", f"a second and longer one {passage}", "0123456789" * 50, f"nothing in it {rng.random()}" * 40, None]
    sf = H.sf_dir(tmp_path, {"documents": H.frame(spark, list(zip(ids, texts, strict=True)))}, spark)
    got = queries.op7_suffix_dedup(spark, sf)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = H.substring_dedup(list(enumerate(texts)))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((i, n, cut, spans, H.sha(kept))) for i, (n, cut, spans, kept) in zip(ids, want.values(), strict=True))
    assert want[0][1] and want[1][1] and want[2][1]


def test_deep_shallow_sort_is_the_suffix_order():
    rng = random.Random(3)
    for _ in range(300):
        base = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60)))
        t = [base[:rng.randint(0, len(base))] + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 30))]
        o = suffix_dedup.deep_shallow_sort(t, 0, rng.choice([0, 8, 16, 32]))
        assert sorted(o) == list(range(len(t))) and [t[i] for i in o] == sorted(t)


def mutate(b, k, rng):
    b = bytearray(b)
    for _ in range(k):
        p, r = rng.randrange(len(b)), rng.random()
        if r < 0.34:
            b[p] = rng.choice(b"aeinorst ")
        elif r < 0.67:
            del b[p]
        else:
            b.insert(p, rng.choice(b"aeinorst "))
    return bytes(b)


def test_edit_search_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(2))
        d, end = decontam.edit_search(a, b)
        assert d == H.best_passage(a, b)
        assert H.best_passage(a, b[:end]) == d


def test_signatures_reach_the_target_recall():
    rng = random.Random(4)
    items = [t.encode() for t in H.table("benchmark").text]
    block = decontam.Block(list(range(len(items))), items, decontam.RATE)
    windows = [(i, mutate(t, int(block.edits[i]), rng)[:len(t)]) for i, t in enumerate(block.texts) for _ in range(10)]
    w, i = block.matches(windows)
    ok = set(zip(w.tolist(), i.tolist(), strict=True))
    assert np.mean([(k, windows[k][0]) in ok for k in range(len(windows))]) > 0.98


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    rows = H.documents_fixture()
    bench = [(int(i), t) for i, t in H.table("benchmark").itertuples(index=False)]
    bench += [(500, None), (501, ""), (502, " \n"), (503, "short one"), (504, "xyz"), (505, bench[0][1])]
    for k in range(30):
        i, t = bench[rng.randrange(20)]
        host = rows[rng.randrange(40)][1]
        at = rng.randrange(len(host))
        edited = mutate(t.encode(), rng.randint(0, int(0.13 * len(t))), rng).decode("utf-8", "ignore")
        rows.append((40_000 + k, host[:at] + " " + edited.replace(" ", "\n ", 2) + " " + host[at:]))
    rows += [(50_000, bench[1][1].upper()), (50_001, "a Short  ONE here"), (None, bench[2][1])]
    got = decontam.find_matches(H.frame(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string").selectExpr("*", "1 as t", "2 as i"), block_bytes=4000).collect()
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    assert len(found) == len(got)
    want = {}
    clean = [(i, decontam_text(t)) for i, t in bench]
    for d, t in rows:
        text = decontam_text(t)
        for i, item in clean:
            if item and text:
                dist = H.best_passage(item, text)
                if dist <= int(decontam.RATE * len(item) + 1e-9):
                    want[d, i] = dist
    assert found == want and len(want) > 25
    text = dict(rows)
    for r in got:  # the span holds the passage
        part = decontam_text((text[r.doc_id] or "").encode()[r.start:r.end].decode("utf-8", "ignore"))
        assert H.best_passage(dict(clean)[r.item_id], part) == r.distance or r.distance > 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.find_matches(H.frame(spark, rows), none).count() == 0
    assert decontam.find_matches(H.frame(spark, []), spark.createDataFrame(bench, "item_id bigint, text string")).count() == 0


def test_signatures_do_not_depend_on_the_texts_beside():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(n)) for n in (5000, 40, 300, 41, 2400, 90)]
    sizes = np.array([len(t) for t in texts])
    walks = decontam.Walks()
    together = walks.signatures(texts, sizes)
    for i, t in enumerate(texts):
        assert (walks.signatures([t], sizes[i:i + 1])[0] == together[i]).all()
    assert (decontam.random_u64(10, 5, 3) == decontam.random_u64(13, 5)[3:]).all()


def test_a_very_long_item(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    longer = " ".join(rng.choice(words) for _ in range(3200)).encode()
    tracemalloc.start()
    block = decontam.Block([1, 2], [longer, b"a short item of a few words"], decontam.RATE)
    block.matches([(0, longer)] * 20)
    assert len(longer) > 18_000 and tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    item = " ".join(rng.choice(words) for _ in range(800))
    other = " ".join(rng.choice(words) for _ in range(9000))
    edited = mutate(item.encode(), 150, rng).decode()
    rows = [(1, other), (2, other[:5000] + " " + edited + " " + other[5000:]), (3, item[:2500]), (4, "here is a short item of a few words again")]
    bench = spark.createDataFrame([(1, item), (2, "a short item of a few words")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find_matches(H.frame(spark, rows), bench).collect()}
    assert set(got) == {(2, 1), (4, 2)} and 100 < got[2, 1] <= 150 and got[4, 2] == 0


def decontam_text(t):
    data = np.frombuffer((t or "").encode(), np.uint8)
    low, _, _ = decontam.normalise(data, np.array([0, len(data)]))
    return bytes(low).strip(b" ")
