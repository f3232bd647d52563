import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracetide.llm import chat, langid, packing, queries

from . import helpers as H

JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_pack_holds_every_token_once(spark):
    rows = H.documents_fixture() + [(None, "no id"), (10_003, "one")]
    got = packing.pack(H.frame(spark, rows), JSON).toPandas()
    own = Tokenizer.from_file(JSON)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*own.encode(t or "", add_special_tokens=False).ids, 0])
    seqs = got.sort_values(["sequence_id", "offset"])
    assert ((seqs.groupby("sequence_id").length.cumsum() - seqs.length) == seqs.offset).all()
    lengths = seqs.groupby("sequence_id").length.sum()
    assert lengths.max() <= 1024
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths)  # no padding at all
    got["ids"] = [np.frombuffer(b, "<u4").tolist() for b in got.tokens]
    assert (got.ids.map(len) == got.length).all()
    for i, docs in want.items():
        mine = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        if len(docs) == 1:
            mine = mine.sort_values("start")
            assert mine.start.tolist() == (mine.length.cumsum() - mine.length).tolist()
            assert sum(mine.ids, []) == docs[0]
            assert (mine.doc_tokens == len(docs[0])).all()
        else:
            assert mine.length.sum() == sum(map(len, docs))


def test_pack_empty_table(spark):
    out = packing.pack(H.frame(spark, []), JSON)
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "start", "length"]


def test_encoder_falls_back_on_hard_texts():
    enc, own = packing.Encoder(JSON), Tokenizer.from_file(JSON)
    for t in (" " * 300_000, "a" * 3000, "\n" * 9999 + "x", "<|endoftext|>a", "𝔘 é 漢字 \u0000  "):
        assert enc(t).tolist() == own.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_decreasing(lengths):
    got = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    gaps, want = [], []  # the plain algorithm
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [(g, k) for k, g in enumerate(gaps) if g >= lengths[i]]
        if fit:
            g = min(fit)[0]
            want.append(g - lengths[i])
            gaps[min(fit)[1]] -= lengths[i]
        else:
            gaps.append(64 - lengths[i])
    assert sorted(i for w in got for i in w) == list(range(len(lengths)))
    assert sorted(64 - sum(lengths[i] for i in w) for w in got) == sorted(gaps)


def test_language_accuracy_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op3_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == docs.count() and (held.lang == held.lang_pred).mean() > 0.98
    model = langid.fit(docs)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the and of with that" * 2000), (5, "ñ"), (None, "der die und nicht ein")]
    got = {r.doc_id: r for r in langid.identify(H.frame(spark, rows), model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3))
    assert got[4].lang_pred == "en" and got[None].lang_pred == "de" and 0 <= got[5].score <= 1
    empty = H.frame(spark, [])
    none = langid.fit(empty, lang="lang")
    assert langid.identify(empty, none).count() == 0
    assert langid.identify(H.frame(spark, rows), none).where("lang_pred <> 'und'").count() == 0


def test_language_posterior_matches_plain_counts(spark):
    """Scores of a small model against a plain multinomial naive Bayes."""
    docs = spark.createDataFrame([(1, "aba ab", "x"), (2, "bcb", "y"), (3, "abab", "x"), (4, None, "y"), (5, "zz", None)], "doc_id int, text string, lang string")
    m = langid.fit(docs)
    texts = ["ab", "bc b", "Ab, c"]
    best, post = langid.score_texts(texts, m)
    for t, b, p in zip(texts, best, post, strict=True):
        total = m.log_prior.copy()
        for _, _, sym, s, e, _ in langid._streams([t]):
            for g in langid._grams(sym):
                for k in range(int(s[0]), int(e[0])):
                    total = total + m.log_prob[g[k]]
        z = np.exp(total - total.max())
        assert b == total.argmax() and p == pytest.approx((z / z.sum()).max(), rel=1e-5)


TEXT = st.lists(st.sampled_from([*"ab\\|<>\n\r é😀n", "<|im_end|>", "<|im_start|>", "<|", "\\n", "<\\|"]), max_size=30).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), TEXT), TEXT), max_size=5))
def test_chat_round_trip(messages):
    out, spans = chat.render(messages)
    assert chat.read_back(out) == messages
    assert chat.masked_text(out, spans) == "".join(t for r, t in messages if r == "assistant")


def test_chat_folds_deltas_edits_and_regenerations(spark):
    ev = [(1, 0, "user", None, 10, 0, "open", ""), (1, 0, "user", None, 10, 1, "delta", "hel"), (1, 0, "user", None, 10, 2, "delta", "lo"),
          (1, 1, "assistant", None, 11, 0, "open", None), (1, 1, "assistant", None, 11, 1, "delta", "bad"), (1, 1, "assistant", None, 11, 2, "regenerate", None),
          (1, 1, "assistant", None, 11, 3, "delta", "good"), (1, 1, "assistant", None, 11, 4, "delta", "!"), (1, 2, "user", None, 12, 0, "open", None),
          (1, 2, "user", None, 12, 1, "delta", "typo"), (1, 2, "user", None, 12, 2, "edit", "fixed"), (1, 2, "user", None, 12, 3, "delta", "."),
          (1, 3, "user", None, 13, 0, "open", None), (1, 3, "user", None, 13, 1, "delete", None), (2, 0, "user", None, 14, 1, "delta", "late"),
          (2, 1, "user", None, 15, 1, "unknown", "x"), (None, 0, None, None, 16, 0, "open", None)]
    df = spark.createDataFrame(ev[::-1], "conv_id bigint, turn bigint, role string, tie string, message bigint, seq int, kind string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert chat.read_back(got[1].formatted) == [("user", "hello"), ("assistant", "good!"), ("user", "fixed.")]
    assert chat.read_back(got[2].formatted) == [("", "late")] and chat.read_back(got[None].formatted) == [("", "")]
    assert got[1].n_turns == 3 and chat.masked_text(got[1].formatted, got[1].loss) == "good!"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_splits_a_hot_conversation(spark, request):
    """A conversation that holds most rows is many segments, dealt to several tasks, that join up."""
    texts = [f"turn {i} " + "<|im_end|>\\ é😀" * (i % 40) for i in range(3000)]
    rows = [(7, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(None, 0, None, None)] + [(c, 0, "user", "") for c in range(100, 130)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = chat.format_segments(chat.events_of_turns(turns)).collect()
    own = sorted((r for r in got if r.conv_id == 7), key=lambda r: r.segment)
    assert [r.segment for r in own] == list(range(len(own))) and len(own) > 20
    assert max(len(r.formatted) for r in own) < 4 * chat.SEGMENT_CHARS
    whole, spans = chat.render([(role, t) for c, _, role, t in rows if c == 7])
    assert "".join(r.formatted for r in own) == whole and [(x.start, x.end) for r in own for x in r.loss] == spans
    assert all(whole[r.start:r.start + len(r.formatted)] == r.formatted for r in own) and sum(r.n_turns for r in own) == 3000
    assert sorted(r.conv_id for r in got if r.conv_id not in (7, None)) == list(range(100, 130))
    assert [chat.read_back(r.formatted) for r in got if r.conv_id is None] == [[("", "")]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few bytes would be put together again
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    messages = chat.final_messages(chat.events_of_turns(turns))
    held = messages.where("conv_id = 7").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert max(held) < 1000
    parts = chat._segments_of_tasks(messages).where("conv_id = 7").groupBy("part").count().collect()
    assert len(parts) > 3


def test_chat_query_against_brute_force(spark, tmp_path):
    rows = [(int(a), int(b), c, d) for a, b, c, d in H.table("conversations").itertuples(index=False)]
    rows += [(900, 1, "assistant", "x" * 100_000 + "<|im_end|>"), (900, None, None, None), (900, 1, "assistant", "tie"), (900, 1, "assistant", "tie"), (900, 1, "a", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as seq", "2 as kind", "3 as message")
    out = queries.op4_chat(spark, H.sf_dir(tmp_path, {"conversations": df}, spark)).toPandas().set_index("conv_id")
    said = "<|im_end|><|im_start|>assistant ok"
    by = {-1: [(0, "user", said), (1, "assistant", said)]}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(out.index) == set(by)
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        r, masked = out.loc[conv], "".join(t for _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == H.sha("".join(f"{role}\n{t}\n" for _, role, t in turns))
        assert r.loss_chars == len(masked) and r.loss_sha256 == H.sha(masked) and r.formatted_chars > len(masked)
