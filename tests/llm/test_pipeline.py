import subprocess
import sys

import pytest

import corpus_pipeline
from tracetide.llm import decontam

from . import helpers as H

ROOT = corpus_pipeline.__file__.rsplit("/", 1)[0]


def stages():
    return dict(corpus_pipeline.STAGES)


def test_every_stage_against_brute_force(spark, tmp_path):
    rows = H.documents_fixture()
    bench = [(int(i), t) for i, t in H.table("benchmark").itertuples(index=False)]
    rows += [(60_000, "some words before " + bench[0][1] + " and after"), (60_001, "clean words of its own"), (10_003, "one")]
    passage = dict(rows)[2][:500]
    rows += [(60_002, "unlike the others 1 " + passage + " q"), (60_003, "nor these are alike 2 " + passage + " z")]
    rows += [(60_004, "first " + passage + "é one"), (60_005, "second " + passage + "ê two")]  # cut inside a character
    docs = H.frame(spark, rows)
    docs = docs.withColumn("lang", docs["source"])
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id >= 60")
    for c in docs.columns:
        if c not in train.columns:
            train = train.selectExpr("*", f"cast(null as string) as {c}")
    docs = docs.unionByName(train.select(docs.columns))
    sf = H.sf_dir(tmp_path, {"documents": docs, "benchmark": spark.createDataFrame(bench, "item_id bigint, text string")}, spark)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns = now.columns

    out = stages()["language ID"](spark, now, sf)
    assert out.columns == columns
    before, after = now.collect(), out.collect()
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r.text and any(c.isalpha() for c in r.text))

    now = spark.createDataFrame(after, now.schema)
    out = stages()["n-gram Jaccard join"](spark, now, sf)
    assert out.columns == columns
    after = out.collect()
    groups = H.jaccard_components([(r.doc_id, r.text) for r in now.collect()])
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in groups.items() if i == c)

    now = spark.createDataFrame(after, now.schema)
    out = stages()["suffix-array dedup"](spark, now, sf)
    assert out.columns == columns
    want = H.substring_dedup([(r.doc_id, r.text) for r in after], corpus_pipeline.REPEATED_BYTES)
    cut = out.collect()
    assert {r.doc_id: r.text for r in cut} == {i: k.decode("utf-8", "ignore") for i, (_, _, _, k) in want.items()}
    assert all(r.n_chars == len(r.text) for r in cut) and any(w[1] for w in want.values())

    now = spark.createDataFrame(cut, now.schema)
    out = stages()["benchmark decontamination"](spark, now, sf)
    assert out.columns == columns
    dirty = {r.doc_id for r in cut for _, t in bench if H.best_passage(H.squeeze(t), H.squeeze(r.text) or b" ") <= int(decontam.RATE * len(H.squeeze(t)))}
    kept = out.collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in cut if r.doc_id not in dirty) and 60_000 in dirty

    out = stages()["packing"](spark, spark.createDataFrame(kept, now.schema), sf)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in kept}
    whole = corpus_pipeline.run(spark, sf).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in whole} == {r[0]: r[1] for r in out.groupBy("doc_id").sum("length").collect()}


@pytest.mark.parametrize("name", ["language ID", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"])
def test_stages_take_an_empty_table_and_null_rows(spark, name):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, "a b", None, None, None)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert stages()[name](spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert stages()[name](spark, docs, "/root/testdata/sf0.001").where("doc_id = 1").select("doc_id").distinct().count() == (0 if name == "language ID" else 1)


def test_rows_without_an_id_are_judged(spark):
    passage = " ".join(f"passage{k}" for k in range(60))
    rows = [(None, "a copy of some length it is"), (5, "a copy of some length it is"), (4, "a copy of some length it is"), (None, "alone"), (None, "twice without an id here"),
            (None, "twice without an id here"), (None, f"one {passage} end " + " ".join(f"x{k}" for k in range(40))),
            (9, f"two {passage} and a longer end " + " ".join(f"y{k}" for k in range(40))), (None, None)]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(str((r.doc_id, r.text)) for r in stages()["n-gram Jaccard join"](spark, docs, "").collect())
    assert got == sorted(str(x) for x in [(4, rows[2][1]), (None, "alone"), (None, rows[4][1]), rows[6], rows[7], (None, None)])
    got = {(r.doc_id, r.text, r.n_chars) for r in stages()["suffix-array dedup"](spark, docs.where("text like '%passage%'"), "").collect()}
    assert {(i, len(t), n) for i, t, n in got} == {(None, len(t), len(t)) for i, t, _ in got if i is None} | {(9, len(t), len(t)) for i, t, _ in got if i == 9}
    assert len(got) == 2 and all("passage30" not in t and (t.startswith("on") or t.startswith("tw")) for _, t, _ in got)


def test_decontamination_judges_rows_without_an_id(spark, tmp_path):
    item = " ".join(f"benchmark{k} word" for k in range(20))
    sf = H.sf_dir(tmp_path, {"benchmark": spark.createDataFrame([(1, item)], "item_id bigint, text string")}, spark)
    rows = [(None, f"before {item} after"), (None, "a clean text without an id"), (1, item), (2, "a clean text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = stages()["benchmark decontamination"](spark, docs, sf).collect()
    assert sorted(r.text for r in got) == ["a clean text", "a clean text without an id"]


def test_entry_works_without_the_corpus_operators(tmp_path):
    code = ("import sys\nclass No:\n def find_spec(self, n, *a):\n  if n.startswith(('corpus_pipeline', 'tracetide.llm')): raise ModuleNotFoundError(n)\n"
            "sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14))
