"""Brute-force versions of the corpus operators, for small fixtures."""

import collections
import hashlib
import os

import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def table(name, sf=SMALL):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def documents_fixture():
    """Documents with nulls, empty and long texts, copies and near copies, and clashing columns."""
    base = table("documents").head(60)
    rows = [(int(i), t) for i, t in zip(base.doc_id, base.text, strict=True)]
    long = " ".join(t for _, t in rows[:25])
    near = rows[3][1].split(" ")
    near[5] = "changed"
    extra = [None, "", "   \n\t ", "one", "one two three", "a b c d e", "A B C D E", long, long, rows[0][1], rows[1][1] + " x y z",
             " ".join(near), "x" * 3000, "ab" * 1500, "é" * 900, "!!! ??? 123 ...", "<|endoftext|> <|im_end|>", " " * 5000 + "end"]
    rows += [(10_000 + k, t) for k, t in enumerate(extra)]
    return rows


def frame(spark, rows, schema="doc_id bigint, text string"):
    """A documents table whose other columns clash with names the operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    for c in ("t", "n", "token", "key", "score", "word", "k", "y", "id", "v", "sketch", "lang"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit(None).cast("string"))
    return df.withColumn("n_chars", F.length(df.columns[1]).cast("bigint"))


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    if len(w) >= 5:
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def jaccard_components(rows):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {i: shingle_set(t) for i, t in rows}
    inv = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            inv[x].add(i)
    overlap = collections.Counter()
    for ids in inv.values():
        ids = sorted(ids)
        for a in range(len(ids)):
            for b in range(a):
                overlap[ids[b], ids[a]] += 1
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for (a, b), c in overlap.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            if x != y:
                head[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring_dedup(rows, length=400):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)}"""
    data = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[k:k + length] for _, b in data for k in range(len(b) - length + 1))
    out = {}
    for i, b in data:
        hit = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                hit[k:k + length] = True
        hit = hit[:len(b)]
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out[i] = len(b), int(hit.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~hit])
    return out


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def best_passage(item, text):
    """Least edit distance of ``item`` to any passage of ``text`` (plain dynamic program)."""
    prev = np.zeros(len(text) + 1, int)
    t = np.frombuffer(text, np.uint8)
    for c in item:
        cur = np.minimum(np.concatenate([[prev[0] + 1], prev[1:] + 1]), np.concatenate([[prev[0] + 1], prev[:-1] + (t != c)]))
        # insertions along the row: running minimum of cur[j] - j
        cur = np.minimum.accumulate(cur - np.arange(len(cur))) + np.arange(len(cur))
        prev = cur
    return int(prev.min())


def squeeze(text):
    return b" ".join(words(text))


def sf_dir(tmp_path, tables, spark):
    """A folder of parquet tables like the driver's."""
    for name, df in tables.items():
        df.write.parquet(os.path.join(str(tmp_path), f"{name}.parquet"))
    return str(tmp_path)
