"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters counts as one space,
and the 1- to 4-grams of that stream are hashed into ``BUCKETS`` buckets.  The
log-probability matrix (buckets x languages) has a fixed size and is broadcast;
whole texts are scored in numpy batches.

Defined results: null text, empty text and text without a letter are ``und``
with score 0; so is every text if nothing was learned.  Repeated rows count as
often as they occur.  Equal posteriors go to the alphabetically first language.
Labels that are null take no part in learning.  An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast, byte_chunks, worker_cache

BUCKETS = 1 << 16
ORDERS = 4
ALPHA = 0.1
TRAIN_ROWS = 20_000  # documented bound of the labelled sample
UNDETERMINED = "und"
_CHUNK_CHARS = 1 << 18
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    log_prob: np.ndarray  # (BUCKETS, languages) float32
    log_prior: np.ndarray


def _tables():
    cache = worker_cache("langid")
    if "letters" in cache:
        return cache["letters"]
    letters = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isalpha():
            letters[cp] = True
            low = c.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
    cache["letters"] = letters, lower
    return letters, lower


def _streams(texts: list):
    """Yield (first, last + 1, symbols, starts, ends, has letter) of bounded chunks.

    Every document is followed by ORDERS spaces, so that no n-gram of one
    document reaches into the next.
    """
    letters, lower = _tables()
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= _CHUNK_CHARS):
            size += len(texts[j] or "")
            j += 1
        part = [t or "" for t in texts[i:j]]
        cp = np.frombuffer((" " * ORDERS).join(part).encode("utf-32-le", "surrogatepass") + (" " * ORDERS).encode("utf-32-le"), np.uint32)
        n = np.array([len(t) for t in part], np.int64)
        start = np.cumsum(n + ORDERS) - n - ORDERS
        is_letter = letters[cp]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        doc_end = start + n
        for k in range(ORDERS):  # the pads stay
            keep[doc_end + k] = True
        count = np.concatenate([[0], np.cumsum(keep)])
        sym = np.where(is_letter, lower[cp], np.uint32(32))[keep]
        lcount = np.concatenate([[0], np.cumsum(is_letter)])
        yield i, j, sym, count[start], count[doc_end], lcount[doc_end] > lcount[start]
        i = j


def _grams(sym: np.ndarray):
    """Bucket of each 1- to 4-gram that starts at each symbol but the last ORDERS."""
    m = len(sym) - ORDERS
    h = np.zeros(m, np.uint32)
    for k in range(ORDERS):
        h = h + sym[k:k + m] * _MULT[k]
        x = h ^ (h >> np.uint32(15))
        x = (x + np.uint32(k)) * np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        yield ((x * np.uint32(0x297A2D39)) >> np.uint32(16)).astype(np.int64)


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id",
        train_rows: int = TRAIN_ROWS, alpha: float = ALPHA) -> Model:
    """Learn from a sample of about ``train_rows`` labelled rows, chosen by a hash of ``key``.

    All rows are used if there are no more.  The counts are summed by Spark;
    the driver gets one number for each bucket and language.
    """
    rows = labelled.select(labelled[text].alias("t"), labelled[lang].cast("string").alias("l"), labelled[key].alias("k"))
    rows = rows.where("l is not null and t is not null")
    total = rows.count()
    if total > train_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(17), "k"), F.lit(1_000_000)) < int(1e6 * train_rows / total))

    schema = pa.schema([("l", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            names, code = np.unique(langs.astype(str), return_inverse=True) if len(langs) else ([], None)
            sums = np.zeros((len(names), BUCKETS + 1), np.int64)
            for k in range(len(names)):
                sums[k, BUCKETS] = int((code == k).sum())
            parts = ((a, s) for a, b, _, _ in byte_chunks(batch.column(0)) for s in _streams(batch.column(0).slice(a, b - a).to_pylist()))
            for first, (i, _, sym, start, end, _) in parts:
                lang_of = np.repeat(code[first + i:first + i + len(start)], end - start)
                at = np.concatenate([np.arange(s, e) for s, e in zip(start, end, strict=True)]) if len(start) else np.empty(0, int)
                for b in _grams(sym):
                    sums[:, :BUCKETS] += np.bincount(lang_of * BUCKETS + b[at], minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for k, name in enumerate(names):
                hit = np.flatnonzero(sums[k])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(sums[k][hit], pa.int64())], schema=schema)

    got = rows.select("t", "l").mapInArrow(count, "l string, bucket int, n bigint").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(got["l"].unique()))
    counts = np.zeros((BUCKETS + 1, len(langs)))
    for k, name in enumerate(langs):
        own = got[got["l"] == name]
        counts[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    docs, counts = counts[BUCKETS], counts[:BUCKETS]
    smooth = counts + alpha
    log_prob = np.log(smooth) - np.log(smooth.sum(axis=0)) if langs else smooth
    return Model(langs, log_prob.astype(np.float32), np.log((docs + 1) / (docs + 1).sum()) if langs else docs)


def score_texts(texts: list, model: Model):
    """(language index or -1, posterior) of each text."""
    best, post = np.full(len(texts), -1), np.zeros(len(texts))
    if not model.langs:
        return best, post
    for i, j, sym, start, end, has in _streams(texts):
        total = np.tile(model.log_prior, (j - i, 1))
        some = end > start
        if some.any():
            cuts = np.stack([start[some], end[some]], axis=1).ravel()
            for b in _grams(sym):
                b = np.append(b, 0)  # so that the last end is a valid cut
                total[some] += np.add.reduceat(model.log_prob[b], cuts, axis=0, dtype=np.float64)[::2]
        top = total.argmax(axis=1)
        z = np.exp(total - total.max(axis=1, keepdims=True))
        p = z.max(axis=1) / z.sum(axis=1)
        best[i:j] = np.where(has, top, -1)
        post[i:j] = np.where(has, p, 0.0)
    return best, post


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns plus the language and its posterior; the whole text of each row is scored."""
    shared = broadcast(docs.sparkSession, model)
    at = keep.index(text) if text in keep else len(keep)  # a text that is kept is sent once
    src = docs.select(*[docs[c] for c in keep], *([docs[text].cast("string").alias("__text")] if at == len(keep) else []))
    kept = src.schema.fields[:len(keep)]

    def run(batches):
        m = shared()
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            for i, j, _, _ in byte_chunks(texts):  # few texts at a time as Python strings
                best, post = score_texts(texts.slice(i, j - i).to_pylist(), m)
                pred = [m.langs[b] if b >= 0 else UNDETERMINED for b in best.tolist()]
                own = [c.slice(i, j - i) for c in batch.columns[:len(keep)]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(post, pa.float64())], names=[*keep, *names])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return src.mapInArrow(run, f"{out}, {names[0]} string, {names[1]} double")
