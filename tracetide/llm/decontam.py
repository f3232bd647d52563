"""Benchmark decontamination by edit distance: CGK embedding and bit-sampling LSH.

A document is contaminated by an item of n bytes if some passage of it is
within ``floor(rate * n)`` edits of the item; both are compared with A-Z
lowered and white space runs as one space.

1. Windows.  Item-sized windows are laid where they can matter: k edits leave
   at least ``n - g + 1 - k g`` of an item's g-byte grams whole, on diagonals at
   most k apart, so a window with fewer common grams cannot be a match.  This
   sieve loses nothing.
2. CGK.  Every window and item is embedded by random walks: the walk copies the
   byte it stands on and moves on or stays by a random bit of (step, byte).  Few
   edits become few differing places of the embedding.
3. LSH.  Signatures of ``BITS`` sampled places, ``REPEATS`` for each of
   ``WALKS`` walks, are looked up in the table of the items' signatures.  The
   numbers are set for a recall above 0.99 at the full edit rate (tested).
4. Candidates are verified by the exact edit distance (bit-parallel).

The items are a bounded broadcast: they are taken in blocks of about
``BLOCK_BYTES`` (an item counts ``ITEM_BYTES`` more than its length, for its
signatures), each block in a pass of its own over the documents, which are never
shuffled.  A Python process builds a block's structures once.  Walks are made for
texts of like size, ``CELLS`` bytes of them at a time, and their random bits in
pieces, so a long item takes memory in proportion to its length.

Defined results: null or empty texts and items (also those of white space)
match nothing; equal items match alike; repeated rows match alike; a null id is
kept; the match of a document and an item is the one of least distance, then
the leftmost; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, broadcast, byte_chunks, random_u64, splitmix, worker_cache

RATE = 0.1
WALKS, REPEATS, BITS = 8, 48, 5
SPAN = 2  # steps of a walk for each byte of the item; about then the text is used up
SAMPLED = 1.7  # places for each byte that are sampled: later ones are mostly past the end
BLOCK_BYTES = 8 << 20
ITEM_BYTES = 256
CELLS = 4 << 20
STEPS = 4096  # steps of which the random bits are made at once
_FLUSH, _FLUSH_BYTES = 2048, 32 << 20
_BITMAP = 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def normalise(data: np.ndarray, off: np.ndarray):
    """(bytes, offsets, original place of each byte) with white space runs as one space."""
    low = _LOWER[data]
    space = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    edge = off[1:-1]
    keep[edge[edge < len(low)]] = True
    place = np.flatnonzero(keep)
    return low[keep], np.searchsorted(place, off), place


def _grams(b: np.ndarray, g: int) -> np.ndarray:
    """Each g bytes (1 to 8) as one number."""
    x, have = b.astype(U64), 1
    out, done = None, 0
    while True:
        if g & have:
            m = len(b) - g + 1
            part = x[done:done + m] << U64(8 * done)
            out = part if out is None else out | part
            done += have
        have *= 2
        if have > g:
            return out
        x = x[:-(have // 2)] | (x[have // 2:] << U64(4 * have))


def edits_allowed(n: int, rate: float) -> int:
    return int(rate * n + 1e-9)


def gram_size(n: int, k: int) -> int:
    """Largest gram of at most 8 bytes of which k edits leave at least one whole."""
    g = 8
    while g > 1 and n - g + 1 - k * g < 1:
        g -= 1
    return g


def edit_search(item: bytes, text: bytes) -> tuple[int, int]:
    """(distance, end) of the best passage of ``text``: bit-parallel columns; leftmost end of ties."""
    n = len(item)
    eq: dict[int, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, dist, best, end = full, 0, n, n, 0
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            dist += 1
        elif mh & top:
            dist -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if dist < best:
            best, end = dist, j + 1
    return best, end


class Walks:
    """Random bits and sampled places, fixed by seeds."""

    def __init__(self):
        self.first = [self._make(w, 0) for w in range(WALKS)]
        self.place = (random_u64(WALKS * REPEATS * BITS, 77) >> U64(11)).astype(np.float64).reshape(WALKS, REPEATS, BITS) / float(1 << 53)
        self.mix = random_u64(WALKS * REPEATS, 99).reshape(WALKS, REPEATS)

    @staticmethod
    def _make(w: int, piece: int) -> np.ndarray:
        return (random_u64(STEPS * 257, 1000 + w, piece * STEPS * 257) >> U64(40) & U64(1)).astype(np.uint8).reshape(STEPS, 257)

    def bits(self, w: int, piece: int) -> np.ndarray:
        """(STEPS, 257): move on or stay, for the steps of a piece and each byte."""
        return self._make(w, piece) if piece else self.first[w]

    def signatures(self, texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """(texts, WALKS * REPEATS) signatures; the embedding of a text for items of n bytes has SPAN * n places."""
        out = np.empty((len(texts), WALKS * REPEATS), U64)
        order = np.argsort(-sizes, kind="stable")
        s = 0
        while s < len(order):
            longest = int(sizes[order[s]])
            like = int(np.searchsorted(-sizes[order], -(longest // 2), "right"))
            part = order[s:max(s + 1, min(like, s + CELLS // (longest + 1)))]
            out[part] = self._like([texts[i] for i in part], sizes[part])
            s += len(part)
        return out

    def _like(self, texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
        m, width = len(texts), max(map(len, texts)) + 1
        raw = np.full((m, width), 256, np.uint16)
        for i, t in enumerate(texts):
            raw[i, :len(t)] = np.frombuffer(t, np.uint8)
        flat, base, last = raw.ravel(), np.arange(m) * width, width - 1
        steps = SPAN * int(sizes.max())
        out = np.empty((m, WALKS * REPEATS), U64)
        rows = np.arange(m)[:, None]
        walk = np.empty((steps, m), np.uint16)
        for w in range(WALKS):
            at = np.zeros(m, np.int64)
            for j in range(steps):
                if j % STEPS == 0:
                    bits = self.bits(w, j // STEPS)
                c = flat[base + at]
                walk[j] = c
                at += bits[j % STEPS][c]
                np.minimum(at, last, out=at)
            for r in range(REPEATS):
                where = (self.place[w, r][None, :] * (SAMPLED * sizes)[:, None]).astype(np.int64)
                got = walk[where, rows].astype(U64)
                key = sizes.astype(U64) * U64(0x9E3779B97F4A7C15) + self.mix[w, r]
                for b in range(BITS):
                    key = splitmix(key + got[:, b] + U64(b << 9))
                out[:, w * REPEATS + r] = key
        return out


class Block:
    """Search structures of one block of items."""

    def __init__(self, ids: list, texts: list[bytes], rate: float):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        off = np.cumsum([0] + [len(t) for t in texts])
        data, off, _ = normalise(raw, off)
        clean = [bytes(data[off[i]:off[i + 1]]).strip(b" ") for i in range(len(texts))]
        keep = [i for i, t in enumerate(clean) if t]
        self.ids, self.texts = [ids[i] for i in keep], [clean[i] for i in keep]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([edits_allowed(len(t), rate) for t in self.texts], np.int64)
        gram = np.array([gram_size(n, k) for n, k in zip(self.size, self.edits, strict=True)], np.int64)
        self.need = self.size - gram + 1 - self.edits * gram
        self.tables = []
        for g in sorted(set(gram.tolist())):
            val, item, at = [], [], []
            for i in np.flatnonzero(gram == g):
                v = _grams(np.frombuffer(self.texts[i], np.uint8), g)
                val.append(v)
                item.append(np.full(len(v), i))
                at.append(np.arange(len(v)))
            val, item, at = np.concatenate(val), np.concatenate(item), np.concatenate(at)
            order = np.argsort(val, kind="stable")
            val, item, at = val[order], item[order], at[order]
            uniq, first = np.unique(val, return_index=True)
            bitmap = np.zeros(1 << _BITMAP, bool)
            bitmap[self._slot(uniq)] = True
            self.tables.append((g, uniq, np.append(first, len(val)), item, at, bitmap))
        if self.texts:
            self.walks = Walks()
            sig = self.walks.signatures(self.texts, self.size)
            owner = np.repeat(np.arange(len(self.texts)), sig.shape[1])
            order = np.argsort(sig.ravel(), kind="stable")
            self.sig, self.owner = sig.ravel()[order], owner[order]

    @staticmethod
    def _slot(v: np.ndarray) -> np.ndarray:
        return ((v * U64(0x9E3779B97F4A7C15)) >> U64(64 - _BITMAP)).astype(np.int64)

    def windows(self, data: np.ndarray, off: np.ndarray):
        """(item, document, start) of windows that the sieve leaves; start may lie before the document."""
        out = []
        for g, uniq, first, item, at, bitmap in self.tables:
            if len(data) < g:
                continue
            v = _grams(data, g)
            hit = np.flatnonzero(bitmap[self._slot(v)])
            u = np.searchsorted(uniq, v[hit])
            u = np.minimum(u, len(uniq) - 1)
            ok = uniq[u] == v[hit]
            hit, u = hit[ok], u[ok]
            doc = np.searchsorted(off, hit, "right") - 1
            ok = hit + g <= off[doc + 1]
            hit, u, doc = hit[ok], u[ok], doc[ok]
            n = first[u + 1] - first[u]
            for s, e in self._slices(n):
                take = np.repeat(first[u[s:e]], n[s:e]) + np.arange(int(n[s:e].sum())) - np.repeat(np.cumsum(n[s:e]) - n[s:e], n[s:e])
                it, dc = item[take], np.repeat(doc[s:e], n[s:e])
                diag = np.repeat(hit[s:e], n[s:e]) - at[take]
                key = (it * len(off) + dc) * (len(data) + 2 * int(self.size.max()) + 2) + diag + int(self.size.max())
                key = np.sort(key, kind="stable")
                k = self.edits[key // (len(data) + 2 * int(self.size.max()) + 2) // len(off)]
                many = np.searchsorted(key, key + k, "right") - np.arange(len(key))
                need = self.need[key // (len(data) + 2 * int(self.size.max()) + 2) // len(off)]
                start = np.flatnonzero(many >= need)
                if not len(start):
                    continue
                # every diagonal within k of one that has enough
                reach = np.zeros(len(key) + 1, np.int64)
                np.add.at(reach, start, 1)
                np.add.at(reach, start + many[start], -1)
                got = np.unique(key[np.cumsum(reach[:-1]) > 0])
                span = len(data) + 2 * int(self.size.max()) + 2
                out.append(np.stack([got // span // len(off), got // span % len(off), got % span - int(self.size.max())], axis=1))
        return np.concatenate(out) if out else np.empty((0, 3), np.int64)

    def _slices(self, n: np.ndarray, most: int = 4_000_000):
        """Cut the hits (in text order) so that a slice has about ``most`` entries.

        Hits are at different bytes, so an overlap of four item sizes in hits
        holds every window of a border whole in one of its slices.
        """
        over = 4 * int(self.size.max())
        cum = np.concatenate([[0], np.cumsum(n)])
        s = 0
        while s < len(n):
            e = max(int(np.searchsorted(cum, cum[s] + most, "right")) - 1, s + 2 * over)
            yield s, min(e, len(n))
            if e >= len(n):
                return
            s = e - over

    def matches(self, windows: list):
        """(window, item) pairs with a common signature; windows: (item, text)."""
        sizes = self.size[[w[0] for w in windows]]
        sig = self.walks.signatures([w[1] for w in windows], sizes).ravel()
        lo, hi = np.searchsorted(self.sig, sig, "left"), np.searchsorted(self.sig, sig, "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        window = np.repeat(np.arange(len(sig)) // (WALKS * REPEATS), n)
        pair = np.unique(window * len(self.texts) + self.owner[at])
        return pair // len(self.texts), pair % len(self.texts)


MATCH_SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint, distance bigint"


def find_matches(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the text), distance of every contaminated document and item."""
    spark = docs.sparkSession
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("t"))
    bench = items.select(items[item_id].cast("bigint").alias("i"), items[item_text].cast("string").cast("binary").alias("t")).where("length(t) > 0")
    size = bench.agg(F.sum(F.length("t") + ITEM_BYTES)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    out = None
    for b in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b) if blocks > 1 else bench
        found = _pass(spark, src, part, rate)
        out = found if out is None else out.unionByName(found)
    return out


def _pass(spark, src: DataFrame, bench: DataFrame, rate: float) -> DataFrame:
    rows = bench.orderBy("i", "t").toArrow()  # a block of bounded size
    shared = broadcast(spark, (rows.column("i").to_pylist(), rows.column("t").to_pylist()))
    names = [c.split()[0] for c in MATCH_SCHEMA.split(", ")]
    owner = f"decontamination {uuid.uuid4().hex}"

    def run(batches):
        cache = worker_cache(owner)
        if "block" not in cache:
            cache["block"] = Block(*shared(), rate)
        block = cache["block"]
        if not block.texts:
            return
        held: list = []  # (item, window, row, region, places of the region's bytes)
        held_bytes = 0

        def close():
            best: dict = {}
            win, item = block.matches([(h[0], h[1]) for h in held])
            tried: set = set()
            for w, i in zip(win.tolist(), item.tolist(), strict=True):
                _, _, row, region, place = held[w]
                if (row, i, place[0]) in tried:
                    continue
                tried.add((row, i, place[0]))
                target, k = block.texts[i], int(block.edits[i])
                d, end = edit_search(target, region)
                if d > k:
                    continue
                back = edit_search(target[::-1], region[:end][::-1])[1]
                begin = max(0, end - back)
                got = (d, int(place[begin]) if begin < len(place) else int(place[-1]) + 1, int(place[end - 1]) + 1 if end else int(place[0]))
                key = (row, block.ids[i], i)
                if key not in best or got < best[key]:
                    best[key] = got
            held.clear()
            return best

        for batch in batches:
            found: dict = {}
            for i, _, raw, off0 in byte_chunks(batch.column(1)):
                data, off, where = normalise(raw, off0)
                for item, d, start in block.windows(data, off).tolist():
                    lo, hi = int(off[d]), int(off[d + 1])
                    n, k = int(block.size[item]), int(block.edits[item])
                    s, e = max(lo, start), min(hi, start + n)
                    a, z = max(lo, start - 2 * k - 1), min(hi, start + n + 2 * k + 1)
                    if e <= s:
                        continue
                    held.append((item, bytes(data[s:e]), i + d, bytes(data[a:z]), where[a:z] - int(off0[d])))
                    held_bytes += 10 * (z - a)  # the window, the region, and eight bytes for a place
                    if len(held) >= _FLUSH or held_bytes >= _FLUSH_BYTES:
                        _merge(found, close())
                        held_bytes = 0
            if held:
                _merge(found, close())
                held_bytes = 0
            keys = sorted(found, key=lambda x: (x[0], x[2]))
            ids = batch.column(0).take(pa.array([k[0] for k in keys], pa.int64()))
            cols = [[k[1] for k in keys], *([found[k][c] for k in keys] for c in (1, 2, 0))]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols)], names=names)

    def _merge(into, more):
        for k, v in more.items():
            if k not in into or v < into[k]:
                into[k] = v

    return src.mapInArrow(run, MATCH_SCHEMA)
