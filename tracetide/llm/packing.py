"""Packing of token streams into fixed windows by best-fit decreasing.

Every partition of the input packs its own documents, block by block, so the
tokens never cross the network: a block holds at most ``block_tokens`` tokens
(one longer document makes a block of its own).  In a block

1. documents longer than the window are cut into full windows first;
2. the remainders go, longest first, into the tightest open window.  Open
   windows are found in a segment tree indexed by remaining capacity;
3. windows that stay partly empty are topped up: the emptiest ones are cut and
   fill the gaps of the others, so that one partial window is left, which is
   cut at powers of two.

Nulls and ties: a null text counts as empty (its only token is the end id), a
null id is kept, repeated rows are packed as often as they occur, equal
lengths are taken in input order.  An empty table gives an empty result.
Further input columns are not read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import worker_cache

WINDOW = 1024
BLOCK_TOKENS = 1 << 21

# Split pattern and end-of-text string of the byte-level vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = "<|endoftext|>"

PIECE_SCHEMA = ("doc_id bigint, start bigint, length bigint, tokens binary, doc_tokens bigint, "
                "sequence_id bigint, offset bigint, sequence_tokens bigint")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("tokens", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("sequence_tokens", pa.int64())])


class Encoder:
    """Byte-level BPE of a ``tokenizers`` file, run by tiktoken's encoder.

    Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``; the
    tests compare both.  A text that the fast encoder refuses (very long runs
    of white space) is encoded by the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars, extra = {chr(b): b for b in printable}, 0
        for b in range(256):
            if b not in printable:
                chars[chr(256 + extra)] = b
                extra += 1
        ranks = {bytes(chars[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the encoder's panics are no Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    cache = worker_cache("packing")
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


class CapacityTree:
    """Segment tree over remaining capacities 0..size with the open windows of each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take the window of the smallest capacity >= need; (window, capacity) or None."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Items (all of length 1..window) by window, longest first, tightest fit."""
    tree, out = CapacityTree(window), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.tightest(n)
        if found is None:
            found = len(out), window
            out.append([])
        out[found[0]].append(i)
        if found[1] > n:
            tree.add(found[1] - n, found[0])
    return out


def top_up(windows: list[list[tuple[int, int, int]]], window: int) -> list[list[tuple[int, int, int]]]:
    """Cut the emptiest windows to fill the gaps of the others; the rest at powers of two.

    ``windows``: lists of (document, start, length).
    """
    fill = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda i: (-fill[i], i))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, donor = order[lo], order[hi]
        if fill[to] == window:
            lo += 1
        elif not windows[donor]:
            hi -= 1
        else:
            doc, start, n = windows[donor].pop()
            take = min(n, window - fill[to])
            windows[to].append((doc, start, take))
            if take < n:
                windows[donor].append((doc, start + take, n - take))
            fill[to] += take
            fill[donor] -= take
    out = [w for w, f in zip(windows, fill, strict=True) if f == window]
    for w, f in zip(windows, fill, strict=True):
        if 0 < f < window:
            rest = list(w)
            for bit in range(f.bit_length() - 1, -1, -1):
                if f >> bit & 1:
                    room, cut = 1 << bit, []
                    while room:
                        doc, start, n = rest.pop(0)
                        take = min(n, room)
                        cut.append((doc, start, take))
                        if take < n:
                            rest.insert(0, (doc, start + take, n - take))
                        room -= take
                    out.append(cut)
    return out


def plan_block(lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token once."""
    out, rest_doc, rest = [], [], []
    for d, n in enumerate(lengths.tolist()):
        full = n // window
        out += [[(d, k * window, window)] for k in range(full)]
        if n % window:
            rest_doc.append((d, full * window))
            rest.append(n % window)
    packed = best_fit_decreasing(np.array(rest, np.int64), window)
    return out + top_up([[(*rest_doc[i], rest[i]) for i in w] for w in packed], window)


def pack(docs: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW,
         end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: its token ids (unsigned little-endian 32 bit), sequence and offset."""

    def emit(block, first_sequence):
        ids = [b[0] for b in block]
        toks = [b[1] for b in block]
        lengths = np.array([len(t) for t in toks], np.int64)
        plan = plan_block(lengths, window)
        cols: list[list] = [[] for _ in range(8)]
        for s, seq in enumerate(plan):
            at, total = 0, sum(p[2] for p in seq)
            for d, start, n in seq:
                row = (ids[d], start, n, toks[d][start:start + n].tobytes(), int(lengths[d]), first_sequence + s, at, total)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                at += n
            if len(cols[0]) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)
                cols = [[] for _ in range(8)]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)
        return len(plan)

    def run(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        sequence = TaskContext.get().partitionId() << 33
        block, held = [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = t.as_py()
                tok = np.concatenate([enc(s).astype("<u4", copy=False), end]) if s else end
                if block and held + len(tok) > block_tokens:
                    sequence += yield from emit(block, sequence)
                    block, held = [], 0
                block.append((i, tok))
                held += len(tok)
        if block:
            yield from emit(block, sequence)

    src = docs.select(docs[doc_id].cast("bigint").alias("i"), docs[text].cast("string").alias("t"))
    return src.mapInArrow(run, PIECE_SCHEMA)
