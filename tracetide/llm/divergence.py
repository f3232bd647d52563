"""Source divergence audit by hash-consed segment trees over term ids.

Terms are runs of letters and non-ASCII characters, A-Z lowered.  A language
keeps the V terms that at least ``MIN_DOCS`` of its documents hold.  In every
(language, source) group a kept term of count c has the integer frequency
``p = 1 + floor(SCALE * (c + 2) / (N + 2 V))``, N being the group's occurrences
of kept terms; two groups differ by ``floor((p - q)^2 / (p + q))`` at a term.

1. Each task counts (language, source, term) of its whole texts; one shuffle by
   (language, term) sums them, counts the documents of each term and drops the
   terms that are too rare.
2. The kept terms of a language are dealt by a hash into blocks of about
   ``BLOCK`` term ids, and its sources into blocks of about ``SOURCES``.  A unit
   is one term block and one pair of source blocks, so neither a vocabulary nor
   a list of sources has to fit one task.
3. In a unit every group, and the language, is a segment tree over the block's
   term ids.  Equal subtrees of counts are one node, whichever group and place
   they come from.  Two trees are walked at the same time; a pair of nodes
   is priced once for each pair of denominators (N + 2 V), however often it occurs.
   For single terms the walk keeps the largest price below each node pair
   and goes down only where the group's best terms can be.
4. Prices of the units are summed; ranks are windows over one group's sources or
   its best terms of each block.

Defined results: null text, language and source are ''; rows are documents, so
repeated rows count repeatedly and doc_id is not read.  A language without kept
terms has V = 0: its pairs have value 0 and there are no term rows.  A source
alone in its language has no pair row.  Texts without terms still make their
group occur.  Very long texts and terms are read whole.  An empty table gives an
empty result; further columns are ignored.  All arithmetic is on integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_breaks, byte_chunks, stored, word_array

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
BLOCK = 4096  # kept terms of a unit, about
SOURCES = 64  # sources of a source block, about
PAIRS_AT_ONCE = 256  # group pairs walked together
_CHUNK = 4 << 20
_HELD_ROWS = 600_000  # counts that a task holds before it puts them out
LETTERS = byte_breaks((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, df) counted in each task; ``docs`` has lang, source, text."""
    names = ["lang", "source", "term", "c", "df"]

    def counted(lang, source, text):
        lang, source = lang.dictionary_encode(), source.dictionary_encode()
        n_source = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * n_source + source.indices.to_numpy()
        for i, j, data, off in byte_chunks(text, _CHUNK):
            words, doc = word_array(data, off, LETTERS)
            if not len(words):
                continue
            words = words.dictionary_encode()
            code, n_words = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            at, tf = np.unique(doc * n_words + code, return_counts=True)
            key = group[i:j][at // n_words] * n_words + at % n_words
            key, inv, df = np.unique(key, return_inverse=True, return_counts=True)
            c = np.bincount(inv, weights=tf, minlength=len(key)).astype(np.int64)
            of = key // n_words
            yield pa.table([lang.dictionary.take(pa.array(of // n_source)), source.dictionary.take(pa.array(of % n_source)),
                            words.dictionary.take(pa.array(key % n_words)), pa.array(c), pa.array(df.astype(np.int64))], names=names)

    def merged(tables):
        return pa.concat_tables(tables).group_by(names[:3]).aggregate([("c", "sum"), ("df", "sum")]).select([*names[:3], "c_sum", "df_sum"]).rename_columns(names)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for part in counted(*batch.columns):
                held.append(part)
                rows += part.num_rows
                if rows > _HELD_ROWS:
                    held = [merged(held)]
                    rows = held[0].num_rows
                if rows > _HELD_ROWS // 2 and len(held) == 1:  # mostly different: nothing to gain by holding them
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
        if held:
            yield from merged(held).to_batches(max_chunksize=50_000)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, c bigint, df bigint")


class Forest:
    """Hash-consed segment trees, one for each row of ``counts`` (rows x power of two; -1: no term).

    ``nodes[0]`` are the different counts; ``nodes[k]`` the (left, right) nodes
    of level k - 1; ``roots`` the top node of each row.
    """

    def __init__(self, counts: np.ndarray):
        values, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        self.nodes: list = [values]
        while ids.shape[1] > 1:
            n = len(self.nodes[-1]) if len(self.nodes) == 1 else len(self.nodes[-1][0])
            key, inv = np.unique(ids[:, ::2] * n + ids[:, 1::2], return_inverse=True)
            ids = inv.reshape(len(counts), -1)
            self.nodes.append((key // n, key % n))
        self.roots = ids[:, 0]

    def width(self, level: int) -> int:
        return len(self.nodes[0]) if level == 0 else len(self.nodes[level][0])


def frequency(c: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (c + 2) / total) without a product over 64 bits (three digits at a time)."""
    rest, out = c + 2, np.zeros(len(c), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


class Walk:
    """Simultaneous walk of many tree pairs; equal (denominators, node, node) are one entry.

    ``levels[k]`` holds, for the entries of level k, the places of their left and
    right child pairs among those of level k - 1; ``top`` the entry of each tree pair.
    """

    def __init__(self, forest: Forest, x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray):
        both, d = np.unique(np.stack([dx, dy], axis=1), axis=0, return_inverse=True)
        a, b, d = forest.roots[x], forest.roots[y], d.ravel()
        depth = len(forest.nodes) - 1

        def distinct(d, a, b, level):
            n = forest.width(level)
            key, inv = np.unique((d * n + a) * n + b, return_inverse=True)
            return key // (n * n), key // n % n, key % n, inv

        d, a, b, self.top = distinct(d, a, b, depth)
        self.levels: list = [None] * (depth + 1)
        for level in range(depth, 0, -1):
            left, right = forest.nodes[level]
            size = len(d)
            d, a, b, inv = distinct(np.concatenate([d, d]), np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]]), level - 1)
            self.levels[level] = inv[:size], inv[size:]
        self.c, self.e = forest.nodes[0][a], forest.nodes[0][b]
        self.p, self.q = frequency(np.maximum(self.c, 0), both[d, 0]), frequency(np.maximum(self.e, 0), both[d, 1])
        price = (self.p - self.q) ** 2 // (self.p + self.q)
        self.price = np.where(self.c < 0, 0, price)

    def up(self, leaves: np.ndarray, join) -> list:
        """Values of the entries of each level, from those of the leaves."""
        out = [leaves]
        for left, right in self.levels[1:]:
            out.append(join(out[-1][left], out[-1][right]))
        return out

    def sums(self) -> np.ndarray:
        return self.up(self.price, np.add)[-1][self.top]

    def best(self, most: int):
        """Yield (pair, term ids, values) of the ``most`` dearest terms, ties included, with c > 0 and p > q."""
        peak = self.up(np.where((self.c > 0) & (self.p > self.q), self.price, -1), np.maximum)
        for pair, entry in enumerate(self.top.tolist()):
            entries, ids = np.array([entry]), np.zeros(1, np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                value = peak[level][entries]
                least = 0 if len(value) < most else max(0, np.partition(value, -most)[-most])
                keep = value >= least  # each of the entries holds a term of its value
                entries, ids = entries[keep], ids[keep]
                if level:
                    left, right = self.levels[level]
                    entries, ids = np.concatenate([left[entries], right[entries]]), np.concatenate([2 * ids, 2 * ids + 1])
            yield pair, ids, peak[0][entries]


OUT = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def price_unit(unit: pa.Table) -> pa.Table:
    """Rows of OUT: the price of each source pair over the unit's terms, and each source's best terms in it."""
    head = unit.filter(pc.is_null(unit["term"]))
    rows = unit.filter(pc.is_valid(unit["term"]))
    lang, si, sj = (unit[c][0].as_py() for c in ("lang", "si", "sj"))
    sources, side = head["source"].to_pylist(), head["sb"].to_numpy()
    total = np.maximum(1, head["n"].to_numpy() + 2 * head["v"].to_numpy())
    total_lang = max(1, head["n_lang"][0].as_py() + 2 * head["v"][0].as_py())
    words = rows["term"].combine_chunks().dictionary_encode()
    code = words.indices.to_numpy()
    n_terms = len(words.dictionary)
    of_lang = np.zeros(n_terms, np.int64)
    of_lang[code] = rows["c_lang"].to_numpy()
    terms = words.dictionary.to_pylist()
    order = sorted(range(n_terms), key=lambda k: (-of_lang[k], terms[k].encode()))  # like counts beside each other
    place = np.empty(n_terms, np.int64)
    place[order] = np.arange(n_terms)
    width = 1 << max(0, n_terms - 1).bit_length()
    counts = np.zeros((len(sources) + 1, width), np.int64)
    counts[:, n_terms:] = -1
    row_of = {s: k for k, s in enumerate(sources)}
    own = np.array([row_of.get(s, -1) for s in rows["source"].to_pylist()], np.int64)  # -1: a term by itself, whoever holds it
    counts[own[own >= 0], place[code[own >= 0]]] = rows["c"].to_numpy()[own >= 0]
    counts[-1, place] = of_lang
    forest = Forest(counts)
    out = []

    def put(part, source, item, value):
        out.append(pa.table([pa.array([lang] * len(value), pa.string()), pa.array([part] * len(value), pa.string()), pa.array(source, pa.string()),
                             pa.array(item, pa.string()), pa.array(value, pa.int64())], schema=OUT))

    if si == sj:
        x, y = np.triu_indices(len(sources), 1)
    else:
        x, y = (g.ravel() for g in np.meshgrid(np.flatnonzero(side == si), np.flatnonzero(side == sj)))
    swap = total[x] > total[y]  # the price is symmetric
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    for s in range(0, len(x), PAIRS_AT_ONCE):
        i, j = x[s:s + PAIRS_AT_ONCE], y[s:s + PAIRS_AT_ONCE]
        put("pair", [sources[k] for k in i], [sources[k] for k in j], Walk(forest, i, j, total[i], total[j]).sums())
    if si == sj:
        for s in range(0, len(sources), PAIRS_AT_ONCE):
            i = np.arange(s, min(s + PAIRS_AT_ONCE, len(sources)))
            walk = Walk(forest, i, np.full(len(i), len(sources)), total[i], np.full(len(i), total_lang))
            for k, ids, value in walk.best(TOP_TERMS):
                best = sorted(((v, terms[order[t]]) for v, t in zip(value.tolist(), ids.tolist(), strict=True)), key=lambda b: (-b[0], b[1].encode()))[:TOP_TERMS]
                put("term", [sources[s + k]] * len(best), [t for _, t in best], [v for v, _ in best])
    return pa.concat_tables(out) if out else OUT.empty_table()


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: see the module's text."""
    named = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]
    src = docs.select(*named, docs[text].cast("string").alias("text"))

    # the counts of a task are summed by (lang, term): the documents of a term are counted without another shuffle
    counts = term_counts(src).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"df_lang": F.sum("df").over(of_term), "c_lang": F.sum("c").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    kept = stored(counts.where(F.col("df_lang") >= MIN_DOCS).select("lang", "source", "term", "c", "c_lang", "first"))

    langs = kept.groupBy("lang").agg(F.sum("c").alias("n_lang"), F.sum(F.col("first").cast("bigint")).alias("v"))
    n_of = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = src.select("lang", "source").distinct()
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(langs, "lang", "left").na.fill(0, ["n_lang", "v"])
    blocks = [F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK)).alias("n_blocks"), F.ceil(F.col("n_sources") / SOURCES).alias("n_sb")]
    sizes = stored(sizes.select("lang", "n_lang", "v", *blocks))
    facts = groups.join(n_of, ["lang", "source"], "left").na.fill(0, ["n"]).join(sizes, "lang")
    facts = stored(facts.withColumn("sb", F.pmod(F.xxhash64("source"), F.col("n_sb"))))

    block, empty = F.pmod(F.xxhash64("term"), F.col("n_blocks")), [F.lit(None).cast("bigint").alias(c) for c in ("n", "n_lang", "v")]
    rows = kept.join(facts.select("lang", "source", "n_blocks", "n_sb", "sb"), ["lang", "source"])
    rows = rows.select("lang", block.alias("blk"), "sb", "n_sb", "source", "term", "c", "c_lang", *empty)
    heads = facts.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("blk"), "sb", "n_sb", "source",
                         F.lit(None).cast("string").alias("term"), *[F.lit(None).cast("bigint").alias(c) for c in ("c", "c_lang")], "n", "n_lang", "v")
    # a unit needs all terms of its block, as those that none of its sources holds have a price, too
    of_sb = F.sequence(F.lit(0).cast("bigint"), F.col("n_sb") - 1)
    alone = kept.where("first").join(sizes.select("lang", "n_blocks", "n_sb"), "lang").withColumn("sb", F.explode(of_sb))
    alone = alone.select("lang", block.alias("blk"), "sb", "n_sb", F.lit(None).cast("string").alias("source"), "term", F.lit(0).cast("bigint").alias("c"), "c_lang", *empty)
    units = rows.unionByName(heads).unionByName(alone).withColumn("other", F.explode(of_sb)).drop("n_sb")
    units = units.withColumns({"si": F.least("sb", "other"), "sj": F.greatest("sb", "other")}).where("source is not null or sb <= other").drop("other")
    found = stored(units.groupBy("lang", "blk", "si", "sj").applyInArrow(price_unit, "lang string, part string, source string, item string, value bigint"))

    pairs = found.where("part = 'pair'").groupBy("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms)
