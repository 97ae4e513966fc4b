"""Language identification with interpolated Kneser-Ney character models.

Texts are read as lower-case letters; any run of other characters is one blank, and a mark stands
at both ends. A symbol is a 16-bit code unit of UTF-16: a letter above U+FFFF is two symbols (its
surrogates, which no other letter uses), so no two letters share a symbol, and none is a blank or a mark. Tasks count four-character grams per language over all learned documents, Spark sums
them, and the lower orders come from continuation counts (distinct left neighbours), as Kneser-Ney
smoothing wants. Each language's model is filled in for every gram that any language has, and kept
as sorted arrays of packed grams with one row of log-probabilities each; look-ups are binary
searches. Every gram and context is kept. What a task holds is a block of the model: the grams whose
two middle symbols lie in one range, with all that they back off to. A model of up to CELLS
log-probabilities is one block, scored in one scan; a larger one is cut into as many blocks as it
needs, each is broadcast, adds its grams' log-probabilities to every text and is dropped again (the
texts are then written once and scanned once a block). Grams of one middle pair stay together.

The prediction is the language with the lowest cross-entropy per character. ``score`` is the softmax
of the cross-entropies. ``accepted`` says if the cross-entropy is not above the language's limit: mean
plus ``SIGMAS`` standard deviations over the learned documents of that language.

Defined results: a null text or one without a letter is ``und`` with score 0, not accepted; no learned
document: everything is ``und``; null languages aren't learned; repeated rows are predicted one by
one; all columns of the input but the text stay.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm import text as X
from churnscope.llm.store import bounded_batches, scratch_path, written

ORDER = 4
#: log-probabilities and back-off weights (keys times languages) of a block of the model
CELLS = 1 << 22
SIGMAS = 4.0
SHARPNESS = 8.0
_BLANK, _MARK = 32, 10


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _packed(texts: list[str]):
    """Packed grams of several texts, the text of each, and each text's number of letters."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) + 2 for t in low], np.int64)  # with the marks
    doc, end = np.repeat(np.arange(len(texts)), size), np.cumsum(size)
    c = np.frombuffer("".join(f"\n{t}\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    letters = np.bincount(doc[letter], minlength=len(texts))
    c = np.where(letter, c, np.uint32(_BLANK))
    c[end - size] = c[end - 1] = _MARK
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != _BLANK) | (c[:-1] != _BLANK)
    c, doc = c[keep], doc[keep]
    pair = c > 0xFFFF
    if pair.any():
        at = np.repeat(np.arange(len(c)), 1 + pair)
        second = np.append(False, at[1:] == at[:-1])
        c, doc, pair = c[at], doc[at], pair[at]
        x = c - np.uint32(0x10000)  # of the pairs only
        c = np.where(pair, np.where(second, 0xDC00 + (x & 0x3FF), 0xD800 + (x >> 10)), c)
    c = c.astype(np.uint16)
    n = len(c) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    g = np.zeros(n, np.uint64)
    for j in range(ORDER):
        g = (g << np.uint64(16)) | c[j:j + n]
    whole = doc[:n] == doc[ORDER - 1:]
    return g[whole].view(np.int64), doc[:n][whole], letters


def _runs(rows: np.ndarray, texts: pa.Array):
    """Rows and their texts in runs of about CHUNK_BYTES."""
    size, at = 0, 0
    lens = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for i in range(len(rows)):
        size += lens[i]
        if size >= X.CHUNK_BYTES or i == len(rows) - 1:
            yield rows[at:i + 1], texts.slice(at, i + 1 - at).to_pylist()
            size, at = 0, i + 1


def _merge(parts):
    g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    u, inv = np.unique(g, return_inverse=True)
    return u, np.bincount(inv, n).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, g, c) of (lang, text) rows: counted within each task, then summed by Spark."""

    def count(batches):
        held: dict = {}
        for b in batches:
            lang, texts = b.column(0), b.column(1).cast(pa.large_string())
            for name in lang.unique().to_pylist():
                rows = np.flatnonzero(pc.equal(lang, name).to_numpy(zero_copy_only=False))
                for _, part in _runs(rows, texts.take(pa.array(rows))):
                    g = np.sort(_packed(part)[0])
                    if len(g):
                        cut = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
                        p = held.setdefault(name, [])
                        p.append((g[cut], np.diff(np.append(cut, len(g)))))
                        if len(p) > 8:
                            held[name] = [_merge(p)]
        for name, p in held.items():
            g, n = _merge(p)
            for i in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g[i:i + 100_000]), pa.string()), pa.array(g[i:i + 100_000]), pa.array(n[i:i + 100_000])], names=["lang", "g", "c"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _suffix(g, n: int):
    """The last n symbols of a packed gram."""
    return g.bitwiseAND(F.lit((1 << (16 * n)) - 1)) if isinstance(g, Column) else g & ((1 << (16 * n)) - 1)


def kneser_ney(counts: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """By order: (lang, g, c, p) of the grams and (lang, h, gamma) of their contexts (log back-off weights).
    Discounts, contexts and weights of all orders come from one pass over the orders' union."""
    c, levels = counts, {}
    for n in range(ORDER, 0, -1):
        levels[n] = written(c, f"grams{n}")
        if n > 1:
            c = levels[n].groupBy("lang", _suffix(F.col("g"), n - 1).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    grams = functools.reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("n"), "lang", "g", "c") for n, t in levels.items()])
    one, two = F.sum((F.col("c") == 1).cast("double")), F.sum((F.col("c") == 2).cast("double"))
    # one row an order and language
    d = grams.groupBy("n", "lang").agg(F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.coalesce(F.try_divide(one, one + 2 * two), F.lit(0.5)))).alias("d"))
    t = grams.withColumn("h", F.shiftrightunsigned("g", 16))
    ctx = (t.groupBy("n", "lang", "h").agg(F.sum("c").cast("double").alias("t"), F.count(F.lit(1)).alias("n1"))
           .join(F.broadcast(d), ["n", "lang"]).withColumn("rest", F.col("d") * F.col("n1") / F.col("t")))
    ctx = written(ctx, "contexts")
    own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("t")
    t = written(t.join(ctx, ["n", "lang", "h"]).select("n", "lang", "g", "c", own.alias("own"), "rest"), "weights")
    probs = {}
    for n in range(1, ORDER + 1):
        p = t.where(F.col("n") == n)
        if n == 1:
            p = p.withColumn("q", F.lit(1 / 65536.0))
        else:
            low = probs[n - 1].select("lang", F.col("g").alias("low"), F.col("p").alias("q"))
            p = p.withColumn("low", _suffix(F.col("g"), n - 1)).join(low, ["lang", "low"])
        probs[n] = written(p.select("lang", "g", "c", (F.col("own") + F.col("rest") * F.col("q")).alias("p")), f"kn{n}")
    gammas = {n: ctx.where(F.col("n") == n).select("lang", "h", F.log("rest").alias("gamma")) for n in probs}
    return probs, gammas


def _middles(n: int) -> tuple[Column, Column]:
    """First and last middle pair (third symbol, then second) of the four-symbol grams that need a key: a gram of
    order n, or for -n a context of that order."""
    third, second = [F.shiftrightunsigned("key", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in ((1, 2) if n > 0 else (0, 1))]
    if abs(n) == 1:
        return F.lit(0).cast("long"), F.lit((1 << 32) - 1).cast("long")
    low = third * 65536
    return (low, low + 65535) if abs(n) == 2 else (low + second, low + second)


def _middle(g: np.ndarray) -> np.ndarray:
    """Middle pairs of packed four-symbol grams."""
    return ((g >> 16) & 0xFFFF) << 16 | ((g >> 32) & 0xFFFF)


class Model:
    """The written tables by order (contexts by negative order), and the ranges of middle pairs of the blocks."""

    def __init__(self, langs: list[str], tables: dict[int, DataFrame], cells: int):
        self.langs, self.tables, self.ranges = langs, tables, [(0, 1 << 32)]
        keys = functools.reduce(DataFrame.unionByName, [t.select(F.xxhash64(F.lit(n), "key").alias("k")) for n, t in tables.items()])
        blocks = -(-keys.agg(F.approx_count_distinct("k", 0.02)).first()[0] * len(langs) // cells)
        if blocks > 1:
            # in the order of the pairs, so a block reads little more than its own rows
            for n, t in tables.items():
                low, high = _middles(n)
                self.tables[n] = written(t.withColumns({"low": low, "high": high}).repartitionByRange("low").sortWithinPartitions("low"), f"blocks{n}")
            cuts = self.tables[ORDER].agg(F.percentile_approx("low", [i / blocks for i in range(1, blocks)], max(10_000, 10 * blocks))).first()[0]
            cuts = sorted({0, *(cuts or [])})
            self.ranges = list(zip(cuts, [*cuts[1:], 1 << 32]))

    def block(self, i: int) -> "Block":
        lo, hi = self.ranges[i]
        number = {x: j for j, x in enumerate(self.langs)}

        def arrays(n: int):
            t = self.tables[n]
            if len(self.ranges) > 1:
                t = t.where((F.col("high") >= lo) & (F.col("low") < hi))
            a = t.select("key", "lang", "value").toArrow()
            lang = a.column("lang").combine_chunks().dictionary_encode()
            code = np.array([number[x] for x in lang.dictionary.to_pylist()], np.int64)
            return a.column("key").to_numpy(), code[lang.indices.to_numpy()] if len(code) else np.zeros(0, np.int64), a.column("value").to_numpy()

        return Block(self.langs, {n: arrays(n) for n in range(1, ORDER + 1)}, {n: arrays(-n) for n in range(1, ORDER + 1)}, (lo, hi))

    def lookup(self, g: np.ndarray) -> np.ndarray:
        """Log-probabilities of packed four-symbol grams, block by block."""
        out = np.zeros((len(g), len(self.langs)), np.float32)
        for i in range(len(self.ranges)):
            b = self.block(i)
            mine = b.holds(g)
            out[mine] = b.lookup(g[mine])
        return out


class Block:
    """For each order sorted grams with a row of log-probabilities (one a language), and contexts with back-offs;
    of the four-symbol grams with a middle pair in a range."""

    def __init__(self, langs: list[str], probs: dict, gammas: dict, pairs: tuple[int, int]):
        self.langs, self.pairs, k = langs, pairs, len(langs)
        self.g, self.p, self.h, self.b = {}, {}, {}, {}
        self.unknown = np.full(k, np.log(1 / 65536), np.float32)
        for n in range(1, ORDER + 1):
            self.h[n], self.b[n] = self._matrix(gammas[n], 0.0)
            self.g[n], p = self._matrix(probs[n], np.nan)
            back = self._back(self.g[n], n)
            self.p[n] = np.where(np.isnan(p), back, p).astype(np.float32)

    def _matrix(self, rows, empty):
        key, lang, value = rows
        u, inv = np.unique(key, return_inverse=True)
        m = np.full((len(u), len(self.langs)), empty, np.float32)
        m[inv, lang] = value
        return u, m

    def _at(self, table, x):
        if not len(table):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        i = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return i, table[i] == x

    def holds(self, g: np.ndarray) -> np.ndarray:
        """Which packed four-symbol grams are this block's."""
        m = _middle(g)
        return (m >= self.pairs[0]) & (m < self.pairs[1])

    def _back(self, g, n):
        """Log-probabilities of grams of order n from the order below."""
        i, ok = self._at(self.h[n], g.view(np.uint64).__rshift__(np.uint64(16)).view(np.int64))
        out = np.where(ok[:, None], self.b[n][i] if len(self.b[n]) else 0, 0).astype(np.float32)
        return out + (self.lookup(_suffix(g, n - 1), n - 1) if n > 1 else self.unknown)

    def lookup(self, g: np.ndarray, n: int = ORDER) -> np.ndarray:
        i, ok = self._at(self.g[n], g)
        out = self.p[n][i] if len(self.p[n]) else np.zeros((len(g), len(self.langs)), np.float32)
        if not ok.all():
            out[~ok] = self._back(g[~ok], n)
        return out


def fit(docs: DataFrame, cells: int = CELLS) -> Model:
    """Fit on all (lang, text) rows; rows without a language are left out."""
    bounded_batches(docs.sparkSession)
    counts = gram_counts(docs.where(F.col("lang").isNotNull()).select("lang", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    probs, gammas = kneser_ney(counts)
    langs = [r.lang for r in probs[1].select("lang").distinct().orderBy("lang").collect()]
    tables = {n: t.select(F.col("g").alias("key"), "lang", F.log("p").alias("value")) for n, t in probs.items()}
    tables |= {-n: t.select(F.col("h").alias("key"), "lang", F.col("gamma").alias("value")) for n, t in gammas.items()}
    return Model(langs, tables, cells)


def entropies(text: Column, shared) -> Column:
    """array<double>: the share that a block's grams have in the cross-entropy per gram under each language; null
    without a letter. The shares of all blocks add up to the cross-entropy."""

    def f(texts: pa.Array) -> pa.Array:
        m, out = shared.value, [None] * len(texts)
        texts = texts.cast(pa.large_string()).fill_null("")
        for rows, part in _runs(np.arange(len(texts)), texts):
            g, doc, letters = _packed(part)
            n = np.bincount(doc, minlength=len(part))
            mine = m.holds(g)
            g, doc = g[mine], doc[mine]
            lp = m.lookup(g)
            ce = np.stack([-np.bincount(doc, lp[:, j], len(part)) for j in range(len(m.langs))], 1) / np.maximum(n, 1)[:, None] if m.langs else None
            for i in np.flatnonzero((letters > 0) & (n > 0)) if m.langs else ():
                out[rows[i]] = ce[i].tolist()
            # a single letter between two marks is shorter than a gram: the unigrams decide, in the first block
            for i in np.flatnonzero((letters > 0) & (n == 0)) if m.langs else ():
                out[rows[i]] = (-m.lookup(np.array([ord(part[i].lower())], np.int64), 1)[0] * (m.pairs[0] == 0)).astype(float).tolist()
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(f, T.ArrayType(T.DoubleType()))(text)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the text as a written table, with _ce: the cross-entropies under each language."""
    sc = docs.sparkSession.sparkContext
    docs, text = docs.drop("lang_pred", "score", "cross_entropy", "accepted"), F.col("text").cast("string")
    if len(model.ranges) == 1:
        shared = sc.broadcast(model.block(0))
        out = written(docs.withColumn("_ce", entropies(text, shared)).drop("text"), "languages")  # no texts: read twice
        shared.destroy()
        return out
    docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")
    path = scratch_path(docs.sparkSession, "shares")
    for i in range(len(model.ranges)):
        shared = sc.broadcast(model.block(i))
        shares = docs.select("_row", entropies(text, shared).alias("_ce"))
        shares.write.mode("append").parquet(path)
        shared.destroy()
    total = F.array(*[F.sum(F.get("_ce", F.lit(j))) for j in range(len(model.langs))])
    shares = docs.sparkSession.read.schema(shares.schema).parquet(path).groupBy("_row").agg(F.when(F.count("_ce") > 0, total).alias("_ce"))
    return written(docs.drop("text").join(shares, "_row").drop("_row"), "languages")


def identify(docs: DataFrame, model: Model, learned: Column) -> DataFrame:
    """All columns but the text, with lang_pred, score, cross_entropy and accepted; ``learned`` says which rows
    calibrate the limits."""
    spark = docs.sparkSession
    bounded_batches(spark)
    d = _scored(docs, model)
    best = F.array_min("_ce")
    names = F.array(*[F.lit(x) for x in model.langs]) if model.langs else F.array().cast("array<string>")
    d = d.withColumn("lang_pred", F.coalesce(F.get(names, (F.array_position("_ce", best) - 1).cast("int")), F.lit("und")))
    soft = 1 / F.aggregate("_ce", F.lit(0.0), lambda a, x: a + F.exp(SHARPNESS * (best - x)))
    d = d.withColumn("score", F.coalesce(soft, F.lit(0.0))).withColumn("cross_entropy", best).drop("_ce")
    limits = d.where(learned & (F.col("lang") == F.col("lang_pred"))).groupBy("lang_pred").agg(
        (F.avg("cross_entropy") + SIGMAS * F.coalesce(F.stddev("cross_entropy"), F.lit(0.0))).alias("_limit"))
    return (d.join(F.broadcast(limits), "lang_pred", "left")  # one row a language
            .withColumn("accepted", F.coalesce(F.col("cross_entropy") <= F.col("_limit"), F.lit(False))).drop("_limit"))
