"""Benchmark decontamination by winnowing.

A *window* is ``window`` consecutive words of a benchmark item (all words of a shorter item).
Of every ``window - k + 1`` consecutive k-gram hashes the smallest one (the last on a tie) is a
fingerprint, so each window of ``window`` words holds at least one, and the same one wherever the
window occurs: every shared span of ``window`` words or more shares a fingerprint. Items shorter
than ``window`` are fingerprinted with their own length (a winnowing window of one).

A benchmark of at most ``block_rows`` entries (windows and item ids, counted before) is broadcast and
looked up in one scan of the documents, which aren't shuffled; every hit is extended over the words around
it, comparing 128-bit digests of whole windows. A larger benchmark never passes through the driver: a bit
table of fixed size (2**FILTER_BITS bits of its fingerprints) leaves in the scan only the digests of windows
around fingerprints that may be shared; those are joined with the written benchmark by digest, salted against
passages that very many documents hold, and the hits go back to their rows by a written row key. The bit
table only saves work: the more it fills, the more windows the join has to refute.

Defined results: a null or empty text has no words, hits nothing and is not contaminated; a null
item id counts as the id ''; repeated rows are judged one by one; columns of the input are kept
(an input column named like an output column is replaced); an empty benchmark hits nothing.
"""

from __future__ import annotations

from fractions import Fraction

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm import text as X
from churnscope.llm.store import bounded_batches, written

K = 7
WINDOW = 13
BLOCK_ROWS = 200_000
FILTER_BITS = 24
SALT = 16

_CANDIDATES = "row long, start long, m int, digest binary"
_WINDOWS = "item string, m int, hash long, digest binary"
_HITS = T.StructType([T.StructField("n_words", T.LongType()),
                      T.StructField("starts", T.ArrayType(T.LongType())),
                      T.StructField("ends", T.ArrayType(T.LongType())),
                      T.StructField("items", T.ArrayType(T.StringType()))])


def _digest(low: np.ndarray, s, e, i: int, m: int) -> bytes:
    """128-bit digest of ``m`` words from word ``i``."""
    d = hashlib.blake2b(digest_size=16)
    for j in range(i, i + m):
        d.update(low[s[j]:e[j]].tobytes())
        d.update(b" ")
    return d.digest()


def winnow(g: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """For every run of ``w`` k-grams the position of the smallest hash (the last on a tie); -1 where
    the run isn't whole (``ok``, one for each run, says so)."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = g[:n].copy()
    at = np.zeros(n, np.int64)
    for j in range(1, w):
        x = g[j:j + n]
        less = x <= best
        best[less] = x[less]
        at[less] = j
    at += np.arange(n)
    at[~ok] = -1
    return at


def benchmark_windows(benchmark: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row for each distinct window of the benchmark: its items, length, fingerprint and digest."""
    w = window - k + 1

    def rows(batches):
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for lo, buf, offs in X.chunks(b.column(1)):
                low = X.LOWER[buf]
                s, e, doc = X.word_spans(buf, offs, X.ALNUM_WORD)
                h = X.word_hashes(low, s, e)
                at = winnow(X.grams(h, k), X.same_doc(doc, window), w)
                g = X.grams(h, k).view(np.int64)
                out += [(ids[lo + doc[i]], window, int(g[p]), _digest(low, s, e, i, window))
                        for i, p in enumerate(at) if p >= 0]
                n_words = np.bincount(doc, minlength=len(offs) - 1)
                first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
                for d in np.flatnonzero((n_words > 0) & (n_words < window)):
                    m, i = int(n_words[d]), int(first[d])
                    out.append((ids[lo + d], m, int(X.grams(h[i:i + m], m).view(np.int64)[0]), _digest(low, s, e, i, m)))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                names=["item", "m", "hash", "digest"])

    src = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return (src.mapInArrow(rows, _WINDOWS).groupBy("m", "hash", "digest").agg(F.collect_set("item").alias("items")))


class Block:
    """A bounded part of the benchmark's windows, ready for look-ups in a task."""

    def __init__(self, rows):
        self.by_m: dict = {}
        self.items = {}
        for m, h, digest, items in rows:
            self.by_m.setdefault(m, []).append(h)
            self.items[digest] = tuple(items)
        self.by_m = {m: np.unique(np.array(h, np.int64).view(np.uint64)) for m, h in self.by_m.items()}


def _found(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x) if len(x) else np.zeros(0, np.int64)


def _around(h: np.ndarray, doc: np.ndarray, m: int, k: int, window: int, found) -> np.ndarray:
    """First words of the windows of ``m`` words with a fingerprint that ``found`` (hashes -> positions) finds."""
    whole, w = X.same_doc(doc, m), window - k + 1
    if not len(whole):
        return np.zeros(0, np.int64)
    if m == window:  # a fingerprint is shared: extend to all windows around it
        g = X.grams(h, k)
        at = winnow(g, whole, w)
        at = at[at >= 0]  # never falls
        p = at[np.diff(at, prepend=-1) > 0]
        p = p[found(g[p])]
        i = np.unique((p[:, None] - np.arange(w)[None, :]).ravel())
        i = i[(i >= 0) & (i < len(whole))]
    else:
        i = found(X.grams(h, m))
    return i[whole[i]]


def _matcher(shared, k: int, window: int):
    """An Arrow function: text -> words, hit spans (in words) and items of one block."""
    def match(texts: pa.Array) -> pa.Array:
        block = shared.value
        n = len(texts)
        n_words = np.zeros(n, np.int64)
        starts, ends, items = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)]
        for lo, buf, offs in X.chunks(texts):
            low = X.LOWER[buf]
            s, e, doc = X.word_spans(buf, offs, X.ALNUM_WORD)
            counts = np.bincount(doc, minlength=len(offs) - 1)
            n_words[lo:lo + len(counts)] = counts
            first = np.cumsum(counts) - counts
            h = X.word_hashes(low, s, e)
            for m, table in block.by_m.items():
                i = _around(h, doc, m, k, window, lambda x: _found(table, x))  # noqa: B023
                for i in i:
                    got = block.items.get(_digest(low, s, e, i, m))
                    if got is not None:
                        d = doc[i]
                        starts[lo + d].append(int(i - first[d]))
                        ends[lo + d].append(int(i - first[d]) + m)
                        items[lo + d].update(got)
        return pa.StructArray.from_arrays(
            [pa.array(n_words), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
             pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["n_words", "starts", "ends", "items"])

    return match


def _covered(starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Words inside any span."""
    out = []
    for s, e in zip(starts.to_pylist(), ends.to_pylist()):
        n, done = 0, 0
        for a, b in sorted(zip(s, e)):
            n += max(0, b - max(a, done))
            done = max(done, b)
        out.append(n)
    return pa.array(out, pa.int64())


def _by_broadcast(docs: DataFrame, windows: DataFrame, k: int, window: int) -> DataFrame:
    """One scan of the documents against a small benchmark."""
    block = Block([(r.m, r.hash, bytes(r.digest), r["items"]) for r in windows.toLocalIterator()])
    shared = docs.sparkSession.sparkContext.broadcast(block)
    d = docs.withColumn("_hits", F.arrow_udf(_matcher(shared, k, window), _HITS)(F.col("text").cast("string")))
    n_hit = F.arrow_udf(_covered, T.LongType())(F.col("_hits.starts"), F.col("_hits.ends"))
    return d.withColumns({"n_words": F.col("_hits.n_words"), "n_hit": n_hit, "items": F.array_sort("_hits.items")}).drop("_hits")


def _filter(windows: DataFrame) -> np.ndarray:
    """The bit table of the benchmark's fingerprints; at most 2**(FILTER_BITS - 6) rows reach the driver."""
    slot = F.pmod("hash", F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in windows.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        out[r["at"]] = r.bits
    return out.view(np.uint64)


def _candidates(shared, lengths: list, k: int, window: int):
    """Arrow batches (row, text) -> the windows around fingerprints that pass the bit table."""
    def found(x):
        slot = x & np.uint64((1 << FILTER_BITS) - 1)
        return np.flatnonzero((shared.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))

    def run(batches):
        for b in batches:
            rows = b.column(0).to_numpy()
            for lo, buf, offs in X.chunks(b.column(1)):
                low = X.LOWER[buf]
                s, e, doc = X.word_spans(buf, offs, X.ALNUM_WORD)
                counts = np.bincount(doc, minlength=len(offs) - 1)
                first = np.cumsum(counts) - counts
                h = X.word_hashes(low, s, e)
                for m in lengths:
                    i = _around(h, doc, m, k, window, found)
                    if len(i):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rows[lo + doc[i]]), pa.array(i - first[doc[i]]), pa.array(np.full(len(i), m, np.int32)),
                             pa.array([_digest(low, s, e, j, m) for j in i], pa.binary())], names=["row", "start", "m", "digest"])
    return run


def _word_count(texts: pa.Array) -> pa.Array:
    n = np.zeros(len(texts), np.int64)
    for lo, buf, offs in X.chunks(texts):
        doc = X.word_spans(buf, offs, X.ALNUM_WORD)[2]
        n[lo:lo + len(offs) - 1] = np.bincount(doc, minlength=len(offs) - 1)
    return pa.array(n)


def _by_join(docs: DataFrame, windows: DataFrame, k: int, window: int) -> DataFrame:
    """Any benchmark: what may be shared is joined with it by digest."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    keyed = written(docs.select(F.struct(*docs.columns).alias("doc"), text.alias("text"),
                                F.monotonically_increasing_id().alias("row")), "keyed")
    lengths = sorted(r.m for r in windows.select("m").distinct().collect())  # at most ``window``
    shared = spark.sparkContext.broadcast(_filter(windows))
    cand = written(keyed.select("row", "text").mapInArrow(_candidates(shared, lengths, k, window), _CANDIDATES), "candidates")
    real = written(windows.select("digest", "items").join(cand.select("digest").distinct(), "digest", "left_semi"), "hit-windows")
    salted = real.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hits = cand.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALT))).join(salted, ["digest", "salt"])
    # a row's windows are at most as many as its words
    of_row = hits.groupBy("row").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("m")).alias("end"))).alias("spans"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    n_hit = F.arrow_udf(_covered, T.LongType())(F.col("spans.start"), F.col("spans.end"))
    found = written(of_row.select("row", n_hit.alias("n_hit"), "items"), "hits")
    out = ("n_words", "n_hit", "items")
    return (keyed.join(found, "row", "left")
            .select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in out],
                    F.arrow_udf(_word_count, T.LongType())(F.col("text")).alias("n_words"),
                    F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW,
                  block_rows: int = BLOCK_ROWS, min_share: float = 0.05) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as sorted strings) and contaminated (n_hit > 0 and at least
    ``min_share`` of the words)."""
    bounded_batches(docs.sparkSession)
    windows = written(benchmark_windows(benchmark, k, window), "benchmark-windows")
    # a long id counts as several entries
    size = windows.agg(F.sum(F.expr("aggregate(items, 1L, (n, x) -> n + 1 + length(x) div 64)"))).first()[0] or 0
    d = (_by_broadcast if size <= block_rows else _by_join)(docs, windows, k, window)
    share = Fraction(str(min_share))  # exact: 0.4 is 2/5
    return d.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share.denominator >= F.col("n_words") * share.numerator))
