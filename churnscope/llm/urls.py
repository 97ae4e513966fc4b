r"""URL filter: rules first, then naive Bayes on segmented host and path words.

Names such as ``freebets`` are split by a unigram Viterbi search. The unigrams are the words of all
pages' HTML. Nothing unbounded is broadcast: the substrings of the distinct host labels are joined
with the word counts, and each label is segmented from its own matches. The segmented words of
host and path are hashed into 2**BITS bins; multinomial naive Bayes learns from the pages that the
rules decide (their verdicts are the labels) and judges the others.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by the
class shares alone; no page decided by a rule: everything left is allowed; repeated rows are judged
one by one; all columns stay (names of the outputs are replaced).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm.store import written

#: (verdict, host, path): fits the host and its subdomains if the path starts with the rule's; the longest wins
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BITS = 16
LONGEST_WORD = 20
SMALL = 200_000
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(c: Column) -> Column:
    return F.translate(c, _AZ, _AZ.lower())


def parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path."""
    get = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return _lower(get(1)), get(2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits."""
    fit = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        c = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        s = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fit = F.when(c, s) if fit is None else fit.when(c, s)
    return fit


def lexicon(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): counts of the a-z words of up to LONGEST_WORD letters in all pages."""
    w = pages.select(F.explode(F.split(_lower(F.col(html).cast("string")), "[^a-z]+")).alias("word"))
    return w.where(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(label: str, edges: list[tuple[int, int, int]], total: int) -> list[str]:
    """The most likely split. edges: (start, length, count) of known words; any other run of L letters has
    the probability 1 / (total * 10 ** (L - 1)), so unknown names stay whole."""
    n = len(label)
    score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    known: dict[int, list[tuple[int, float]]] = {}
    for s, length, count in edges:
        known.setdefault(s + length, []).append((s, math.log(count / total)))
    unit, ten = -math.log(max(total, 1)), math.log(10)
    best_s, best = 0, 0.0  # the unknown run that would be best to end here: score[s] + s * ten is largest
    for e in range(1, n + 1):
        score[e], back[e] = best + unit - (e - 1) * ten, best_s
        for s, p in known.get(e, ()):
            if score[s] + p > score[e]:
                score[e], back[e] = score[s] + p, s
        if score[e] + e * ten > best:
            best_s, best = e, score[e] + e * ten
    out, e = [], n
    while e > 0:
        out.append(label[back[e]:e])
        e = back[e]
    return out[::-1]


def segmented_hosts(hosts: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(host, words) for each distinct host: its labels (cut at dots and hyphens) segmented, in order."""
    hosts = hosts.select("host").distinct()
    at = hosts.select("host", F.posexplode(F.split("host", "[.-]")).alias("pos", "label")).where(F.length("label") > 0)
    labels = at.select("label").distinct()
    starts = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("s"))
    top = F.least(F.lit(LONGEST_WORD), F.length("label") - F.col("s") + 1)
    subs = starts.select("label", "s", F.explode(F.sequence(F.lit(1), top)).alias("len")).withColumn("word", F.expr("substring(label, s, len)"))
    edges = subs.join(words, "word").groupBy("label").agg(F.collect_list(F.struct((F.col("s") - 1).alias("s"), "len", "n")).alias("edges"))

    def split(label: pa.Array, edges: pa.Array) -> pa.Array:
        rows = zip(label.to_pylist(), edges.to_pylist())
        return pa.array([viterbi(x, [(e["s"], e["len"], e["n"]) for e in es or []], total) for x, es in rows], pa.list_(pa.string()))

    done = labels.join(edges, "label", "left").select("label", F.arrow_udf(split, T.ArrayType(T.StringType()))("label", "edges").alias("words"))
    joined = at.join(done, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("all"))
    return joined.select("host", F.flatten(F.col("all.words")).alias("words"))


def _bins(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(1 << BITS)).cast("int"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with host, path, rule, verdict, words (of host and path) and p_block (null where a rule decides)."""
    spark = pages.sparkSession
    host, path = parts(F.col(url).cast("string"))
    d = pages.withColumns({"host": host, "path": path})
    d = d.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules))
    urls = d.select("host", "path", F.col("_fit.verdict").alias("verdict"))
    lex = written(lexicon(pages, html), "lexicon")
    total = lex.agg(F.sum("n")).first()[0] or 1
    seg = written(segmented_hosts(urls, lex, total), "hosts")
    small = seg.count() <= SMALL
    seg = seg.withColumnsRenamed({"host": "_h", "words": "_hw"})

    def with_words(x: DataFrame) -> DataFrame:
        x = x.join(F.broadcast(seg) if small else seg, F.col("host") == F.col("_h"), "left")
        path_words = F.filter(F.split(F.regexp_replace(_lower(F.col("path")), "[0-9]+", "0"), "[^a-z0]+"), lambda w: w != "")
        return x.withColumn("words", F.concat(F.coalesce("_hw", F.array().cast("array<string>")), path_words)).drop("_h", "_hw")

    learned = with_words(urls.where("verdict IS NOT NULL"))
    block = F.when(F.col("verdict") == "block", 1).otherwise(0)
    share = learned.agg(F.sum(block).alias("b"), F.count(F.lit(1)).alias("n")).first()
    by_bin = learned.select(F.explode(_bins(F.col("words"))).alias("bin"), block.alias("b")).groupBy("bin").agg(
        F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # at most 2**BITS rows
    b, a = np.ones(1 << BITS), np.ones(1 << BITS)
    for r in by_bin:
        b[r.bin] += r.b
        a[r.bin] += r["n"] - r.b
    weights = np.log(b / b.sum()) - np.log(a / a.sum())
    n_block, n_all = share.b or 0, share["n"]
    prior = math.log((n_block + 0.5) / (n_all - n_block + 0.5)) if n_all else -1.0
    shared = spark.sparkContext.broadcast((weights, prior))

    def odds(bins: pa.Array) -> pa.Array:
        w, p = shared.value
        out = [1 / (1 + math.exp(-max(-60.0, min(60.0, p + float(w[x].sum()) if x else p)))) for x in bins.to_pylist()]
        return pa.array(out, pa.float64())

    d = with_words(d.drop("words", "rule", "verdict", "p_block"))
    d = d.withColumn("_p", F.arrow_udf(odds, T.DoubleType())(_bins(F.col("words"))))
    by_model = F.when(F.col("_p") >= 0.5, "block").otherwise("allow")
    return d.withColumns({"rule": F.col("_fit.rule"), "verdict": F.coalesce("_fit.verdict", by_model),
                          "p_block": F.when(F.col("_fit").isNull(), F.col("_p"))}).drop("_p", "_fit")
