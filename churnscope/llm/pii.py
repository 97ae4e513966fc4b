r"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans (e-mail, IPv4 address, payment card, phone). The field then labels
every *candidate token* of a text (a run of non-spaces with a digit or ``@``) as one of the four
kinds or none. Its factors are node factors over hashed token features (shape, number of digits,
word before), chain factors between neighbouring candidates, and skip factors between a candidate
and the last one before it with the same text, the same last seven digits or the same e-mail user
name. Repeats form a chain of skip edges, so a token that occurs n times costs n edges, not n * n.
Tokens inside base spans are observed; loopy sum-product messages carry their labels to distant
look-alikes that no pattern matches, and a token whose label has ``min_marginal`` probability
becomes an added span. Messages are passed on until none changes, so a label reaches every repeat,
however many there are; only messages that go on oscillating round loops are stopped, after more
rounds than twice the number of the longest text's tokens.

Training is piecewise and covers all documents: the factors are smoothed log-ratios of label
counts (base spans as labels) by hashed feature, by neighbouring pair and by skip pair, which Spark
sums into at most ``BINS`` * 5 + 55 numbers.

Defined results: a null or empty text has no spans; repeated rows are scanned one by one; an empty
table trains a field of uniform factors; all columns of the input stay (names of the outputs are
replaced). Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm import text as X
from churnscope.llm.store import bounded_batches

KINDS = ("email", "ip", "card", "phone")
BINS = 4096
#: a message that changes by less is left as it is
TOLERANCE = 1e-6
#: after so many rounds messages move half the way only, which ends most oscillations
DAMPED = 100
#: a feature that training hasn't met speaks for "none" with this probability
UNSEEN = 0.95
#: pseudo-count of look-alikes that have the same label
AGREE = 50.0
#: a repeat speaks louder than the features of the single token
SKIP_WEIGHT = 2.5
MIN_MARGINAL = 0.9
_K = len(KINDS) + 1  # 0: none

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # any match of the contract's pattern starts at a run of digits
_CARD = re.compile(r"[0-9](?: ?[0-9]|-[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]+")
_MARK = re.compile(r"[0-9@]")
_RUN = re.compile(r"[^\W\d_]+")
_EDGE = " \t\r\n.,;:!?\"'()[]{}<>#$%&*|"

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        n = ord(c) - 48
        n += n * (i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(t: str):
    """For every @ the longest run of user-name characters before it that no earlier match has taken."""
    free, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > free and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            yield s, m.end()
            free = m.end()
        at = t.find("@", max(at + 1, free))


def base_spans(t: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind, then start; kind counts from 1."""
    if not t or not _MARK.search(t):
        return []
    out = [(1, s, e) for s, e in _emails(t)]
    out += [(2, m.start(), m.end()) for m in _IP.finditer(t)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(t):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and _luhn(d):
            out.append((3, m.start(), m.end()))
    out += [(4, m.start(), m.end()) for m in _PHONE.finditer(t) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _tokens(t: str):
    """Candidate tokens: (start, end, core start, core end); the core has no punctuation at its ends."""
    done = 0
    for m in _MARK.finditer(t):
        if m.start() < done:
            continue
        s, e = m.start(), m.end()
        while s > done and not t[s - 1].isspace():
            s -= 1
        while e < len(t) and not t[e].isspace():
            e += 1
        done = e
        core = t[s:e].strip(_EDGE)
        a = s + t[s:e].find(core)
        yield s, e, a, a + len(core)


def _features(t: str, s: int, a: int, b: int) -> list[int]:
    core = t[a:b]
    shape = _RUN.sub("a", _DIGIT.sub(lambda m: "9" * min(len(m[0]), 20), core))[:48]
    left = t[max(0, s - 40):s].split()
    word = left[-1].strip(_EDGE).lower() if left else ""
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BINS for f in
            ("s" + shape, "d%d" % min(sum(c.isdigit() for c in core), 40), "w" + (word if word.isalpha() else "#"))]


def _keys(core: str) -> list[str]:
    d, out = _digits(core), ["t" + core.lower()]
    if len(d) >= 7:
        out.append("d" + d[-7:])
    user = core.partition("@")[0].lower()
    if len(user) >= 4:
        out.append("u" + user)
    return out


class Graph:
    """Candidate tokens of several texts as one graph of separate parts."""

    def __init__(self, texts: list[str]):
        self.base, self.doc, self.core, self.label, feats, chain, skip = [], [], [], [], [], [], []
        for d, t in enumerate(texts):
            spans = base_spans(t)
            self.base.append(spans)
            if not _MARK.search(t):
                continue
            cover, at = sorted((s, e, k) for k, s, e in spans), 0
            last: dict[str, int] = {}
            before = -1
            for s, e, a, b in _tokens(t):
                while at < len(cover) and cover[at][1] <= a:
                    at += 1
                hit = next((c for c in cover[at:at + 4] if c[0] < max(b, a + 1) and c[1] > a), None)
                i = len(self.doc)
                self.doc.append(d)
                self.core.append((a, b))
                self.label.append(hit[2] if hit else 0)
                feats.append(_features(t, s, a, b))
                if before >= 0:
                    chain.append((before, i))
                before = i
                keys = _keys(t[a:b])
                skip += {(last[k], i) for k in keys if k in last}
                last.update((k, i) for k in keys)
        self.label = np.array(self.label, np.int64)
        self.feats = np.array(feats, np.int64).reshape(-1, 3)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)


def _marked(texts: pa.Array):
    """Yield (rows, texts) of the rows that have a digit or @, in bounded runs."""
    for lo, buf, offs in X.chunks(texts):
        hit = np.concatenate([[0], np.cumsum(((buf >= 48) & (buf <= 57)) | (buf == 64))])[offs]
        rows = np.flatnonzero(hit[1:] > hit[:-1])
        if len(rows):
            raw = buf.tobytes()
            yield lo + rows, [raw[offs[r]:offs[r + 1]].decode("utf-8", "replace") for r in rows]


class Field:
    """Log-factors: by feature and label, chain pair, skip pair."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray, prior: np.ndarray):
        p = (prior + 1) / (prior + 1).sum()
        self.prior = np.log(p)
        none = np.where(np.arange(_K) == 0, UNSEEN, (1 - UNSEEN) / (_K - 1))
        post = (node + none) / (node.sum(1, keepdims=True) + 1)
        self.node = np.log(post) - self.prior
        # each factor: log of the pair's share against independent labels
        ratio = lambda c: np.log((c + c.T + 2 * np.outer(p, p)) / (2 * c.sum() + 2)) - self.prior[:, None] - self.prior[None, :]
        self.chain = np.clip(ratio(chain), -4, 4)
        self.skip = np.clip(ratio(skip + AGREE * np.diag(p)), -6, 6)

    def marginals(self, g: Graph) -> np.ndarray:
        """Label probabilities of each token by loopy sum-product messages."""
        n = len(g.label)
        own = self.prior + 0.6 * self.node[g.feats].sum(1)
        seen = g.label > 0
        own[seen] = -50.0
        own[seen, g.label[seen]] = 0.0
        # neighbours that look alike have one edge with both factors: as two edges they would confirm each other
        u, at = np.unique(np.concatenate([g.chain, g.skip]), axis=0, return_inverse=True)
        f = np.zeros((len(u), _K, _K))
        np.add.at(f, at.ravel(), np.repeat([0.5 * self.chain, SKIP_WEIGHT * self.skip], [len(g.chain), len(g.skip)], axis=0))
        m = len(u)
        src, dst = np.concatenate([u[:, 0], u[:, 1]]), np.concatenate([u[:, 1], u[:, 0]])
        by_src = np.argsort(src, kind="stable")
        first = np.searchsorted(src[by_src], np.arange(n + 1))
        msg, b = np.zeros((2 * m, _K)), own
        limit = 2 * np.bincount(g.doc).max() + 4 * DAMPED if n else 0
        e = np.arange(2 * m)  # messages to compute: those whose sender has changed
        for done in range(limit):
            if not len(e):
                break
            x = (b[src[e]] - msg[(e + m) % (2 * m)])[:, :, None] + f[e % m]
            top = x.max(1, keepdims=True)
            new = (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]
            change = (new - new.max(1, keepdims=True) - msg[e]) * (1.0 if done < DAMPED else 0.5)
            moved = np.abs(change).max(1) > TOLERANCE
            e, change = e[moved], change[moved]
            msg[e] += change
            np.add.at(b, dst[e], change)
            v = np.unique(dst[e])
            size = first[v + 1] - first[v]
            e = by_src[np.repeat(first[v] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        b = np.exp(b - b.max(1, keepdims=True))
        return b / b.sum(1, keepdims=True)

    def added(self, g: Graph, texts: list[str], min_marginal: float) -> list[list[tuple[int, int, int]]]:
        """For each text the spans that the field adds; neighbouring tokens of one kind make one span."""
        out: list[list] = [[] for _ in texts]
        if not len(g.label):
            return out
        p = self.marginals(g)
        y = p.argmax(1)
        for i in np.flatnonzero((g.label == 0) & (y > 0) & (p.max(1) >= min_marginal)):
            d, (a, b), k = g.doc[i], g.core[i], int(y[i])
            if a == b or any(s < b and e > a for _, s, e in g.base[d]):
                continue
            last = out[d][-1] if out[d] else None
            if last and last[0] == k and a - last[2] <= 3 and not any(c.isalnum() or c == "\n" for c in texts[d][last[2]:a]):
                out[d][-1] = (k, last[1], b)
            else:
                out[d].append((k, a, b))
        return out


def fit(docs: DataFrame) -> Field:
    """Counts over all documents, summed by Spark; what comes to the driver is bounded by BINS."""

    def rows(batches):
        for b in batches:
            total = np.zeros((BINS + 2 * _K + 1, _K), np.int64)
            for _, texts in _marked(b.column(0)):
                g = Graph(texts)
                np.add.at(total, (g.feats, g.label[:, None]), 1)
                for at, e in ((BINS, g.chain), (BINS + _K, g.skip)):
                    np.add.at(total, (at + g.label[e[:, 0]], g.label[e[:, 1]]), 1)
                total[-1] += np.bincount(g.label, minlength=_K)
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "n"])

    bounded_batches(docs.sparkSession)
    total = np.zeros((BINS + 2 * _K + 1, _K))
    src = docs.select(F.col("text").cast("string").alias("text"))
    for r in src.mapInArrow(rows, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        total[r.i, r.j] = r["n"]
    return Field(total[:BINS], total[BINS:BINS + _K], total[BINS + _K:-1], total[-1])


def find(docs: DataFrame, field: Field, min_marginal: float = MIN_MARGINAL) -> DataFrame:
    """``docs`` with base_spans and added_spans: arrays of (kind from 1 as in KINDS, start, end), by kind, then start."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def f(texts: pa.Array) -> pa.Array:
        base, more = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
        rec = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans)]
        for rows, part in _marked(texts):
            g = Graph(part)
            for r, b, a in zip(rows, g.base, shared.value.added(g, part, min_marginal)):
                base[r], more[r] = rec(b), rec(a)
        return pa.StructArray.from_arrays([pa.array(base, span), pa.array(more, span)], names=["base", "added"])

    out = T.StructType([T.StructField("base", SPAN), T.StructField("added", SPAN)])
    return (docs.withColumn("_pii", F.arrow_udf(f, out)(F.col("text").cast("string")))
            .withColumns({"base_spans": F.col("_pii.base"), "added_spans": F.col("_pii.added")}).drop("_pii"))


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets (overlapping spans by the first
    one's kind) and n_chars counted anew."""

    def f(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for r, found in enumerate(spans.to_pylist()):
            if not found:
                continue
            t, parts, done = out[r], [], 0
            for s, e, k in sorted((x["start"], x["end"], x["kind"]) for x in found):
                if s >= done:
                    parts += [t[done:s], f"[{KINDS[k - 1].upper()}]"]
                done = max(done, e)
            out[r] = "".join([*parts, t[done:]])
        return pa.array(out, pa.string())

    d = find(docs, field)
    new = F.arrow_udf(f, T.StringType())(F.col("text"), F.concat("base_spans", "added_spans"))
    return (d.withColumn("text", new).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
            .select(*docs.columns))
