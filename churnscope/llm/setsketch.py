"""Near-duplicate groups by SetSketch registers: banded, estimated jointly by likelihood, then verified on whole sets.

A text's set is its distinct word n-grams (two words by default). Texts with equal sets are one *class*.

1. One scan sketches each class that a task meets. Every n-gram seeds a Poisson process whose points fall on random
   registers; a register holds the first point t of all n-grams as floor(1 - log_b t), cut to 16 bits (exponentially
   spaced, truncated minima). Registers of a union are the larger of both, and two sets agree in a register with a
   chance of at least (nearly) their Jaccard similarity J, independently by register.
2. ``ROWS`` registers make a band. Classes that agree in a band are candidates. At the threshold 0.8 two sets miss all
   ``BANDS`` bands with a chance of (1 - 0.8**ROWS)**BANDS = 1e-11; that is the only way to lose a link, besides 3.
3. Every class of a band is tied to the band's smallest class (a star, never all pairs). A tie's J is the maximum of the
   joint likelihood of how many registers are larger, smaller and equal, given the sizes; ties that are estimated below
   the threshold less ``SLACK`` go (of the ties at the threshold about 2e-10: seven standard errors).
4. The rest is verified by the intersection of the whole sets, which a second scan makes for candidate classes only,
   with their sketches: the first scan's are read once, for the bands.
   Connected components of the verified links. Bands that still hold several components get a second star, around
   their class with the most links so far (the text that a group of copies was made from is such a one).
5. Bands whose classes still lie in different components are compared within: only classes outside the band's largest
   component, with classes of like size, in blocks of bounded rows, each by estimate, then whole sets, and a pair only in
   the first band that it shares. A task returns a spanning forest of what it has verified.

Shuffled by class or by band. The bands of all classes are shuffled once and not written: a window over each band keeps
the rows of those with several classes (a band's rows are small, and Spark spills them). Later tables that are joined back
to their rows by a key that may be hot are written before, so that Spark's adaptive execution can split a hot key's rows.
Texts are not shuffled.

Defined results: null or empty texts, and texts without words, have an empty set, link with nothing and stay; a text with
fewer words than n has its whole word sequence as its only n-gram; repeated rows are rows of one class; a null doc_id never
names a component, unless all of it is null; rows that share the smallest doc_id of a component are all ``kept``;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm import text as X
from churnscope.llm.components import components
from churnscope.llm.jaccard import _signature as signature
from churnscope.llm.jaccard import gram_sets
from churnscope.llm.store import bounded_batches, written

N = 2
#: hundredths: two sets link at this Jaccard similarity
THRESHOLD = 80
ROWS, BANDS = 4, 48
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65535
SLACK = 0.2
#: classes of one side of a block
BLOCK = 256
#: bits of the filter of candidate classes (a fixed size)
FILTER_BITS = 24


# ---- sketches -------------------------------------------------------------------------------------------------------

def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


def sketches(sets: list) -> np.ndarray:
    """The registers of each set (arrays of distinct 64-bit hashes), as rows of uint16; an empty set has zeros."""
    n = len(sets)
    first = np.full(n * REGISTERS, np.inf)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    h = np.concatenate([*sets, np.zeros(0, np.uint64)])
    t, at, size = np.zeros(len(h)), 0, 1
    while len(h):  # the next points of each n-gram's process, until these come after all first points of its set
        with np.errstate(over="ignore"):
            draw = X.mix(h[:, None] + (np.arange(at + 1, at + size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])
            slot = X.mix(draw ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(REGISTERS)
        points = t[:, None] + np.cumsum(-np.log(_uniform(draw)), axis=1) / (RATE * REGISTERS)
        np.minimum.at(first, (doc[:, None] * REGISTERS + slot.astype(np.int64)).ravel(), points.ravel())
        t = points[:, -1]
        going = t < first.reshape(n, REGISTERS).max(axis=1)[doc]
        h, doc, t = h[going], doc[going], t[going]
        at, size = at + size, min(2 * size, 256) if at else 1
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(first) / np.log(BASE))
    return np.clip(np.where(np.isfinite(first), k, 0), 0, TOP).astype(np.uint16).reshape(n, REGISTERS)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(r), 0)
        for j in range(ROWS):
            key = X.mix(key * np.uint64(0xD6E8FEB86659FD93) + r[:, :, j] + np.uint64(1))
    return key.view(np.int64)


def _slope(j, larger, smaller, equal, u):
    """The slope of the joint log-likelihood at J = j; it falls with j."""
    v, z = 1 - u, (BASE - 1) / BASE
    x, y = np.maximum(u - v * j, 1e-15), np.maximum(v - u * j, 1e-15)
    p, q = -np.log1p(-x * z) / np.log(BASE), -np.log1p(-y * z) / np.log(BASE)
    dp, dq = z / (1 - x * z) / np.log(BASE), z / (1 - y * z) / np.log(BASE)
    return equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-15) - v * larger * dp / p - u * smaller * dq / q


def likely_jaccard(larger: np.ndarray, smaller: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The J with the largest joint likelihood: ``larger`` registers of a are above b's, ``smaller`` below, the rest
    equal. The likelihood is concave in J; its slope's zero is found by halving."""
    u = size_a / (size_a + size_b)
    lo, hi = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(40):
        j = (lo + hi) / 2
        up = _slope(j, larger, smaller, REGISTERS - larger - smaller, u) > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    return (lo + hi) / 2


def likely(ra: np.ndarray, rb: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which pairs of sketches have an estimate of at least the threshold less ``SLACK``: there the likelihood still rises."""
    larger, smaller = (ra > rb).sum(1), (ra < rb).sum(1)
    floor, u = THRESHOLD / 100 - SLACK, size_a / (size_a + size_b)
    return (np.minimum(u / (1 - u), (1 - u) / u) >= floor) & (_slope(floor, larger, smaller, REGISTERS - larger - smaller, u) >= 0)


def _is_likely(a, b, na, nb):
    """Column: ``likely`` of two sketches (binary columns) of sets with ``na`` and ``nb`` n-grams."""

    def f(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        ra, rb = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (a, b))
        return pa.array(likely(ra, rb, *(x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (na, nb))))

    return F.arrow_udf(f, T.BooleanType())(a, b, na, nb)


# ---- steps ----------------------------------------------------------------------------------------------------------

def sketched(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n, sig, registers): set size and class of each row, with the sketch where the task first meets the class."""

    def rows(batches):
        seen = set()
        for b in batches:
            for lo, sets in gram_sets(b.column(1), n):
                sigs = [signature(s) for s in sets]
                new = []
                for i, s in enumerate(sets):
                    if len(s) and sigs[i] not in seen:
                        seen.add(sigs[i])
                        new.append(i)
                regs: list = [None] * len(sets)
                for i, r in zip(new, sketches([sets[i] for i in new])):
                    regs[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()),
                                                  pa.array(regs, pa.binary())], names=["doc_id", "n", "sig", "registers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(rows, f"doc_id {kind}, n long, sig long, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """(band, k, sig): every band of every class; k is the band's number."""

    def rows(batches):
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs).ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), b.num_rows)),
                                              b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], names=["band", "k", "sig"])

    return classes.select("sig", "registers").mapInArrow(rows, "band long, k tinyint, sig long")


def shared_bands(every: DataFrame) -> DataFrame:
    """(band, k, sig, leader): the rows of the bands that hold several classes, with the band's smallest class."""
    band = Window.partitionBy("band")
    rows = every.withColumns({"leader": F.min("sig").over(band), "last": F.max("sig").over(band)})
    return rows.where("leader < last").drop("last")


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int = N) -> DataFrame:
    """(sig, n, registers, grams) of the wanted classes (sig), by a second scan. The scan leaves out most others by a filter of a fixed
    number of bits; the join with the wanted classes does the rest."""
    bit = F.shiftrightunsigned("sig", 64 - FILTER_BITS)
    words = wanted.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("b"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words.toLocalIterator():  # at most 2**(FILTER_BITS - 6) numbers
        bits[r.w] = r.b
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def rows(batches):
        seen, bits = set(), shared.value
        for b in batches:
            for _, sets in gram_sets(b.column(0), n):
                sigs, found = [], []
                for s in sets:
                    sig = signature(s)
                    at = (sig & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)
                    if len(s) and sig not in seen and (int(bits[at >> 6]) >> (at & 63)) & 1:
                        seen.add(sig)
                        sigs.append(sig)
                        found.append(s)
                size = np.array([len(s) for s in found], np.int64)
                offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                grams = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(size), pa.array([r.tobytes() for r in sketches(found)], pa.binary()),
                                                  pa.ListArray.from_arrays(pa.array(offs), pa.array(grams))], names=["sig", "n", "registers", "grams"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, "sig long, n long, registers binary, grams array<long>")
    return found.join(wanted, "sig", "left_semi").groupBy("sig").agg(*(F.first(c).alias(c) for c in ("n", "registers", "grams")))


def _linked(overlap, na, nb):
    return 100 * overlap >= THRESHOLD * (na + nb - overlap)


def _star_links(ties: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the verified links among the ties (sig, leader)."""
    left = ties.distinct().join(classes, "sig").withColumnsRenamed({"registers": "ra", "n": "na"})
    both = written(left, "ties").join(classes.withColumnsRenamed({"sig": "leader", "registers": "rb", "n": "nb"}), "leader")
    low = F.least("na", "nb") * 100 >= THRESHOLD * F.greatest("na", "nb")
    some = both.where(low).where(_is_likely(F.col("ra"), F.col("rb"), F.col("na"), F.col("nb"))).select("sig", "leader", "na", "nb")
    # both sides read the sets under their own names: Spark then shuffles them once for both joins
    pairs = written(some, "likely").withColumnsRenamed({"sig": "a", "leader": "b"})
    pairs = pairs.join(sets.alias("sa"), F.col("a") == F.col("sa.sig")).join(sets.alias("sb"), F.col("b") == F.col("sb.sig"))
    overlap = F.size(F.array_intersect("sa.grams", "sb.grams"))
    return written(pairs.where(_linked(overlap, F.col("na"), F.col("nb"))).select("a", "b"), "star-links")


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """(band, k, sig, leader, label): members of the bands that hold several components, with their component."""
    rows = written(members.select("band", "k", "sig", "leader").join(label, "sig", "left").withColumn("label", F.coalesce("label", "sig")), "labelled")
    several = written(rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band"), "open-bands")
    return written(rows.join(several, "band"), "open-members")


def _second_ties(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, leader): the members of open bands with the band's class of most links, if they lie in different components."""
    degree = links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("links"))
    rows = written(rows.join(written(degree, "degrees"), "sig", "left").withColumn("links", F.coalesce("links", F.lit(0))), "open-members")
    hub = rows.groupBy("band").agg(F.max(F.struct("links", "sig", "label")).alias("hub"))
    hub = written(hub.select("band", F.col("hub.sig").alias("to"), F.col("hub.label").alias("in")), "hubs")
    return rows.join(hub, "band").where("label != in AND to != leader").select("sig", F.col("to").alias("leader"))


class _Part:
    """A group of rows (part, side, sig, label, n, low, k, registers), sorted by part, and its pairs worth verifying."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.table = table = table.take(pa.array(np.argsort(table.column("part").to_numpy(), kind="stable"))).combine_chunks()
        self.part, self.sig, self.side, label, self.n, self.k = (table.column(c).to_numpy() for c in ("part", "sig", "side", "label", "n", "k"))
        self.low = table.column("low").to_numpy(zero_copy_only=False)
        self.regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.root = np.unique(label, return_inverse=True)[1]  # joined rows carry one number

    def pairs(self):
        """Yield arrays (i, j) of the likely pairs of different roots, by i: side 0 against side 1, 2 against both. Left to
        other parts are pairs of which both are ``low`` (of the step below) or that share an earlier band than number k."""
        n, root, by_band = self.n, self.root, self.regs.view(np.uint64)  # the ROWS = 4 registers of a band are one number
        first, last = np.searchsorted(self.part, self.part), np.searchsorted(self.part, self.part, "right")
        left = np.flatnonzero(self.side != 1)
        upto, at = np.cumsum(last[left] - first[left]), 0
        while at < len(left):  # rows whose pairs are about 2**16
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 16), "right")))
            rows, at = left[at:to], to
            count = last[rows] - first[rows]
            i = np.repeat(rows, count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + first[i]
            ok = (self.side[j] != 0) & (root[i] != root[j]) & ((self.side[j] != 2) | (i < j)) & ~(self.low[i] & self.low[j])
            ok &= 100 * np.minimum(n[i], n[j]) >= THRESHOLD * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            ok = np.argmax(by_band[i] == by_band[j], axis=1) == self.k[i]
            i, j = i[ok], j[ok]
            ok = likely(self.regs[i], self.regs[j], n[i].astype(float), n[j].astype(float))
            yield i[ok], j[ok]


def _promising(table: pa.Table) -> pa.Table:
    """The rows that have a likely pair, without their registers."""
    p = _Part(table)
    found = np.zeros(len(p.sig), bool)
    for i, j in p.pairs():
        found[i] = found[j] = True
    return p.table.filter(pa.array(found)).drop_columns(["registers"])


def _compare(table: pa.Table) -> pa.Table:
    """A spanning forest of the verified links of a group of rows, which also have their whole sets (grams)."""
    p = _Part(table)
    lists = p.table.column("grams").chunk(0) if len(p.sig) else pa.array([], pa.list_(pa.int64()))
    off, gram = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)  # sorted as such
    out_a, out_b, n, root, sig = [], [], p.n, p.root, p.sig
    for i, j in p.pairs():
        cuts = np.flatnonzero(np.diff(i, prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(i))):
            row, c = i[lo], j[lo:hi]
            own = gram[off[row]:off[row + 1]]
            c = c[root[c] != root[row]]
            while len(c):  # a few at a time: those that are joined meanwhile needn't be verified
                now, c = c[:64], c[64:]
                g = np.concatenate([gram[off[x]:off[x + 1]] for x in now])
                hit = own[np.minimum(np.searchsorted(own, g), len(own) - 1)] == g
                o = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(n[now])[:-1]]))
                for x in now[_linked(o, n[row], n[now])]:
                    if root[x] != root[row]:
                        root[root == root[x]] = root[row]
                        out_a.append(sig[row])
                        out_b.append(sig[x])
                c = c[root[c] != root[row]]
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _rest_links(rows: DataFrame, classes: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(a, b): links between classes of one band that the stars haven't brought into one component."""
    by_label = rows.groupBy("band", "label").agg(F.count(F.lit(1)).alias("rows"))
    core = written(by_label.groupBy("band").agg(F.max_by("label", F.struct("rows", "label")).alias("core")), "cores")
    rows = rows.join(core, "band").select("band", "k", "sig", "label", (F.col("label") != F.col("core")).alias("loose"))
    rows = rows.join(classes.select("sig", "n"), "sig")
    # sets of like size lie in the same or in neighbouring steps of the threshold's powers
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / THRESHOLD))).cast("int")
    rows = rows.withColumn("own", step).withColumn("step", F.explode(F.array("own", F.col("own") + 1)))  # step s meets itself and s - 1 under s
    rows = written(rows.withColumn("low", F.col("own") < F.col("step")), "open-members")
    size = rows.groupBy("band", "step").agg(F.count(F.lit(1)).alias("n_all"), F.sum(F.col("loose").cast("int")).alias("n_loose"), F.min("label").alias("lo"), F.max("label").alias("hi"),
                                            F.min("low").alias("all_low"))
    size = written(size.where("n_loose > 0 and lo < hi and not all_low")
                   .select("band", "step", F.ceil(F.col("n_all") / block).cast("int").alias("nb"), F.ceil(F.col("n_loose") / block).cast("int").alias("nl")), "open-sizes")
    rows = rows.join(size, ["band", "step"])
    right = F.pmod(F.xxhash64("sig", F.lit("all")), F.col("nb")).cast("int")
    left = F.pmod(F.xxhash64("sig", F.lit("loose")), F.col("nl")).cast("int")
    cols = ["sig", "label", "n", "low", "k"]
    part = F.xxhash64("band", "step", "i", "j").alias("part")
    small = rows.where("nb = 1").select(F.xxhash64("band", "step").alias("part"), *cols, F.when(F.col("loose"), 2).otherwise(1).alias("side"))
    many = rows.where("nb > 1")
    lhs = many.where("loose").withColumn("i", left).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(part, *cols, F.lit(0).alias("side"))
    rhs = many.withColumn("j", right).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nl") - 1))).select(part, *cols, F.lit(1).alias("side"))
    work = written(small.unionByName(lhs).unionByName(rhs), "open-parts")
    cols = ["part", "side", "sig", "label", "n", "low", "k"]

    def groups(rows: DataFrame) -> DataFrame:  # parts dealt to groups of about ``block`` rows
        with_registers = rows.join(classes.select("sig", "registers"), "sig")
        return with_registers.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(max(1, rows.count() // block))))

    some = groups(work).groupBy("g").applyInArrow(lambda t: _promising(t.select([*cols, "registers"])),
                                                  "part long, side int, sig long, label long, n long, low boolean, k tinyint")
    found = groups(written(some, "promising")).join(sets.select("sig", "grams"), "sig").groupBy("g").applyInArrow(
        lambda t: _compare(t.select([*cols, "registers", "grams"])), "a long, b long")
    return written(found, "rest-links")


def groups(docs: DataFrame, n: int = N, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, sig, component_id, kept): one row for each row of ``docs``; component_id is the smallest doc_id
    that links reach, its own for an empty set; kept: it is that row."""
    bounded_batches(docs.sparkSession)
    rows = written(sketched(docs, n), "sketched")
    every = bands(rows.where(F.col("registers").isNotNull()).groupBy("sig").agg(F.first("registers").alias("registers")))
    members = written(shared_bands(every), "members")
    sets = written(whole_sets(docs, written(members.select("sig").distinct(), "candidates"), n), "sets")
    classes = sets.select("sig", "n", "registers")
    star = _star_links(members.where("sig != leader").select("sig", "leader"), classes, sets)
    rows_open = _open(members, components(star).withColumnRenamed("v", "sig"))
    star = written(star.unionByName(_star_links(_second_ties(rows_open, star), classes, sets)), "star-links")
    rows_open = _open(rows_open, components(star).withColumnRenamed("v", "sig"))
    label = components(star.unionByName(_rest_links(rows_open, classes, sets, block))).withColumnRenamed("v", "sig")
    least = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("c0"))
    named = written(least.join(label, "sig", "left").withColumn("label", F.coalesce("label", "sig")), "named")
    ids = written(named.groupBy("label").agg(F.min("c0").alias("component_id")), "component-ids")
    by_sig = written(named.select("sig", "label").join(ids, "label").select(F.col("sig").alias("_s"), "component_id"), "component-ids")
    d = rows.select("doc_id", F.col("n").alias("n_shingles"), "sig", F.when(F.col("n") > 0, F.col("sig")).alias("_k"))
    d = d.join(by_sig, F.col("_k") == F.col("_s"), "left").select("doc_id", "n_shingles", "sig", F.coalesce("component_id", "doc_id").alias("component_id"))
    return d.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
