"""Groups of near-duplicate texts: an exact n-gram Jaccard self-join by blocked sparse matrix products.

Two texts link when their sets of word n-grams have 100 * |A & B| >= 75 * |A | B|. Texts with equal
sets are one *class* (a row of the document by n-gram matrix), so copies are never paired.

1. All n-grams are counted, exactly: tasks send each class's n-gram keys, packed by ranges of keys. A task
   that holds a range sends back which keys of a run of texts occur in other classes too, and how often;
   copies of a class are told apart from others, and one of them speaks for the class.
2. Size bound: two linked sets share an n-gram among the first floor(n / 4) + 1 of each, in any fixed
   order. The order is by count, rare n-grams first, and n-grams of one class are dropped from these
   prefixes, so only texts with three quarters of shared content are left. (Any function of the n-gram
   gives a right order: key collisions cost time, not links. Keys have as many more bits as there
   are more partitions, so collisions don't become more frequent as the corpus grows.)
3. Classes that share a prefix n-gram form clusters: each is tied to the smallest class of the
   column, one row for each (class, n-gram), never one for each pair. A second scan writes the whole
   sets of clustered classes, which it knows by a bitmap of bounded size (a false hit costs a row).
4. In each cluster the incidence matrix is multiplied by its transpose in blocks of bounded size. The
   products are overlap counts; pairs below the size-derived bound are discarded, and a task
   returns a spanning forest of its links. Large clusters are first multiplied with a few pivots; what
   these join into one core needs no products within itself, only against the loose rest.
5. Connected components of the links.

No text is shuffled. Defined results: null or empty texts, and texts without words, have an empty
set and link with nothing; a text with fewer words than n has its whole word sequence as its only
n-gram; repeated rows are rows of one class and link; a null doc_id never names a component, unless
all of it is null; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm import text as X
from churnscope.llm.components import components
from churnscope.llm.store import bounded_batches, written

N = 5
#: bits of the bitmap of clustered classes at most
MARK_BITS = 28
#: n-grams of one block
BLOCK = 1 << 21
PIVOTS = 32
#: a table of (class, component) is broadcast up to this many rows
SMALL = 500_000
#: n-grams of a run of texts, about, and its texts at most (they are numbered by 16 bits)
_FLUSH = 1 << 21
_RUN = 1 << 16
#: smaller counts are exact, larger ones eighths of a binary logarithm
_EXACT = 128


def gram_sets(texts, n: int = N):
    """Yield (first row, sets) of runs of texts; a set is the sorted array of a text's distinct n-grams (64-bit hashes)."""
    for lo, buf, offs in X.chunks(texts):
        low = X.LOWER[buf]
        s, e, doc = X.word_spans(buf, offs, X.SPACED_WORD)
        h = X.word_hashes(low, s, e)
        g = X.grams(h, n)
        first = np.searchsorted(doc, np.arange(len(offs)))
        yield lo, [np.unique(g[a:b - n + 1]) if b - a >= n else X.grams(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)
                   for a, b in zip(first[:-1], first[1:])]


def _signature(u: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(X.mix(np.sum(X.mix(u ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)[None] + np.uint64(len(u))).view(np.int64)[0])


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed byte planes."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.ravel() for c in columns]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(n: int, data: bytes, *kinds) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds]
    raw = np.frombuffer(pa.decompress(data, n * sum(k.itemsize for k in kinds), codec="zstd", asbytes=True), np.uint8)
    ends = np.cumsum([0] + [n * k.itemsize for k in kinds])
    return [np.ascontiguousarray(raw[a:b].reshape(k.itemsize, n).T).view(k).ravel() for k, a, b in zip(kinds, ends, ends[1:])]


def _gaps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint32(0))


def _count_code(c: np.ndarray) -> np.ndarray:
    """Counts in one byte, in the same order: exact below ``_EXACT``."""
    return np.where(c < _EXACT, c, np.minimum(255, _EXACT + (8 * np.log2(np.maximum(c, _EXACT) / _EXACT)).astype(np.int64))).astype(np.uint8)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "run", "n", "data"])


def _held(batches, by: str) -> dict:
    """The packed rows (bucket, run, n, data) of a task by bucket or run."""
    held: dict = {}
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(r[batch.schema.get_field_index(by)], []).append(r)
    return held


def _shared_keys(rows: list[tuple]) -> list[tuple]:
    """Of each run's keys in this bucket those that occur more than once, with the text's number and the count's code."""
    parts = [_unpack(r[2], r[3], np.uint32, np.uint16) for r in rows]
    parts = [(np.cumsum(gap, dtype=np.uint32), text) for gap, text in parts]
    k = np.concatenate([key for key, _ in parts]).astype(np.uint64) << np.uint64(32)
    k = np.sort(k | np.arange(len(k), dtype=np.uint64))
    key, at = (k >> np.uint64(32)), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    c = np.diff(np.append(cut, len(key)))
    code = np.zeros(len(key), np.uint8)
    code[at] = np.repeat(np.where(c > 1, _count_code(c), 0).astype(np.uint8), c)
    out, lo = [], 0
    for (bucket, run, n, _), (key, text) in zip(rows, parts):
        hit = code[lo:lo + n]
        lo += n
        some = hit > 0
        if some.any():
            out.append((bucket, run, int(some.sum()), _pack(_gaps(key[some]), text[some], hit[some])))
    return out


def _one_of_each_class(rows: list[tuple]) -> list[tuple]:
    """The classes of this bucket, each once: the number of a text that has it, its signature, size and how many were sent."""
    parts = [_unpack(r[2], r[3], np.int64, np.uint16, np.uint32) for r in rows]
    sig, text, size = (np.concatenate(c) for c in zip(*parts))
    run = np.repeat(np.arange(len(rows)), [r[2] for r in rows])
    sig, first, times = np.unique(sig, return_index=True, return_counts=True)
    out = []
    for i in np.unique(run[first]):
        own = run[first] == i
        at = first[own]
        out.append((rows[i][0], rows[i][1], len(at), _pack(text[at], sig[own], size[at], times[own].astype(np.uint32))))
    return out


def _prefixes(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, start of each one's prefix, keys) of a run's classes that have three quarters of shared n-grams."""
    sizes, times, sigs = np.zeros(_RUN, np.int64), np.zeros(_RUN, np.int64), np.zeros(_RUN, np.int64)
    keys, texts, codes = [], [], []
    for bucket, _, n, data in rows:
        if bucket < 0:
            text, sig, size, many = _unpack(n, data, np.uint16, np.int64, np.uint32, np.uint32)
            sizes[text], times[text], sigs[text] = size, many, sig
        else:
            gap, text, code = _unpack(n, data, np.uint32, np.uint16, np.uint8)
            keys.append(np.cumsum(gap, dtype=np.uint32).astype(np.int64) + (bucket << 32))
            texts.append(text)
            codes.append(code)
    if not keys:
        return sigs[:0], np.zeros(1, np.int64), sigs[:0]
    key, text, code = np.concatenate(keys), np.concatenate(texts).astype(np.int64), np.concatenate(codes)
    # a key that occurs as often as its class was sent occurs in no other one
    other = (times[text] > 0) & ((code != times[text]) | (times[text] >= _EXACT))
    key, text, code = key[other], text[other], code[other]
    shared = np.bincount(text, minlength=_RUN)
    quota = np.where(times > 0, sizes // 4 + 1 - (sizes - shared), 0)
    order = np.lexsort((key, code, text))
    order = order[quota[text[order]] > 0]
    key, text = key[order], text[order]
    first = np.searchsorted(text, text)
    kept = np.arange(len(text)) - first < quota[text]
    at = np.unique(text[kept])
    return sigs[at], np.append(np.searchsorted(text[kept], at), kept.sum()), key[kept]


def candidates(docs: DataFrame, n: int = N) -> DataFrame:
    """(sig, prefix): the classes of which three quarters of the n-grams occur in other classes too, and the keys of the
    prefix's n-grams that do."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(16, max(6, math.ceil(math.log2(2 * parts))))  # buckets: ranges of keys, several a task

    def emit(batches):
        seen: set = set()
        task = np.uint64(TaskContext.get().partitionId() + 1)

        def flush(held, sigs, sizes):
            """The run's keys by bucket, and by buckets below zero its classes. The run's name follows from what is in it."""
            k = np.sort(np.concatenate(held))
            sig, size, text = np.array(sigs, np.int64), np.array(sizes, np.uint32), np.arange(len(sigs), dtype=np.uint16)
            with np.errstate(over="ignore"):
                run = int(np.sum(X.mix((sig.view(np.uint64) ^ X.mix(text.astype(np.uint64) + np.uint64(1))) + task), dtype=np.uint64).view(np.int64))
            ends = np.append(np.searchsorted(k, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(48)), len(k))
            rows, a = [], 0
            for bucket, b in enumerate(ends.tolist()):
                if a < b:
                    rows.append((bucket, run, b - a, _pack(_gaps((k[a:b] >> np.uint64(16)).astype(np.uint32)), k[a:b].astype(np.uint16))))
                a = b
            of = sig >> (64 - bits)
            for bucket in np.unique(of).tolist():
                own = of == bucket
                rows.append((-1 - (bucket & ((1 << bits) - 1)), run, int(own.sum()), _pack(sig[own], text[own], size[own])))
            return _packed(rows)

        held, sigs, sizes, size = [], [], [], 0
        for batch in batches:
            for _, sets in gram_sets(batch.column(0), n):
                for u in sets:
                    sig = _signature(u)
                    if sig in seen or not len(u):
                        continue  # a copy within the task
                    seen.add(sig)
                    held.append(((u >> np.uint64(32 - bits)) << np.uint64(16)) | np.uint64(len(sigs)))
                    sigs.append(sig)
                    sizes.append(len(u))
                    size += len(u)
                    if size >= _FLUSH or len(sigs) == _RUN:
                        yield flush(held, sigs, sizes)
                        held, sigs, sizes, size = [], [], [], 0
        if held:
            yield flush(held, sigs, sizes)

    def count(batches):
        for bucket, rows in _held(batches, "bucket").items():
            out = _shared_keys(rows) if bucket >= 0 else _one_of_each_class(rows)
            if out:
                yield _packed(out)

    def choose(batches):
        for rows in _held(batches, "run").values():
            sig, start, key = _prefixes(rows)
            if len(sig):
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(key))], names=["sig", "prefix"])

    kind = "bucket int, run long, n int, data binary"
    sent = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, kind)
    back = sent.repartition(parts, "bucket").mapInArrow(count, kind)
    return written(back.repartition(parts, "run").mapInArrow(choose, "sig long, prefix array<long>"), "candidates")


def clusters(cand: DataFrame) -> DataFrame:
    """(sig, cluster) of the classes that share a prefix n-gram with another one, directly or by a chain."""
    p = cand.select("sig", F.explode("prefix").alias("s"))
    first = p.groupBy("s").agg(F.min("sig").alias("b"), F.max("sig").alias("last")).where("b < last").select("s", "b")
    ties = p.join(first, "s").where("sig != b").select(F.col("sig").alias("a"), "b").distinct()
    return components(ties).select(F.col("v").alias("sig"), F.col("label").alias("cluster"))


def marks(sigs: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap): a bit is set if a signature begins with its number; at most 2**MARK_BITS of them."""
    bits = min(MARK_BITS, max(13, (16 * sigs.count()).bit_length()))
    lead = min(10, bits - 3)  # one row of the result: the bits of the numbers that begin alike
    span = 1 << (bits - lead)

    def build(batches):
        held: dict = {}
        for batch in batches:
            cell = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            of = (cell // np.uint64(span)).astype(np.int64)
            for b in np.unique(of).tolist():
                held.setdefault(b, np.zeros(span, np.uint8))[(cell[of == b] % np.uint64(span)).astype(np.int64)] = 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary())], names=["at", "v"])

    out = np.zeros((1 << bits) >> 3, np.uint8)
    parts = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sigs.select("sig").repartition(parts, F.shiftrightunsigned("sig", 64 - lead)).mapInArrow(build, "at int, v binary")
    for r in rows.collect():
        out[r["at"] * span // 8:(r["at"] + 1) * span // 8] = np.frombuffer(bytes(r.v), np.uint8)
    return bits, out


def incidence(docs: DataFrame, cl: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n, sig, grams): size and class of each row's set; for the first row of a clustered class in a task the whole set."""
    shared = docs.sparkSession.sparkContext.broadcast(marks(cl))

    def rows(batches):
        (bits, marked), seen = shared.value, set()
        for b, lo, sets in ((b, lo, sets) for b in batches for lo, sets in gram_sets(b.column(1), n)):
            sigs = [_signature(u) for u in sets]
            cell = np.array(sigs, np.int64).view(np.uint64) >> np.uint64(64 - bits)
            hit = (marked[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7)).astype(np.uint8))) & 1
            grams = []
            for u, sig, on in zip(sets, sigs, hit):
                new = on and len(u) and sig not in seen
                if new:
                    seen.add(sig)
                grams.append((u if new else u[:0]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in grams])]).astype(np.int32)),
                                             pa.array(np.concatenate([*grams, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(sets)), pa.array([len(u) for u in sets], pa.int64()), pa.array(sigs, pa.int64()), lists],
                                             names=["doc_id", "n", "sig", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(rows, f"doc_id {kind}, n long, sig long, grams array<long>")


class _Forest:
    def __init__(self, label: np.ndarray):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(label.tolist())]
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int):
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def _product(left: np.ndarray, right: np.ndarray, gram: np.ndarray, start: np.ndarray, size: np.ndarray, forest: _Forest):
    """Overlap counts of ``left`` rows with ``right`` rows, in blocks of rows and columns; linked pairs are joined."""
    for at in range(0, len(left), 512):
        a = left[at:at + 512]
        ga = np.concatenate([gram[start[i]:start[i + 1]] for i in a])
        ra = np.repeat(np.arange(len(a)), size[a])
        cols = np.unique(ga)
        ca = np.searchsorted(cols, ga)
        for bt in range(0, len(right), 2048):
            b = right[bt:bt + 2048]
            b = b[(4 * size[b] >= 3 * size[a].min()) & (3 * size[b] <= 4 * size[a].max())]
            if not len(b):
                continue
            gb = np.concatenate([gram[start[i]:start[i + 1]] for i in b])
            rb = np.repeat(np.arange(len(b)), size[b])
            cb = np.minimum(np.searchsorted(cols, gb), len(cols) - 1)
            ok = cols[cb] == gb
            rb, cb = rb[ok], cb[ok]
            over = np.zeros((len(a), len(b)), np.float32)
            order_a, order_b = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
            for c in range(0, len(cols), 4096):
                sa = order_a[slice(*np.searchsorted(ca[order_a], [c, c + 4096]))]
                sb = order_b[slice(*np.searchsorted(cb[order_b], [c, c + 4096]))]
                if not len(sb):
                    continue
                used, to = np.unique(cb[sb], return_inverse=True)  # columns that both sides have
                ja = np.minimum(np.searchsorted(used, ca[sa]), len(used) - 1)
                both = used[ja] == ca[sa]
                da, db = np.zeros((len(a), len(used)), np.float32), np.zeros((len(b), len(used)), np.float32)
                da[ra[sa[both]], ja[both]] = 1
                db[rb[sb], to] = 1
                over += da @ db.T
            o = over.astype(np.int64)
            for i, j in zip(*np.nonzero(175 * o >= 75 * (size[a][:, None] + size[b][None, :]))):
                forest.join(int(a[i]), int(b[j]))


def _linked(left, right, gram, start, size, label) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right`` rows; rows of one label count as joined."""
    f = _Forest(label)
    if len(right) > 4 * PIVOTS:  # pivots first; rows that they join into one core needn't meet each other
        _product(right[:PIVOTS], right, gram, start, size, f)
        roots = np.array([f.root(i) for i in range(len(label))])
        core = np.bincount(roots).argmax()
        left = left[roots[left] != core]
    if len(left):
        _product(left, right, gram, start, size, f)
    return f.links


def _links_in_group(table: pa.Table) -> pa.Table:
    """All links of a group of rows (cluster, side, sig, label, grams): side 0 against side 1, 2 against both."""
    table = table.combine_chunks()
    cluster = table.column("cluster").to_numpy()
    order = np.lexsort((table.column("sig").to_numpy(), cluster))
    out_a, out_b = [], []
    cluster = cluster[order]
    cuts = np.flatnonzero(np.diff(cluster, prepend=cluster[0] - 1 if cluster[0] > -2**62 else cluster[0] + 1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        part = table.take(pa.array(order[a:b])).combine_chunks()
        sig, side, label = (part.column(c).to_numpy() for c in ("sig", "side", "label"))
        lists = part.column("grams").chunk(0)
        off = lists.offsets.to_numpy().astype(np.int64)
        gram, start = lists.values.to_numpy(), off
        for i, j in _linked(np.flatnonzero(side != 1), np.flatnonzero(side != 0), gram, start, np.diff(off), label):
            if sig[i] != sig[j]:
                out_a.append(sig[i])
                out_b.append(sig[j])
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _multiply(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).applyInArrow(lambda t: _links_in_group(t.select(["cluster", "side", "sig", "label", "grams"])), "a long, b long")


def links(inc: DataFrame, cl: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between classes that connect all that are linked (a spanning forest of each product)."""
    sets = inc.where(F.size("grams") > 0).groupBy("sig").agg(F.first("grams").alias("grams"))
    sets = written(sets.join(cl, "sig").select("cluster", "sig", F.col("sig").alias("label"), "grams"), "sets")
    size = sets.groupBy("cluster").agg(F.sum(F.size("grams")).alias("grams_all"), F.count(F.lit(1)).alias("rows"))
    size = written(size.withColumn("nb", F.ceil(F.col("grams_all") / block).cast("int")), "cluster-sizes")
    total = size.agg(F.sum("grams_all")).first()[0] or 0
    groups = max(1, total // (block // 4))
    one = size.where("nb = 1").select("cluster")
    small = sets.join(one, "cluster", "left_semi").withColumns({"side": F.lit(2), "g": F.pmod(F.xxhash64("cluster"), F.lit(groups))})
    found = [written(_multiply(small, "g"), "links")]
    if size.where("nb > 1").head(1):
        big = written(sets.join(size.where("nb > 1").select("cluster", "nb", "rows"), "cluster"), "large-clusters")
        found += _large(big, block)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _large(big: DataFrame, block: int) -> list[DataFrame]:
    """Links of clusters of several blocks: pivots against all blocks, then the loose rows against all blocks."""
    own = F.pmod(F.xxhash64("sig", F.lit("block")), F.col("nb")).cast("int")
    cols = ["cluster", "sig", "label", "grams"]
    chance = F.pmod(F.xxhash64("sig", F.lit("pivot")), F.col("rows"))
    pivots = big.where(chance < PIVOTS).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(*cols, "j", F.lit(0).alias("side"))
    every = big.select(*cols, own.alias("j"), F.lit(1).alias("side"))
    a = written(_multiply(pivots.unionByName(every), "cluster", "j"), "links")
    lab = components(a).withColumnsRenamed({"v": "sig", "label": "far"})
    rows = written(big.join(lab, "sig", "left").withColumn("label", F.coalesce("far", "label")).drop("far"), "large-clusters")
    core = rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("core"))
    rows = rows.join(core, "cluster")
    loose = rows.where("label != core")
    nl = loose.groupBy("cluster").agg(F.ceil(F.sum(F.size("grams")) / block).cast("int").alias("nl"))
    loose = loose.join(nl, "cluster")
    i = F.pmod(F.xxhash64("sig", F.lit("loose")), F.col("nl")).cast("int")
    lhs = loose.select(*cols, "nb", i.alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(*cols, "i", "j", F.lit(0).alias("side"))
    rhs = rows.join(nl, "cluster").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nl") - 1))).select(*cols, "i", own.alias("j"), F.lit(1).alias("side"))
    return [a, written(_multiply(lhs.unionByName(rhs), "cluster", "i", "j"), "links")]


def groups(docs: DataFrame, n: int = N, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, sig, component_id): one row for each row of ``docs``; component_id is the smallest
    doc_id that links reach, its own for an empty set."""
    bounded_batches(docs.sparkSession)
    cl = clusters(candidates(docs, n))
    inc = written(incidence(docs, cl, n), "incidence")
    lab = components(links(inc, cl, block)).withColumnsRenamed({"v": "sig"})
    classes = inc.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("c0"))
    named = written(classes.join(lab, "sig", "left").withColumn("label", F.coalesce("label", "sig")), "classes")
    least = named.groupBy("label").agg(F.min("c0").alias("c"))
    by_sig = written(named.join(least, "label").select("sig", F.col("c").alias("component_id")), "component-ids")
    small = by_sig.count() <= SMALL
    d = inc.select("doc_id", F.col("n").alias("n_shingles"), "sig", F.when(F.col("n") > 0, F.col("sig")).alias("_k"))
    by_sig = by_sig.withColumnRenamed("sig", "_s")
    d = d.join(F.broadcast(by_sig) if small else by_sig, F.col("_k") == F.col("_s"), "left")
    return d.select("doc_id", "n_shingles", "sig", F.coalesce("component_id", "doc_id").alias("component_id"))
