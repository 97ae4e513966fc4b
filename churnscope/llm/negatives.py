"""Hard negatives of anchors by anchor-clustered shared lists (after MAXIMUS), exact.

A row's score is its integer inner product with the anchor. An anchor's positives are its best rows of
the same label; a pair's negatives are the best rows of other labels whose score lies in a band below
the positive's score.

1. Usable rows are written once as integer vectors, each with a row key (ids may repeat).
2. Anchors are clustered: directions of a bounded sample (``SAMPLE`` anchors) give at most ``CLUSTERS``
   centres, every anchor goes to its nearest one, and a cluster is cut into pieces of about ``MEMBERS``
   anchors. Pieces are dealt into blocks of a fixed number of pieces, so a block is bounded; one block at a
   time is broadcast, its tables are written, and its broadcast is destroyed.
3. Lists: one scan cuts the candidates into shards of at most ``SHARD`` rows, inside the tasks that read
   them. For each piece a shard is sorted once by the angular upper bound |x| * cos(max(0, angle(x, centre)
   - width)), where width is the largest angle of a member to the centre: no member's score exceeds its own
   norm times that. The shards are written with the order and the bounds of each piece's list.
4. Walks: all members of a piece walk the shared list together, in growing runs, first for the
   positives, then, when these are merged, for the negatives of each pair. What a task has found so far
   holds for its next shards. A walk ends for a member when the bound of what follows, times its norm, is
   below its worst kept score (or below the band): nothing that follows can enter. Equal scores may still
   enter by a smaller id, so a tie doesn't end a walk.
5. A task sends at most ``positives`` rows an anchor and ``negatives`` rows a pair; these are ranked.

No candidate is shuffled, and no label, vector or id is a shuffle key, so hot ones need no salt. Work per block is
one scan; there are (number of anchors) / (PIECES * MEMBERS) blocks.

Defined results: rows with a null label, a null vector, or a null or non-finite entry take no part. Rows
of one id are rows of their own: another row with the anchor's id can be its positive. A null id is never
an anchor and comes after all other ids in ties. Vectors of different lengths are compared as if
the shorter one were filled up with zeros; empty vectors score 0. An anchor without another row of its label
gives nothing, nor does a pair whose band is empty (as for negative positive scores). Products beyond a
long wrap around. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnscope.llm.store import scratch_path, written
from churnscope.llm.vectors import integers, matrix, products, usable

#: anchors that the centres are fitted on at most
SAMPLE = 4096
CLUSTERS = 32
MEMBERS = 256
#: pieces of a block
PIECES = 16
#: candidates of a shard at most
SHARD = 4096
#: candidates of the first run of a walk; each run is twice as long as the one before
RUN = 256
_LOWEST = np.iinfo(np.int64).min


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and unit vectors of the rows (a zero row stays zero)."""
    v = v.astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    return norm, v / np.where(norm > 0, norm, 1)[:, None]


def centres(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on the rows, started from rows far from each other."""
    _, unit = directions(v)
    k = min(k, len(unit))
    if not k:
        return np.zeros((0, v.shape[1]))
    c = unit[:1]
    for _ in range(k - 1):
        c = np.vstack([c, unit[np.argmin((unit @ c.T).max(axis=1))]])
    for _ in range(rounds):
        of = np.argmax(unit @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, of, unit)
        c = np.where(np.bincount(of, minlength=k)[:, None] > 0, directions(total)[1], c)
    return c


class _Piece:
    """Members of one shared list: their rows in the block, the centre and the width of the cone around it."""

    def __init__(self, at: np.ndarray, v: np.ndarray):
        self.at = at
        _, unit = directions(v[at])
        self.centre = directions(unit.sum(axis=0)[None])[1][0]
        cos = np.clip(unit @ self.centre, -1, 1)
        self.width = float(np.arccos(cos).max(initial=0)) + 1e-7


class _Block:
    """A bounded number of anchors with their pieces; the second walk also has the positives' scores."""

    def __init__(self, keys, ids, labels, v, piece):
        self.keys, self.ids, self.labels, self.v = keys, ids, labels, v
        self.norm, _ = directions(v)
        self.pieces = [_Piece(np.flatnonzero(piece == p), v) for p in np.unique(piece)]


def _bounds(piece: _Piece, norm: np.ndarray, unit: np.ndarray, dim: int) -> np.ndarray:
    """Angular upper bounds of the candidates' scores with a unit member of the piece, rounded up."""
    c = np.zeros(dim)
    c[:len(piece.centre)] = piece.centre
    angle = np.arccos(np.clip(unit @ c, -1, 1))
    ub = norm * np.cos(np.maximum(0, angle - piece.width))
    return ub + 1e-9 * norm


def _padded(v: np.ndarray, dim: int) -> np.ndarray:
    return v if v.shape[1] >= dim else np.hstack([v, np.zeros((len(v), dim - v.shape[1]), v.dtype)])


class _Best:
    """The first k (score, id) of each slot, by falling score, then id (null last)."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.kth = np.full(slots, _LOWEST)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.known = np.zeros(0, bool)

    def add(self, slot, score, ids, known):
        slot, score, ids = (np.concatenate([a, b]) for a, b in ((self.slot, slot), (self.score, score), (self.id, ids)))
        known = np.concatenate([self.known, known])
        order = np.lexsort((ids, ~known, -score, slot))
        s = slot[order]
        rank = np.arange(len(s)) - np.searchsorted(s, s)
        last = rank == self.k - 1
        self.kth[s[last]] = score[order[last]]
        order = order[rank < self.k]
        self.slot, self.score, self.id, self.known = slot[order], score[order], ids[order], known[order]


def _shards(batches):
    """Runs of at most SHARD candidates of the rows that a task reads: (keys, ids, known, labels, vectors)."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, SHARD):
            part = b.slice(at, SHARD)
            if n + part.num_rows > SHARD:
                yield _shard(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield _shard(held)


def _shard(held):
    t = pa.Table.from_batches(held).combine_chunks()
    col = lambda c: t.column(c).combine_chunks()
    known = col("vec_id").is_valid().to_numpy(zero_copy_only=False)
    lists = col("v")
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return col("key").to_numpy(), col("vec_id").fill_null(0).to_numpy(), known, col("label").to_numpy(), matrix(lists)


def shared_lists(rows: DataFrame, block) -> DataFrame:
    """One row for each shard: its candidates, and for each piece the order by falling upper bound with the bounds."""

    def build(batches):
        pieces = block.value.pieces
        for key, ids, known, label, v in _shards(batches):
            norm, unit = directions(_padded(v, block.value.v.shape[1]))
            orders, bounds = [], []
            for p in pieces:
                ub = _bounds(p, norm, unit, unit.shape[1])
                o = np.argsort(-ub, kind="stable")
                orders.append(o.astype(np.uint16))
                bounds.append(np.nextafter(ub[o].astype(np.float32), np.float32(np.inf)))
            kind = np.int16 if np.abs(v.astype(np.float64)).max(initial=0) < 2 ** 15 else np.int64
            raw = [key, ids, known, label, v.astype(kind), np.concatenate(orders), np.concatenate(bounds)]
            yield pa.RecordBatch.from_arrays([pa.array([len(key)], pa.int32()), pa.array([v.shape[1]], pa.int32()),
                                              *[pa.array([x.tobytes()], pa.binary()) for x in raw]],
                                             names=["n", "dim", "key", "ids", "known", "label", "v", "orders", "bounds"])

    return rows.select("key", "vec_id", "label", "v").mapInArrow(
        build, "n int, dim int, key binary, ids binary, known binary, label binary, v binary, orders binary, bounds binary")


def _unpacked(batches, pieces: int):
    for b in batches:
        for r in b.to_pylist():
            n = r["n"]
            get = lambda c, kind: np.frombuffer(r[c], kind)  # noqa: E731, B023
            v = get("v", np.int16 if len(r["v"]) == 2 * n * r["dim"] else np.int64).reshape(n, r["dim"]).astype(np.int64)
            yield (get("key", np.int64), get("ids", np.int64), get("known", bool), get("label", np.int64), v,
                   get("orders", np.uint16).reshape(pieces, n), get("bounds", np.float32).reshape(pieces, n))


def _walk(a: _Block, at: np.ndarray, shard, order: np.ndarray, bound: np.ndarray, floor, take) -> int:
    """All members ``at`` of a piece walk one list in growing runs; ``floor(members)`` is the score below which nothing
    is of use to each, ``take(members, scores, run)`` uses a run's scores. Returns the products made."""
    key, ids, known, label, v = shard
    dim = max(v.shape[1], a.v.shape[1])
    v, made, lo, size = _padded(v, dim), 0, 0, RUN
    while lo < len(order):
        useful = floor(at)
        most = a.norm[at] * (float(bound[lo]) + 1e-9 * abs(float(bound[lo]))) + 1e-6
        at = at[most >= useful]  # the others' walks have ended: all that follows is bounded by ``most``
        if not len(at):
            break
        run = order[lo:lo + size]
        take(at, products(_padded(a.v[at], dim), v[run]), run)
        made += len(at) * len(run)
        lo, size = lo + size, 2 * size
    return made


def _best_positives(lists: DataFrame, block, k: int) -> DataFrame:
    """(anchor, vec_id, score, products): the k best rows of the anchor's label that each task has seen."""

    def walk(batches):
        a: _Block = block.value
        best, made = _Best(len(a.keys), k), 0
        for key, ids, known, label, v, orders, bounds in _unpacked(batches, len(a.pieces)):
            for p, o, ub in zip(a.pieces, orders, bounds):
                def take(at, s, run):
                    ok = (a.labels[at][:, None] == label[run][None, :]) & (a.keys[at][:, None] != key[run][None, :])  # noqa: B023
                    i, j = np.nonzero(ok & (s >= best.kth[at][:, None]))
                    best.add(at[i], s[i, j], ids[run[j]], known[run[j]])  # noqa: B023
                made += _walk(a, p.at, (key, ids, known, label, v), o, ub, lambda at: best.kth[at].astype(np.float64), take)
        yield _found(best, made)

    return lists.mapInArrow(walk, "slot int, vec_id long, score long, products long")


def _found(best: _Best, made: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(best.slot.astype(np.int32)), pa.array(best.id, pa.int64(), mask=~best.known), pa.array(best.score),
                                       pa.array(np.full(len(best.slot), made, np.int64))], names=["slot", "vec_id", "score", "products"])


def _best_negatives(lists: DataFrame, block, scores, k: int, positives: int, low: int, high: int) -> DataFrame:
    """(slot, vec_id, score): for each pair (slot = anchor * positives + rank) the k best rows of other labels in the band."""

    def walk(batches):
        a: _Block = block.value
        ps, has = scores.value  # anchors x positives
        least = np.where(has, -((-low * ps) // 100), 1)  # the smallest and the largest integers of the band
        most = np.where(has, (high * ps) // 100, 0)
        has = has & (least <= most)
        best, made = _Best(ps.size, k), 0

        def floor(at):
            kth = best.kth.reshape(ps.shape)[at]
            return np.where(has[at], np.maximum(kth, least[at]).astype(np.float64), np.inf).min(axis=1, initial=np.inf)

        for key, ids, known, label, v, orders, bounds in _unpacked(batches, len(a.pieces)):
            for p, o, ub in zip(a.pieces, orders, bounds):
                def take(at, s, run):
                    other = a.labels[at][:, None] != label[run][None, :]  # noqa: B023
                    for q in range(positives):
                        slot = at * positives + q
                        ok = other & has[at, q][:, None] & (s >= least[at, q][:, None]) & (s <= most[at, q][:, None]) & (s >= best.kth[slot][:, None])
                        i, j = np.nonzero(ok)
                        best.add(slot[i], s[i, j], ids[run[j]], known[run[j]])  # noqa: B023
                made += _walk(a, p.at, (key, ids, known, label, v), o, ub, floor, take)
        yield _found(best, made)

    return lists.mapInArrow(walk, "slot int, vec_id long, score long, products long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block_of(rows: list) -> _Block:
    lists = pa.array([r.v for r in rows], pa.list_(pa.int64()))
    col = lambda c: np.array([r[c] for r in rows], np.int64)
    return _Block(col("key"), col("vec_id"), col("label"), matrix(lists), col("piece"))


def clustered_anchors(rows: DataFrame, anchor: Column, clusters: int = CLUSTERS, members: int = MEMBERS, pieces: int = PIECES) -> tuple[DataFrame, int]:
    """The anchors with piece and block numbers, written, and the number of blocks."""
    spark = rows.sparkSession
    chosen = rows.where(anchor & F.col("vec_id").isNotNull())
    sample = chosen.orderBy(F.xxhash64("key"), "key").select("v").limit(SAMPLE).collect()
    v = matrix(pa.array([r.v for r in sample], pa.list_(pa.int64())))
    shared = spark.sparkContext.broadcast(centres(v, min(clusters, -(-len(sample) // 16))))

    def nearest(batches):
        c = shared.value
        for b in batches:
            x = matrix(b.column("v"), c.shape[1])
            of = np.argmax(directions(x)[1][:, :c.shape[1]] @ c.T, axis=1) if len(c) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of.astype(np.int32))], names=[*b.schema.names, "cluster"])

    chosen = written(chosen.select("key", "vec_id", "label", "v").mapInArrow(nearest, "key long, vec_id long, label long, v array<long>, cluster int"), "anchors")
    sizes = {r.cluster: r["n"] for r in chosen.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``clusters`` rows
    cut = {c: -(-n // members) for c, n in sizes.items()}
    first = dict(zip(sorted(cut), np.cumsum([0, *[cut[c] for c in sorted(cut)]]).tolist()))
    if not sizes:
        return chosen.withColumns({"piece": F.lit(0), "block": F.lit(0)}), 0
    by = lambda d: F.element_at(F.create_map(*[F.lit(x) for c in sorted(d) if c in sizes for x in (c, int(d[c]))]), F.col("cluster"))
    piece = by(first) + F.pmod(F.xxhash64("key"), by(cut)).cast("int")
    out = chosen.withColumn("piece", piece).withColumn("block", F.floor(F.col("piece") / pieces).cast("int"))
    blocks = -(-sum(cut.values()) // pieces)
    return written(out, "anchors"), blocks


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, clusters: int = CLUSTERS,
         members: int = MEMBERS, pieces: int = PIECES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (vec_id, label, embedding);
    ``anchor`` says which rows are anchors; a negative's score lies between ``low`` and ``high`` hundredths of the positive's."""
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    rows = written(vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull())
                   .select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"),
                           F.col("label").cast("long").alias("label"), integers(F.col("embedding")).alias("v")), "vectors")
    anchors, blocks = clustered_anchors(rows, anchor, clusters, members, pieces)
    out = scratch_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for b in range(blocks):
        held = anchors.where(F.col("block") == b).collect()  # about ``pieces`` * ``members`` rows
        if not held:
            continue
        held = _block_of(held)
        block = sc.broadcast(held)
        lists = written(shared_lists(rows, block), "shared-lists")
        best = _ranked(_best_positives(lists, block, positives), positives).collect()  # at most ``positives`` rows an anchor
        ps, has = np.zeros((len(held.keys), positives), np.int64), np.zeros((len(held.keys), positives), bool)
        pid = [[None] * positives for _ in held.keys]
        for r in best:
            ps[r.slot, r.rank - 1], has[r.slot, r.rank - 1], pid[r.slot][r.rank - 1] = r.score, True, r.vec_id
        scores = sc.broadcast((ps, has))
        pairs = spark.createDataFrame([(i * positives + q, int(held.ids[i]), pid[i][q], int(ps[i, q])) for i in range(len(held.keys)) for q in range(positives) if has[i, q]],
                                      "slot int, anchor_id long, positive_id long, positive_score long")
        found = _ranked(_best_negatives(lists, block, scores, negatives, positives, low, high), negatives)
        (found.join(F.broadcast(pairs), "slot")  # at most ``positives`` rows an anchor of the block
         .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
         .write.mode("append").parquet(out))
        scores.destroy()
        block.destroy()
    return spark.read.schema(schema).parquet(out)
