"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into pieces (up to the next sentence or line end, ``PIECE`` characters at most); the
digests of its distinct pieces go into a sketch of TABLES x CELLS cells of (count, XOR of digests,
XOR of check hashes), one cell in each table. The sketch is the fingerprint. Two versions are
compared by subtracting their sketches and peeling: a cell with count +1 or -1 whose check hash fits
holds one differing digest, which is taken out of its other cells, until nothing is left. When a
sketch is too small to be emptied, the comparison is retried with a larger one, ROOM cells for each
digest of the two versions in each table, of which only the cells in use are kept. Where that one
isn't emptied either (digests that share their cells in all tables), the digests of the two versions
are compared themselves. The number of digests on either side gives the likeness (digests in both / digests in either).

DataFrame functions only. Defined results: a null or empty text has no pieces; two empty texts have
likeness 1; a null id sorts first; repeated ids are taken in the order of their texts' hashes; the
only document is its own next one; an empty table gives no rows; columns of the input other than
id and text don't come along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.store import written

TABLES = 3
CELLS = 6
ROUNDS = 5
#: cells a digest in each table of the larger sketch
ROOM = 16
RETRIES = 6
PIECE = 128
_PATTERN = r"(?s)[^\n.!?]{1,%d}[\n.!?]*|[\n.!?]+" % PIECE
_CELL = "struct<n:int,key:bigint,chk:bigint>"


def digests(text: Column) -> Column:
    """Distinct digests of the pieces of a text."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _cell_of(d: Column, table: int, cells: int) -> Column:
    return F.pmod(F.shiftrightunsigned(d, 20 * table), F.lit(cells))


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def _cells(items: Column, cells: int, add) -> Column:
    """All cells, table by table; ``add``(cell, item) puts an item into its cell."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("chk"))

    def table(t: int) -> Column:
        placed = F.transform(items, lambda x: F.struct(_cell_of(x["d"], t, cells).alias("j"), x["s"].alias("s"), x["d"].alias("d"), _check(x["d"]).alias("k")))
        # bound as a lambda variable: each item's cell is found once
        return F.transform(F.array(placed), lambda p: F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")),
            lambda j: F.aggregate(F.filter(p, lambda x: x["j"] == j), empty, add)))[0]

    return F.concat(*[table(t) for t in range(TABLES)])


def _added(c: Column, x: Column) -> Column:
    return F.struct((c["n"] + x["s"]).alias("n"), c["key"].bitwiseXOR(x["d"]).alias("key"), c["chk"].bitwiseXOR(x["k"]).alias("chk"))


def sketch(digs: Column, cells: int = CELLS) -> Column:
    """Sketch of an array of digests."""
    return _cells(F.transform(digs, lambda d: F.struct(F.lit(1).alias("s"), d.alias("d"))), cells, _added)


def encoded(cells: Column) -> Column:
    """The fingerprint as text: count, digests and checks of each cell in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"].cast("long")), F.hex(c["key"]), F.hex(c["chk"]))), "-")


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["chk"].bitwiseXOR(y["chk"]).alias("chk")))


def _zero(c: Column) -> Column:
    return (c["n"] == 0) & (c["key"] == 0) & (c["chk"] == 0)


def peel(diff: Column, cells: int = CELLS, rounds: int = ROUNDS) -> Column:
    """struct(only_a, only_b): how many digests are on one side only; null if the sketch can't be emptied."""

    def one(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(
            F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["chk"])),
            lambda c: F.struct(c["n"].alias("s"), c["key"].alias("d"))))
        # bound as a lambda variable, so the cells are searched once a round
        return F.transform(F.array(pure), lambda found: F.struct(
            F.when(F.size(found) == 0, state["cells"]).otherwise(_without(state["cells"], found, cells)).alias("cells"),
            (state["a"] + F.size(F.filter(found, lambda x: x["s"] > 0))).alias("a"),
            (state["b"] + F.size(F.filter(found, lambda x: x["s"] < 0))).alias("b")))[0]

    start = F.struct(diff.cast(f"array<{_CELL}>").alias("cells"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one,
                       lambda s: F.when(F.forall(s["cells"], _zero), F.struct(s["a"].alias("only_a"), s["b"].alias("only_b"))))


def _peel_if_sparse(diff: Column) -> Column:
    """peel(), unless every cell is in use: so full a sketch can't be emptied."""
    return F.transform(F.array(diff), lambda d: F.when(F.exists(d, lambda c: (c["n"] == 0) & (c["key"] == 0)), peel(d)))[0]


def _without(cells: Column, found: Column, size: int) -> Column:
    def cell(c: Column, i: Column) -> Column:
        mine = F.filter(found, lambda x: F.when(i < size, _cell_of(x["d"], 0, size)).when(i < 2 * size, _cell_of(x["d"], 1, size) + size)
                        .otherwise(_cell_of(x["d"], 2, size) + 2 * size) == i)
        return F.aggregate(mine, c, lambda a, x: F.struct((a["n"] - x["s"]).alias("n"), a["key"].bitwiseXOR(x["d"]).alias("key"), a["chk"].bitwiseXOR(_check(x["d"])).alias("chk")))

    return F.transform(cells, cell)


def likeness(n_a: Column, only_a: Column, only_b: Column) -> Column:
    both, either = n_a - only_a, n_a + only_b
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _place(d: Column, t: Column, m: Column) -> Column:
    """Cell number of a digest in table t (0 to TABLES - 1) of a sketch with m cells a table."""
    return F.pmod(F.xxhash64(d, t, F.lit("roomy")), m) * 4 + t


def _crowded(a: Column, b: Column) -> Column:
    """If a digest shares its cell of the larger sketch with another one in every table. Where none does, the first
    round of peeling finds all of them."""
    m, u = F.lit(ROOM) * (F.size(a) + F.size(b)).cast("long"), F.array_union(a, b)

    def shared(t: int) -> Column:
        cells = F.sort_array(F.transform(u, lambda d: _place(d, F.lit(t), m)))
        return F.transform(F.array(cells), lambda c: F.filter(c, lambda x, i: x == F.get(c, i - 1)))[0]

    # bound as a lambda variable: the shared cells are found once
    return F.transform(F.array(F.struct(*[shared(t).alias(f"t{t}") for t in range(TABLES)])), lambda s: F.exists(
        u, lambda d: F.forall(F.array(*[F.array_contains(s[f"t{t}"], _place(d, F.lit(t), m)) for t in range(TABLES)]), lambda x: x)))[0]


def larger(rows: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(keys, pair, only_a, only_b) for pairs of digest columns, by sketches of ROOM cells a digest in each table;
    only_a and only_b are null where the sketch can't be emptied.

    Only cells that aren't empty are kept, as rows. Cells that hold one digest give it up at once; where the
    digests so found don't add up to the whole difference, they are taken out of the other cells and peeling
    goes on. Aggregates by ``keys`` and more, so rows that are dealt out by some of the keys aren't moved."""
    x = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate(pairs)])).alias("p"))
    signed = F.concat(F.transform("p.a", lambda d: F.struct(F.lit(1).alias("s"), d.alias("d"))),
                      F.transform("p.b", lambda d: F.struct(F.lit(-1).alias("s"), d.alias("d"))))
    m = F.lit(ROOM) * (F.size("p.a") + F.size("p.b")).cast("long")
    x = x.select(*keys, F.col("p.pair").alias("pair"), m.alias("m"), F.explode(signed).alias("x"))
    x = x.select(*keys, "pair", "m", F.col("x.s").alias("s"), F.col("x.d").alias("d"), F.explode(F.array(*[F.lit(t) for t in range(TABLES)])).alias("t"))
    x = x.withColumns({"cell": _place(F.col("d"), F.col("t"), F.col("m")), "chk": _check(F.col("d"))})
    keys = [*keys, "pair", "m"]
    cells = x.groupBy(*keys, "cell").agg(F.sum("s").alias("n"), F.bit_xor("d").alias("key"), F.bit_xor("chk").alias("chk"))
    cells = cells.where("n != 0 OR key != 0 OR chk != 0")
    pure = (F.abs("n") == 1) & (_check(F.col("key")) == F.col("chk"))
    cells = cells.withColumn("pure", pure).withColumn("id", F.when(F.col("pure"), F.col("key")).otherwise(F.col("cell")))
    first = F.bit_xor(F.when(F.pmod("cell", F.lit(4)) == 0, F.col("key")).otherwise(F.lit(0).cast("long")))
    # the cells that hold the same single digest become one row; a cell of several stays a row
    g = cells.groupBy(*keys, "pure", "id").agg(F.max("n").alias("n"), first.alias("z"), F.max("key").alias("key"), F.max("chk").alias("chk"))
    is_pure = F.col("pure")
    g = g.groupBy(*keys).agg(
        F.bit_xor("z").alias("all"), F.bit_xor(F.when(is_pure, F.col("id")).otherwise(F.lit(0).cast("long"))).alias("got"),
        F.collect_list(F.when(is_pure, F.struct(F.col("n").alias("s"), F.col("id").alias("d")))).alias("found"),
        F.collect_list(F.when(~is_pure, F.struct(F.col("id").alias("cell"), "n", "key", "chk"))).alias("rest"))
    found = lambda c, s: F.size(F.filter(c, lambda x: x["s"] == s))
    nothing = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    more = F.when(F.col("all") != F.col("got"), _peel_rest(F.col("found"), F.col("rest"), F.col("m"))).otherwise(nothing)
    g = g.withColumn("more", more)
    return g.select(*keys[:-1], (found("found", 1) + F.col("more.a")).alias("only_a"), (found("found", -1) + F.col("more.b")).alias("only_b"))


def _peel_rest(found: Column, rest: Column, m: Column) -> Column:
    """struct(a, b): digests of either side that further rounds of peeling find in the cells of several digests;
    null if cells are left."""

    def taken(cell: Column, new: Column) -> Column:
        t = F.pmod(cell["cell"], F.lit(4)).cast("int")
        return F.aggregate(F.filter(new, lambda x: _place(x["d"], t, m) == cell["cell"]), cell, lambda c, x: F.struct(
            c["cell"].alias("cell"), (c["n"] - x["s"]).alias("n"), c["key"].bitwiseXOR(x["d"]).alias("key"), c["chk"].bitwiseXOR(_check(x["d"])).alias("chk")))

    def one(state: Column, _: Column) -> Column:
        left = F.transform(state["rest"], lambda c: taken(c, state["new"]))
        return F.transform(F.array(left), lambda cells: F.transform(F.array(F.array_distinct(F.transform(
            F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["chk"])),
            lambda c: F.struct(c["n"].alias("s"), c["key"].alias("d"))))), lambda new: F.struct(
                cells.alias("rest"), new.alias("new"),
                (state["a"] + F.size(F.filter(new, lambda x: x["s"] == 1))).alias("a"),
                (state["b"] + F.size(F.filter(new, lambda x: x["s"] == -1))).alias("b")))[0])[0]

    start = F.struct(rest.alias("rest"), found.alias("new"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), start, one, lambda s: F.when(
        F.forall(s["rest"], _zero), F.struct(s["a"].alias("a"), s["b"].alias("b"))))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds below a value, by binary search over a constant array."""
    n = 1 << math.ceil(math.log2(len(bounds) + 1))
    b = F.array(*[F.lit(x).cast("long") for x in bounds + [(1 << 63) - 1] * (n - 1 - len(bounds))])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length() - 1))]) if n > 1 else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, h: F.when(F.element_at(b, at + h) < value, at + h).otherwise(at))


def with_next(docs: DataFrame, partitions: int, key: str = "doc_id") -> DataFrame:
    """(_part, _row, doc_id, text, digests, next_text, next_digests): each document beside the next one by id.

    Ids are cut into ranges by approximate quantiles; a range is one window. The first document of a
    range is also put at the end of the range before (of the last range for the very first)."""
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    d = d.withColumn("_k", k)
    n = 1 << max(0, math.ceil(math.log2(partitions)))
    bounds = d.agg(F.percentile_approx("_k", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or [0]
    # the plan holds the bounds as a constant, so all uses of the result are the same plan and share its exchange
    d = d.withColumn("_part", _range_of(F.col("_k"), bounds))
    firsts = d.groupBy("_part").agg(F.min("_k").alias("_k"))  # one row a range
    w = Window.partitionBy(F.lit(1)).orderBy("_part")
    far = F.max("_part").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = written(firsts.select(F.col("_k").alias("_first"), F.coalesce(F.lag("_part").over(w), far).alias("_before")), "range-firsts")
    d = d.join(F.broadcast(firsts), F.col("_k") == F.col("_first"), "left")
    places = F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("e")))
    places = F.when(F.col("_before").isNull(), places).otherwise(F.concat(places, F.array(F.struct(F.col("_before").alias("p"), F.lit(1).alias("e")))))
    d = d.select("doc_id", "text", "_k", F.explode(places).alias("_at")).select("doc_id", "text", "_k", 
                                                                          # never null: joins by it then push no filter below the exchange
                                                                          F.coalesce("_at.p", F.lit(0)).alias("_part"), F.coalesce("_at.e", F.lit(0)).alias("_extra"))
    d = d.repartition("_part")
    d = d.withColumn("digests", digests(F.col("text")))
    w = Window.partitionBy("_part").orderBy("_extra", "_k", F.xxhash64("text"))
    nxt = F.lead(F.struct("text", "digests")).over(w)
    d = d.withColumn("_n", nxt).withColumn("_row", F.row_number().over(w)).where("_extra = 0")
    return d.select("_part", "_row", "doc_id", "text", "digests", F.col("_n.text").alias("next_text"), F.col("_n.digests").alias("next_digests"))


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: the fingerprint
    of each text, of its edited text (last quarter replaced by the start of the next document), and the
    likeness of the text's fingerprint to the edited one's and to the next document's."""
    spark = docs.sparkSession
    d = with_next(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - q), F.substring("next_text", F.lit(1), q))
    d = d.withColumn("edited", edited).withColumn("edited_digests", digests(F.col("edited")))
    keys = ["_part", "_row"]
    # doc_id is a key here only so that both uses of ``d`` read the same columns: its texts are dealt out once
    again = larger(d, [*keys, "doc_id"], [("digests", "edited_digests"), ("digests", "next_digests")])
    again = again.groupBy(*keys).agg(*[F.max(F.when(F.col("pair") == i, F.col(f"only_{x}"))).alias(f"{x}{i}") for i in (0, 1) for x in "ab"])
    cells = d.withColumns({"_c": sketch(F.col("digests")), "_e": sketch(F.col("edited_digests")), "_x": sketch(F.col("next_digests"))})
    out = cells.select(*keys, "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.size("digests").alias("_size"),
                       encoded(F.col("_c")).alias("fingerprint"), encoded(F.col("_e")).alias("edited_fingerprint"),
                       _peel_if_sparse(subtract(F.col("_c"), F.col("_e"))).alias("_p0"), _peel_if_sparse(subtract(F.col("_c"), F.col("_x"))).alias("_p1"),
                       # the digests come along only where the larger sketch may fail
                       *[F.when(_crowded(F.col("digests"), F.col(x)), F.struct(F.col("digests").alias("a"), F.col(x).alias("b"))).alias(f"_d{i}") for i, x in enumerate(("edited_digests", "next_digests"))])
    out = out.join(again, keys, "left")
    alone = lambda i, a, b: F.size(F.array_except(f"_d{i}.{a}", f"_d{i}.{b}"))
    near = lambda i: likeness(F.col("_size"), F.coalesce(f"_p{i}.only_a", f"a{i}", alone(i, "a", "b")), F.coalesce(f"_p{i}.only_b", f"b{i}", alone(i, "b", "a")))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near(0).alias("near_edited"), near(1).alias("near_next"))
