"""Hard negatives, whitening and SetSketch groups against brute force, with their edge cases."""
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.llm import negatives, queries, setsketch, whitening
from conftest import SF_MID

VECTORS = "vec_id long, label int, embedding array<float>"


def ints(v):
    return [int(np.floor(256.0 * np.float64(np.float32(c)))) for c in v]


def good(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 8)) * 2
    rows = [(i, int(rng.integers(0, 4)), (centre[i % 6] + rng.standard_normal(8) * 0.3).tolist()) for i in range(900)]
    rows += [(2000 + i, 1 + i % 2, [0.5] * 8) for i in range(300)]  # a vector that many rows have: ties
    rows += [(300, 2, rows[300][2]), (100, 3, None), (200, 0, [1.0, None] + [0.0] * 6), (400, 1, [float("nan")] * 8), (500, 1, [float("inf")] * 8),
             (600, None, [1.0] * 8), (None, 2, [0.5] * 8), (None, 1, rows[7][2]), (1000, 2, [0.0] * 8), (1100, 1, [1.5, -2.0]), (1200, 1, []), (1300, 9, [3.0] * 8)]
    return spark.createDataFrame(rows, VECTORS).withColumn("key", F.lit("extra")).withColumn("score", F.lit(1)).repartition(5)


def brute_negatives(rows):
    rows = [(r.vec_id, r.label, ints(r.embedding)) for r in rows if r.label is not None and good(r.embedding)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda t: (-t[1], t[0] is None, t[0] or 0)
    out = []
    for n, (i, lab, v) in enumerate(rows):
        if i is None or i % 100:
            continue
        score = [(j, dot(v, w), m) for m, (j, _, w) in enumerate(rows) if m != n]
        for p, ps, _ in sorted((s for s in score if rows[s[2]][1] == lab), key=order)[:5]:
            band = sorted((s for s in score if rows[s[2]][1] != lab and 30 * ps <= 100 * s[1] <= 90 * ps), key=order)[:10]
            out += [(i, p, k, j, ps, s) for k, (j, s, _) in enumerate(band, 1)]
    return sorted(out, key=str)


def test_hard_negatives_equal_brute_force(spark, vectors):
    want = brute_negatives(vectors.collect())
    assert len(want) > 100
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    for args in ({}, {"members": 2, "pieces": 2}):  # one block, and several
        got = negatives.mine(vectors, F.col("vec_id") % 100 == 0, **args)
        assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == want
    assert negatives.mine(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(vectors, F.lit(False)).count() == 0


def test_walks_end_before_the_list_does(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((20, 16))
    rows = [(i, i % 2, (centre[i % 20] + 0.02 * rng.standard_normal(16)).tolist()) for i in range(8000)]
    df = spark.createDataFrame(rows, VECTORS).coalesce(1)
    data = df.select(F.monotonically_increasing_id().alias("key"), "vec_id", F.col("label").cast("long").alias("label"), negatives.integers(F.col("embedding")).alias("v"))
    anchors, blocks = negatives.clustered_anchors(data, F.col("vec_id") % 100 == 0, clusters=20)
    block = spark.sparkContext.broadcast(negatives._block_of(anchors.collect()))
    found = negatives._best_positives(negatives.shared_lists(data, block), block, 5)
    assert blocks >= 1 and found.first().products < 0.5 * 80 * 8000


def test_a_bound_holds_every_members_scores():
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (500, 12)) * rng.integers(0, 2, (500, 1))
    piece = negatives._Piece(np.arange(40), v)
    norm, unit = negatives.directions(v)
    ub = negatives._bounds(piece, norm, unit, 12)
    assert (v[:40] @ v.T <= norm[:40, None] * ub[None, :] + 1e-6).all()


def test_components_of_qdwh_equal_eigenvectors():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 40):
        for values in (rng.random(n), np.arange(n) + 1.0, np.ones(n), 10.0 ** -np.arange(n).clip(0, 14), np.r_[5.0, np.zeros(n - 1)]):
            q, _ = np.linalg.qr(rng.standard_normal((n, n)))
            a = (q * values) @ q.T
            a = (a + a.T) / 2
            e, v = whitening.leading_components(a, 4)
            assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][:4], rtol=0, atol=1e-13)
            assert np.abs(a @ v - v * e).max() < 1e-13 and np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-13
            u = whitening.polar_factor(a + np.eye(n) * 0.37)
            assert np.abs(u @ u.T - np.eye(n)).max() < 1e-13


def test_whitening_equals_brute_force(spark, vectors):
    d = vectors.where("size(embedding) = 8 OR embedding IS NULL").withColumn("embedding", F.transform("embedding", lambda c: (c + 1000).cast("float")))  # far from the origin
    rows = [(r.vec_id, ints(r.embedding)) for r in d.collect() if good(r.embedding)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), object)
    n, s = len(fit), fit.sum(axis=0)
    y = ((fit * n - s) / n).astype(float)
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:4], v[:, ::-1][:, :4]
    got = whitening.whiten(d, whitening.fit(d, 4)).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and all(r.identity_error <= 1e-9 for r in got)
    want = defaultdict(list)
    for i, x in rows:
        want[i].append((sum((n * a - b) ** 2 for a, b in zip(x, s)), ((np.array(x, object) * n - s) / n).astype(float) @ v / np.sqrt(e)))
    for r in got:
        near = [w for dev, w in want[r.vec_id] if dev == r.deviation]
        assert any(abs(abs(w[r.component - 1]) - abs(r.whitened)) < 1e-9 for w in near)
        assert abs(r.explained / (e[r.component - 1] / np.trace(cov)) - 1) < 1e-9


def test_whitening_edge_cases(spark, vectors):
    none = vectors.limit(0)
    assert whitening.whiten(none, whitening.fit(none)).count() == 0
    one = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0])], VECTORS)
    got = whitening.whiten(one, whitening.fit(one)).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in got)
    line = spark.createDataFrame([(i, 0, [float(i), 2.0 * i]) for i in range(5)], VECTORS)
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got)
    wide = spark.createDataFrame([(1, 0, [3e30, 0.0]), (2, 0, [0.0, 1.0])], VECTORS)  # deviations beyond a long
    assert all(r.deviation is None for r in whitening.whiten(wide, whitening.fit(wide)).collect())
    assert whitening.whiten(vectors, whitening.fit(vectors)).count() > 0  # vectors of several lengths


def brute_groups(rows, k=2, hundredths=80):
    sets = []
    for t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and label[i] != label[j] and 100 * o >= hundredths * (len(a) + len(sets[j]) - o):
                label = [label[j] if x == label[i] else x for x in label]
    return sets, label


@pytest.fixture(scope="module")
def chained():
    """Copies of copies (chains), copies around one text, some beyond the threshold, short, empty, repeated texts."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    rows = []
    for n in (40, 90):
        w = [rng.choice(vocab) for _ in range(n)]
        for _ in range(25):
            w = list(w)
            for _ in range(max(1, n // 30)):
                w[rng.randrange(n)] = rng.choice(vocab)
            rows.append(" ".join(w))
        hub = list(w)
        for _ in range(25):
            c = list(hub)
            for _ in range(rng.randrange(1, n // 12 + 2)):
                c[rng.randrange(n)] = rng.choice(vocab)
            rows.append(" ".join(c))
    rows += [rows[3]] * 4 + [None, "", "  ", "one", "ONE", "one two", "One Two", " ".join(rng.choice(vocab) for _ in range(20_000))]
    rng.shuffle(rows)
    return rows


def test_setsketch_groups_equal_brute_force(spark, chained):
    sets, label = brute_groups(chained)
    docs = spark.createDataFrame(list(enumerate(chained)), "doc_id long, text string").withColumn("band", F.lit(1)).withColumn("label", F.lit("x")).repartition(6)
    least = {}
    for i, x in enumerate(label):
        least.setdefault(x, i)
    want = [(i, len(sets[i]), least[label[i]] if sets[i] else i) for i in range(len(chained))]
    got = setsketch.groups(docs, block=8).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert setsketch.groups(docs.limit(0)).count() == 0


def test_setsketch_null_and_repeated_ids(spark):
    d = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "x y z"), (7, None), (None, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in setsketch.groups(d).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True), (7, 7, True), (None, None, True)], key=str)


def test_the_comparison_finds_links_without_stars(spark, chained):
    """Every class loose, no star before: the last step alone must join what shares a band."""
    sets, label = brute_groups(chained)
    docs = spark.createDataFrame(list(enumerate(chained)), "doc_id long, text string")
    rows = setsketch.written(setsketch.sketched(docs), "t")
    classes = setsketch.written(rows.where("registers IS NOT NULL").groupBy("sig").agg(F.first("n").alias("n"), F.first("registers").alias("registers")), "t")
    members = setsketch.written(setsketch.bands(classes).withColumn("leader", F.col("sig")).withColumn("label", F.col("sig")), "t")
    full = setsketch.written(setsketch.whole_sets(docs, classes.select("sig")), "t")
    for block in (256, 8):  # one block a band, and several
        links = setsketch._rest_links(members, classes, full, block)
        got = {r.v: r.label for r in setsketch.components(links).collect()}
        sig = {r.doc_id: r.sig for r in rows.collect()}
        groups = defaultdict(set)
        for i, x in enumerate(label):
            if sets[i]:
                groups[x].add(sig[i])
        assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(k for k in got if got[k] == x) for x in set(got.values())}


def test_a_written_step_leaves_no_shuffle_files_and_restores_the_setting(spark):
    from pathlib import Path

    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {str(p) for p in local.rglob("shuffle_*.data")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = files(), spark.conf.get(key, None)
    t = setsketch.written(spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 1000).alias("x")).count(), "t")
    for _ in range(50):  # Spark removes them in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert t.count() == 1000 and spark.conf.get(key, None) == set_to
    spark.conf.set(key, "false")
    try:
        setsketch.written(spark.range(3), "t")
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.unset(key)


def test_groups_write_no_bands_and_no_sketches_of_lone_classes(spark, chained, monkeypatch):
    """Only the first scan's table has a row for each document's sketch; bands of all classes and lone classes' sketches aren't written."""
    tables, original = {}, setsketch.written

    def noted(df, name):
        out = original(df, name)
        tables.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(setsketch, "written", noted)
    lone = [" ".join(f"lone{i}x{j}" for j in range(30)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(chained + lone)), "doc_id long, text string")
    assert setsketch.groups(docs).where(f"doc_id >= {len(chained)} and not kept").count() == 0
    lone_sigs = {r.sig for r in setsketch.sketched(docs.where(f"doc_id >= {len(chained)}")).collect()}
    for name, found in tables.items():
        for t in found:
            if name != "sketched" and {"sig", "registers"} <= set(t.columns) or "band" in t.columns and "sig" in t.columns:
                assert not lone_sigs & {r.sig for r in t.select("sig").distinct().collect()}, name
    full = tables["sets"][0].collect()
    assert len(full) > 50 and all(r.n == len(r.grams) and r.registers == setsketch.sketches([np.array(r.grams, np.int64).view(np.uint64)])[0].tobytes() for r in full)


def test_shared_bands_are_those_of_several_classes(spark):
    rows = [(1, 0, 5), (1, 0, -3), (1, 0, 9), (2, 1, 5), (3, 0, 7), (3, 0, 8)]
    got = setsketch.shared_bands(spark.createDataFrame(rows, "band long, k tinyint, sig long")).select("band", "k", "sig", "leader").collect()
    assert sorted(map(tuple, got)) == [(1, 0, -3, -3), (1, 0, 5, -3), (1, 0, 9, -3), (3, 0, 7, 7), (3, 0, 8, 7)]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 2 ** 63, 5000).astype(np.uint64)
    for na, nb, o in ((1000, 1000, 800), (50, 60, 40), (3000, 900, 700), (5, 5, 4), (1, 1, 1)):
        j, est = o / (na + nb - o), []
        for t in range(30):
            v = setsketch.X.mix(u + np.uint64(t))
            a, b = setsketch.sketches([v[:na], v[na - o:na - o + nb]])
            assert (setsketch.sketches([np.union1d(v[:na], v[na - o:na - o + nb])])[0] == setsketch.merged(a, b)).all()
            est.append(setsketch.likely_jaccard(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([float(na)]), np.array([float(nb)]))[0])
        assert abs(np.mean(est) - j) < 4 * np.sqrt(max(j * (1 - j), 1e-4) / setsketch.REGISTERS / 30)


def test_sql_of_hard_negatives_and_groups(spark):
    import duckdb

    from helpers import assert_same
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    assert_same(queries.op11_hard_negatives(spark, SF_MID).toPandas(), con.execute(queries.OP11_SQL).df())
