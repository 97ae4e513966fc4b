"""The corpus operators against brute force, and their edge cases: nulls, empty and long texts, repeated rows,
empty tables, extra columns with clashing names."""
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from churnscope.llm import decontam, fingerprints, jaccard, langid, linear, mixing, pii, quality, secrets, toxicity, urls
from churnscope.llm.components import components
from churnscope.llm.store import scratch_path
from conftest import SF_SMALL

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(pattern, text):
    return re.findall(pattern, (text or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(60)]
    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))
    base, rows = prose(60), []
    for i in range(40):  # near copies of one text, some of them too far
        w = base.split()
        for _ in range(i % 6):
            w[rng.randrange(60)] = "x%d" % rng.randrange(1000)
        rows.append(" ".join(w))
    rows += [base] * 5 + [prose(rng.randrange(1, 80)) for _ in range(20)]
    rows += [None, "", "   ", "one two", "One TWO", prose(30_000), "\n.!?", "é" * 7]
    out = [(i, t, "en" if i % 2 else "fr", f"s{i % 3 if i % 5 else 0}", None if t is None else len(t)) for i, t in enumerate(rows)]
    out += [(3, rows[3], None, None, 1), (None, "null id text " + prose(20), "en", None, None)]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_groups_equal_brute_force(spark, docs, none):
    rows = docs.select("doc_id", "text").collect()
    def shingles(t):
        w = words(r"[^\x20\x09-\x0D]+", t)
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    sets = [shingles(r.text) for r in rows]
    up = list(range(len(rows)))
    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and 100 * o >= 75 * len(a | sets[j]):
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            ids[root(i)].append(r.doc_id)
    want = sorted(((r.doc_id, len(s), min(ids[root(i)]) if s and ids[root(i)] else r.doc_id) for i, (r, s) in enumerate(zip(rows, sets))), key=str)
    for block in (jaccard.BLOCK, 500):  # one block a cluster, and several
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(docs, block=block).collect()]
        assert sorted(got, key=str) == want
    assert jaccard.groups(none).count() == 0


def _planted(spark):
    """Texts of their own, some also as copies in other partitions (one very often), and five pairs of near copies."""
    rng = random.Random(8)
    def prose(n=80):
        return " ".join("w%d" % rng.randrange(100_000) for _ in range(n))
    own, near = [prose() for _ in range(200)], [prose() for _ in range(5)]
    near += [" ".join(["new", *t.split()[1:]]) for t in near]
    half = [" ".join(own[i].split()[:40]) + " " + prose(40) for i in range(150, 160)]
    rows = own + own[:50] + own[:20] + [own[100]] * 140 + near + half + ["few words", "few words", None]
    rows = [(i % 7, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, p int, text string")
    return df.repartitionByRange(7, "p").checkpoint().select("doc_id", "text"), own, near


def test_jaccard_candidates_are_the_classes_that_share_three_quarters(spark, monkeypatch):
    df, own, near = _planted(spark)
    texts = sorted({r.text for r in df.collect() if r.text})
    sets = {jaccard._signature(u): set(u.tolist()) for _, us in jaccard.gram_sets(pa.array(texts)) for u in us}
    holders = defaultdict(int)
    for u in sets.values():
        for g in u:
            holders[g] += 1
    alone = {sig: sum(holders[g] == 1 for g in u) for sig, u in sets.items()}
    want = {sig: len(u) // 4 + 1 - alone[sig] for sig, u in sets.items() if 4 * alone[sig] <= len(u)}
    for flush in (jaccard._FLUSH, 300):  # one run a task, and many
        monkeypatch.setattr(jaccard, "_FLUSH", flush)
        got = jaccard.candidates(df).collect()
        assert len(got) == len({r.sig for r in got})
        assert {r.sig: len(r.prefix) for r in got} == want and len(want) == 10


def test_jaccard_writes_the_sets_of_clustered_classes_only(spark, monkeypatch):
    """Texts that share little, and copies of them in other tasks, are never written, however many n-grams the corpus has:
    no table of fixed size decides it (a bitmap of few bits, which many n-grams fill, held all of these texts)."""
    df, own, near = _planted(spark)
    tables = {}
    def kept(d, name):
        tables[name] = real(d, name)
        return tables[name]
    real = jaccard.written
    monkeypatch.setattr(jaccard, "written", kept)
    monkeypatch.setattr(jaccard, "KEY_BITS", 8, raising=False)
    g = jaccard.groups(df).collect()
    assert 10 <= tables["incidence"].where("size(grams) > 0").count() <= 12  # a false hit of the bitmap is allowed
    linked = defaultdict(set)
    for r in g:
        linked[r.component_id].add(r.doc_id)
    copies = defaultdict(set)
    of = {t: i % 5 for i, t in enumerate(near)}
    for r in df.collect():
        copies[r.doc_id if r.text is None else of.get(r.text, r.text)].add(r.doc_id)
    assert sorted(map(sorted, linked.values())) == sorted(map(sorted, copies.values()))


def test_pipeline_near_duplicates_write_no_sets_of_texts_of_their_own(spark, monkeypatch):
    df, own, near = _planted(spark)
    tables, real = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda d, name: tables.setdefault(name, real(d, name)))
    kept = corpus_pipeline.drop_near_duplicates(spark, df, None)
    rows = df.collect()
    first: dict = {}
    of = {t: i % 5 for i, t in enumerate(near)}
    for r in sorted(rows):
        first.setdefault(r.doc_id if r.text is None else of.get(r.text, r.text), r.doc_id)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    assert 10 <= tables["incidence"].where("size(grams) > 0").count() <= 12


def test_packed_columns_come_back(spark):
    rng = np.random.default_rng(1)
    k = np.sort(rng.integers(0, 1 << 32, 1000, dtype=np.uint32))
    t, c = rng.integers(0, 1 << 16, 1000).astype(np.uint16), np.arange(1000, dtype=np.int64)
    gap, text, count = jaccard._unpack(1000, jaccard._pack(jaccard._gaps(k), t, c), np.uint32, np.uint16, np.int64)
    assert (np.cumsum(gap, dtype=np.uint32) == k).all() and (text == t).all() and (count == c).all()
    code = jaccard._count_code(np.arange(1, 1 << 20))
    assert (code[:127] == np.arange(1, 128)).all() and (np.diff(code.astype(int)) >= 0).all() and code[127] == 128


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    assert {(r.v, r.label) for r in components(links).collect()} == {(i, 1) for i in range(1, 61)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("block_rows", [200_000, 7])
def test_decontamination_equals_brute_force(spark, docs, none, block_rows):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = docs.select("doc_id", "text").collect()
    items = [(1, " ".join(rows[0].text.split()[5:35])), (2, "ONE, two!"), (3, " ".join(rows[50].text.split()[:3])), (4, None), (None, rows[60].text or "z"), (5, rows[0].text)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = words(pattern, t)
        m = min(13, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[a:a + m])].add("" if i is None else str(i))
    want = []
    for r in rows:
        w, hit, found = words(pattern, r.text), set(), set()
        for m in {len(x) for x in windows}:
            for a in range(len(w) - m + 1):
                if tuple(w[a:a + m]) in windows:
                    hit.update(range(a, a + m))
                    found |= windows[tuple(w[a:a + m])]
        want.append((r.doc_id, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    d = decontam.contamination(docs.withColumn("items", F.lit("clash")), bench, block_rows=block_rows)
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in d.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_decontamination_by_join_equals_by_broadcast(spark):
    """A passage in a third of all rows, repeated and null ids, a very long text, names that clash with inner ones."""
    hot = " ".join(f"h{i}" for i in range(20))
    rows = [(i % 40 or None, f"a{i} b{i} " + (hot if i % 3 == 0 else "other words"), i, "x", "y") for i in range(300)]
    rows += [(1, None, 0, "x", "y"), (1, "", 0, "x", "y"), (7, "w " * 300_000 + hot, 0, "x", "y"), (8, "w " * 12, 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, doc string, n_hit string")
    bench = spark.createDataFrame([(i, hot + f" t{i}") for i in range(30)] + [(99, "w " * 13), (100, "b5")], "item_id long, text string")
    small, large = (decontam.contamination(docs, bench, block_rows=n) for n in (decontam.BLOCK_ROWS, 0))
    assert sorted(small.columns) == sorted(large.columns) == sorted(["doc_id", "text", "row", "doc", "n_words", "n_hit", "items", "contaminated"])
    key = lambda r: (str(r.doc_id), str(r.text), r.row, r.doc, r.n_words, r.n_hit, r["items"], r.contaminated)
    got = sorted(map(key, large.collect()))
    assert got == sorted(map(key, small.collect())) and sum(r[5] > 0 for r in got) == 102
    assert decontam.contamination(docs.where("false"), bench, block_rows=0).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, none, block_rows=-1).where("n_hit > 0 OR contaminated").count() == 0


def test_winnowing_finds_every_window_of_thirteen():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 5, 200).astype(np.uint64)  # many ties
    at = decontam.winnow(g, np.ones(194, bool), 7)
    for i in range(194):
        assert i <= at[i] < i + 7 and g[at[i]] == g[i:i + 7].min()
        assert at[i] == max(j for j in range(i, i + 7) if g[j] == g[i:i + 7].min())


PII_TEXTS = [None, "", "a.b@c.de x@y z@w.q@r.st 1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1", "+1 (743) 555-3824 +123 ++49 30 1234567",
             "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111110 \u0661\u0662", "@@ @a.b a@b..c a@-.- 1" + "0" * 3000 + " é@a.b e.é@x.yz", "9" * 5000 + "@x.y"]


def test_pii_base_spans_equal_the_patterns():
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    rng = random.Random(5)
    texts = PII_TEXTS[:6] + ["".join(rng.choice("a1. 4+-@()2") for _ in range(60)) for _ in range(3000)]
    for t in texts:
        want = []
        for k, p in enumerate(pats, 1):
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if k == 2 and any(len(x.lstrip("0")) > 3 or int(x.lstrip("0") or 0) > 255 for x in m[0].split(".")):
                    continue
                if k == 3 and not (16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                    continue
                if k == 4 and not 8 <= len(d) <= 15:
                    continue
                want.append((k, m.start(), m.end()))
        assert pii.base_spans(t) == want, t


def test_skip_chain_labels_a_distant_repeat_and_redacts(spark, none):
    phone = "call +1 (743) 555-3824 now"
    rows = [(i, f"{phone} word {i}", "en", "s", 1) for i in range(30)]
    rows += [(99, phone + " filler" * 200 + " again call 743-555-3824 please", "en", "s", 1), (100, None, None, None, None), (101, "", "en", "s", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    field = pii.fit(d)
    got = {r.doc_id: r for r in pii.find(d, field, min_marginal=0.5).collect()}
    assert any(s.kind == 4 for s in got[99].added_spans) and not got[100].base_spans and not got[101].added_spans
    out = {r.doc_id: r for r in pii.redact(d, field).collect()}
    assert out[0].text == "call [PHONE] now word 0" and out[0].n_chars == len(out[0].text) and out[100].text is None
    assert pii.redact(none, pii.fit(none)).count() == 0


def test_skip_chain_carries_a_label_along_thirty_repeats():
    k = pii._K
    half = np.array([3000.0, 0, 0, 0, 3000])
    field = pii.Field(np.zeros((pii.BINS, k)), np.zeros((k, k)), np.diag(half), half)
    field.node[:] = [0, -9, -9, -9, -0.1]  # the tokens themselves speak against a phone, all 30 less than one change of label costs
    text = "+15551234567" + " or 5551234567" * 30
    g = pii.Graph([text])
    assert [s[0] for s in g.base[0]] == [4] and len(g.label) == 31
    got = field.marginals(g)
    own = field.prior + 0.6 * field.node[g.feats].sum(1)
    own[0] = [-50, -50, -50, -50, 0]
    pair = 0.5 * field.chain + pii.SKIP_WEIGHT * field.skip
    add = lambda a: np.logaddexp.reduce(a, axis=0)
    left, right = [np.zeros(k)], [np.zeros(k)]
    for i in range(30):  # exact sums over all labellings of the line
        left.append(add((left[-1] + own[i])[:, None] + pair))
        right.append(add((right[-1] + own[30 - i])[:, None] + pair.T))
    exact = np.array(left) + own + np.array(right[::-1])
    exact = np.exp(exact - np.logaddexp.reduce(exact, axis=1)[:, None])
    assert np.allclose(got, exact, atol=1e-4) and got[1:, 4].min() >= pii.MIN_MARGINAL
    free = pii.Graph([text[1:]])  # no base span: nothing to carry
    assert field.marginals(free)[:, 4].max() < 0.5
    assert len(field.added(g, [text], pii.MIN_MARGINAL)[0]) == 30 and not field.added(free, [text[1:]], pii.MIN_MARGINAL)[0]
    far = " word" * 50 + " 5551234567"
    found = field.added(pii.Graph(["+15551234567" + far * 30]), ["+15551234567" + far * 30], pii.MIN_MARGINAL)[0]
    assert len(found) == 30 and {x[0] for x in found} == {4}


def test_secrets_incremental_ledger(spark, none):
    v1 = spark.createDataFrame([(1, "Token: 'abcdefgh1'"), (2, "Token: 'abcdefgh1'"), (3, None), (4, "x AKIA" + "A" * 12 + " " + "0f" * 16 + " pa\u017f\u017fword=longvalue1")], "doc_id long, text string")
    ledger = scratch_path(spark, "ledger")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secrets] for r in secrets.findings(v1, ledger).collect()}
    assert got == {1: [(0, 1, 17)], 2: [(0, 1, 17)], 3: [], 4: [(2, 2, 18), (19, 3, 51)]}
    n = secrets.read_ledger(spark, ledger).count()
    assert n == 3 * 3  # three blobs, three rules; the copy is scanned once
    v2 = v1.union(spark.createDataFrame([(5, "secret=12345678"), (6, "Token: 'abcdefgh1'")], v1.schema))
    got2 = {r.doc_id: len(r.secrets) for r in secrets.findings(v2, ledger).collect()}
    assert got2 == {1: 1, 2: 1, 3: 0, 4: 2, 5: 1, 6: 1} and secrets.read_ledger(spark, ledger).count() == n + 3
    secrets.findings(v2, ledger).count()
    assert secrets.read_ledger(spark, ledger).count() == n + 3  # nothing new
    secrets.update(v2, ledger, {"hex": 2})
    assert secrets.read_ledger(spark, ledger).count() == n + 3 + 4  # only the new rule version, over four blobs
    assert secrets.findings(none.select("doc_id", "text"), scratch_path(spark, "ledger")).count() == 0


def test_language_models(spark, none):
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the cat sat on the mat and the dog", "en"), ("der hund und die katze sind nicht hier", "de")] * 15)]
    d = spark.createDataFrame(rows + [(90, None, "en", "s", 0), (91, "12 !!", None, "s", 0), (92, "THE DOG", None, None, 0), (93, "die katze " * 5000, None, None, 0), (94, "a", "en", "s", 1)], SCHEMA)
    m = langid.fit(d)
    got = {r.doc_id: r for r in langid.identify(d, m, F.col("lang").isNotNull()).collect()}
    assert all(got[i].lang_pred == r[2] for i, r in enumerate(rows))
    assert [got[i].lang_pred for i in (90, 91, 92, 93)] == ["und", "und", "en", "de"] and got[90].score == 0.0 and got[94].lang_pred in ("en", "de")
    # probabilities of all continuations of a context add up to one
    ctx = np.array([int.from_bytes("".join(x).encode("utf-16-be"), "big") for x in ("the", "und")], np.uint64)
    every = np.array([c for c in range(65536)], np.uint64)
    for c in ctx:
        p = np.exp(m.lookup(((c << np.uint64(16)) | every).view(np.int64)).astype(float)).sum(0)
        assert np.allclose(p, 1, atol=2e-3)
    assert langid.identify(none, langid.fit(none), F.lit(True)).count() == 0


def test_letters_above_the_first_plane_are_no_marks_blanks_or_other_letters(spark):
    texts = ["\U0002000A\U0002000A some words", "\U00020020x\U00020020 y", "a\0b", "", "\U00020041", "A", "more  words, \U00020041b"]
    def grams(t):  # by hand
        c = "".join(x if x.isalpha() else " " for x in t.lower())
        c = "\n" + re.sub(" +", " ", c) + "\n"
        b = c.encode("utf-16-be")
        return sorted(int.from_bytes(b[i:i + 8], "big", signed=True) for i in range(0, len(b) - 7, 2))
    g, doc, letters = langid._packed(texts)
    assert [sorted(g[doc == i].tolist()) for i in range(len(texts))] == [grams(t) for t in texts]
    assert letters.tolist() == [sum(x.isalpha() for x in t.lower()) for t in texts]
    assert len({tuple(grams(chr(c))) for c in (0x1000A, 0x2000A, 0x3000A, 0x20041, 0x41)}) == 5
    d = spark.createDataFrame([(i, t, "en" if i % 2 else "zh", "s", 1) for i, t in enumerate(texts)] + [(50 + i, "plain words", "en", "s", 1) for i in range(4)], SCHEMA)
    m = langid.fit(d)
    got = {r.doc_id: r.lang_pred for r in langid.identify(d, m, F.lit(True)).collect()}
    alone = langid.identify(d.where("doc_id >= 50"), m, F.lit(True)).collect()
    assert len(got) == 11 and {r.lang_pred for r in alone} == {got[i] for i in range(50, 54)} == {"en"} and got[3] == "und"


def test_language_model_keeps_every_gram_whatever_its_blocks(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß ") for _ in range(400)), "ab"[i % 2], "s", 1) for i in range(300)]
    rows += [(900, None, None, "s", 0), (901, "q", "a", "s", 1), (902, "3", None, "s", 1)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    one, some = langid.fit(d), langid.fit(d, cells=60_000)
    seen = np.unique(langid._packed([r[1] or "" for r in rows if r[2]])[0])
    assert len(one.ranges) == 1 and len(some.ranges) > 2 and len(seen) > 50_000
    assert np.isin(seen, one.block(0).g[langid.ORDER]).all()  # no gram is lost to another
    near = np.concatenate([seen, rng.choices(range(1 << 60), k=500)]).astype(np.int64)
    assert np.allclose(one.lookup(near), some.lookup(near), atol=1e-5)
    p = [sorted((r.doc_id, r.lang_pred, r.score, r.cross_entropy or 0.0) for r in langid.identify(d, m, F.lit(True)).collect()) for m in (one, some)]
    assert len(p[0]) == len(rows) and [x[:2] for x in p[0]] == [x[:2] for x in p[1]]
    assert np.allclose([x[2:] for x in p[0]], [x[2:] for x in p[1]], atol=1e-5)


def test_toxicity_and_quality_learn_and_handle_edges(spark, none):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + (" idiot the muslim" if toxic else " the christian | |" if i % 3 == 0 else "")
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 0 if i % 3 == 0 and not toxic else 1, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    r = {x.doc_id: x for x in toxicity.score(d, toxicity.fit(d, lab, F.col("doc_id") % 5 != 0)).collect()}
    assert all(r[i].predicted == (i % 4 == 0) for i in range(400)) and 0 <= r[900].score == r[901].score <= 1
    probe = spark.createDataFrame([(1, "the muslim", "en", "s", 1), (2, "the christian", "en", "s", 1)], SCHEMA)
    assert toxicity.score(probe, toxicity.fit(d, lab, F.lit(True), pair=5.0)).where("predicted = 1").count() == 0
    g = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    q = quality.grade(d, quality.fit(d, lab.where("quality IS NOT NULL"), g, 3, F.lit(True))).collect()
    assert sum(x.grade_pred == (1 if x.doc_id % 4 == 0 else 0 if x.doc_id % 3 == 0 else 2) for x in q if x.doc_id < 400) > 380
    assert all(x.tails[0] >= x.tails[1] for x in q)
    empty = toxicity.fit(none, lab, F.lit(True))
    assert toxicity.score(none, empty).count() == 0 and {x.score for x in toxicity.score(d, empty).collect()} == {0.5}
    assert toxicity.swap_identities("The MUSLIM woman") == "The jewish man" and toxicity.swap_identities("nothing") is None


def test_identity_penalty_lowers_false_alarms(spark):
    """One group is named in most toxic texts, another in most clean ones: what is named must not decide."""
    rng = random.Random(8)
    def prose():
        return " ".join(rng.choice("abcdefghij") * 2 for _ in range(20))
    rows, labels = [], []
    for i in range(800):
        toxic = i % 2
        named = rng.choices(["the muslim", "the christian", ""], [70, 5, 25] if toxic else [10, 80, 10])[0]
        rows.append((i, f"{prose()} {named} {'idiot' if toxic and rng.random() < 0.5 else ''}", "en", "s", None))
        labels.append((i, toxic))
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, prose() + " the muslim", "en", "s", None) for i in range(100)], SCHEMA)
    insult = spark.createDataFrame([(i, prose() + " idiot", "en", "s", None) for i in range(100)], SCHEMA)
    free, held = (toxicity.fit(d, lab, F.lit(True), pair=p) for p in (0.0, 5.0))
    caught = {m: [toxicity.score(x, m).where("predicted = 1").count() for x in (neutral, insult)] for m in (free, held)}
    assert caught[free][0] >= 90 and caught[held][0] <= 5 and caught[held][1] >= 95
    # the terms have weights even where nothing else passes the screen, and the production weight of the penalty draws them together
    f = [int(next(linear.feature_sets(pa.array([t])))[3][0]) for t in ("muslim", "christian")]
    gap = {p: abs(float(np.diff(toxicity.fit(d, lab, F.lit(True), pair=p, screen=1e9).w[f])[0])) for p in (0.0, 1.0)}
    assert 0 < gap[1.0] < gap[0.0] / 2
    assert set(np.flatnonzero(toxicity.fit(d, lab, F.lit(True), screen=1e9).w)) <= set(toxicity.identity_features())


def test_feature_sets_are_distinct_and_whole():
    import pyarrow as pa
    got = {lo + i: sorted(f[r == i]) for lo, n, r, f in linear.feature_sets(pa.array(["a b a", None, "b a"])) for i in range(n)}
    assert len(got[0]) == 2 and got[0] == got[2] and got[1] == []


def test_url_rules_segmentation_and_edges(spark):
    pages = [(1, "http://a.example.net/en/x?q", "free free free bets bets bets"), (2, "https://EXAMPLE.com/de/", ""), (3, "x://net", None), (4, "http://net/", "b"),
             (5, None, None), (6, "no scheme", "x"), (7, "http://freebets.example.com/zz", "y"), (8, "http://b.org/fr/1#t", "z"), (9, "http://xexample.com/de/", "q"), (9, "http://xexample.com/de/", "q")]
    p = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    r = {x.page_id: x for x in urls.judge(p).collect()}
    assert [(r[i].host, r[i].path, r[i].rule) for i in range(1, 10)] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.com", "/de/", "example.com/de/"), ("net", "", None), ("net", "/", "net/"),
        ("", "", None), ("", "", None), ("freebets.example.com", "/zz", None), ("b.org", "/fr/1", "org/fr/"), ("xexample.com", "/de/", None)]
    assert [r[i].verdict for i in (1, 2, 4, 8)] == ["allow", "block", "block", "allow"] and r[7].words[:2] == ["free", "bets"]
    assert urls.judge(p).count() == 10 and urls.judge(p.limit(0)).count() == 0


def test_mixing_rates_and_hot_source(spark, none):
    rows = [(i, "t", "en", "hot" if i < 3000 else f"s{i % 3}" if i % 7 else None, 1) for i in range(6000)] + [(None, None, None, "hot", None)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit(7))
    w = spark.createDataFrame([("hot", 1.0), ("s0", 1.0), ("s1", 0.0), ("s2", 2.0), (None, 1.0)], "source string, weight double")
    got = {r.source: r["count"] for r in mixing.mix(d, w, total=10_000).groupBy("source").count().collect()}
    assert set(got) == {"hot", "s0", "s2", None}
    for s, share in (("hot", 0.2), ("s0", 0.2), ("s2", 0.4), (None, 0.2)):
        assert abs(got[s] - 10_000 * share) < 5 * np.sqrt(10_000 * share)
    big = spark.createDataFrame([(i, "t", "en", "a", 1) for i in range(40)], SCHEMA)  # rate 1000: a sum of draws
    n = mixing.mix(big, mixing.tempered(big), total=40_000).count()
    assert abs(n - 40_000) < 5 * 200
    assert mixing.mix(none, mixing.tempered(none)).count() == 0
    keys = [r.shuffle_key for r in mixing.mix(d, w).select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_fingerprints_equal_brute_force(spark, docs, none):
    d = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect())
    pieces = lambda t: set(re.findall(fingerprints._PATTERN, t))
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {}
    for i, (k, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        e = t[:len(t) - len(t) // 4] + n[:len(t) // 4]
        want[k] = (len(t), hashlib.sha256(e.encode()).hexdigest(), jac(pieces(t), pieces(e)), jac(pieces(t), pieces(n)))
    got = fingerprints.fingerprints(d).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {k: v[:2] for k, v in want.items()}
    for r in got:
        assert (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][2:], abs=1e-12), r.doc_id
    by = defaultdict(set)
    for r in got:
        by[dict(rows)[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert fingerprints.fingerprints(none).count() == 0
    assert fingerprints.fingerprints(docs).count() == docs.count()  # null and repeated ids
    assert fingerprints.fingerprints(d.where("doc_id = 0")).first().near_next == 1.0  # the only one is its own next


def test_fingerprints_of_digests_that_share_all_cells(spark):
    pieces = spark.range(30_000).select(F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(".")).alias("p")).withColumn("d", fingerprints.digests(F.col("p"))[0])
    m = F.lit(fingerprints.ROOM * 10).cast("long")
    same = pieces.groupBy(*[fingerprints._place(F.col("d"), F.lit(t), m).alias(f"c{t}") for t in range(fingerprints.TABLES)]).agg(F.sort_array(F.collect_list("p")).alias("p"))
    pairs = sorted(r.p[:2] for r in same.where("size(p) > 1").collect())[:20]
    assert len(pairs) == 20
    # five pieces, two of them with the same cells in a sketch for ten digests, before five others
    texts = [x for i, p in enumerate(pairs) for x in ("".join([*p, f"x{i}.", f"y{i}.", f"z{i}."]), "".join(f"{c}{i}!" for c in "abcde"))]
    got = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts) and all(r.near_next == 0.0 for r in got)


def test_pipeline_stages_equal_brute_force(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert out.columns == [*docs.columns, "copy", "shuffle_key"] and out.count() > 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL).collect()
    sets = [frozenset(zip(*[words(r"[^\x20\x09-\x0D]+", r.text)[i:] for i in range(5)])) for r in kept]
    assert not any(a and 100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert not any(pii.base_spans(r.text) for r in corpus_pipeline.redact_pii(spark, docs, SF_SMALL).collect())


def test_pipeline_stages_on_edge_rows(spark, docs, none):
    for frame in (docs.withColumn("score", F.lit("extra")), none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF_SMALL)
            assert out.columns == frame.columns, name
            n, kept = frame.count(), out.count()
            assert kept <= n and (kept == n or name == "near_duplicates"), name


def test_secrets_and_models_with_clashing_columns(spark, docs):
    extra = docs.withColumns({c: F.lit("x") for c in ("secrets", "blob", "found", "rule", "grade", "features", "tails", "score", "predicted", "base_spans", "_cf")})
    out = secrets.findings(extra, scratch_path(spark, "ledger"))
    assert out.count() == docs.count() and sorted(out.columns) == sorted(extra.columns)
    labels = docs.where("doc_id < 60").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit("y").alias("text"))
    model = toxicity.fit(extra, labels, F.lit(True))
    assert toxicity.score(extra, model).select("score", "predicted").count() == docs.count()
    assert quality.grade(extra, quality.fit(extra, labels, F.col("toxic"), 2, F.lit(True))).count() == docs.count()
    assert pii.find(extra, pii.fit(extra)).count() == docs.count()


def test_sample_has_one_row_an_id(spark):
    d = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0)], "doc_id long, toxic int")
    got = sorted((r.text, r.grade) for r in linear.labelled_sample(d, labels, F.col("toxic"), F.lit(True)).collect())
    assert got == [("w0", 1), ("w1", 0), ("w1001", 1)] or len(got) == 3


def test_fitting_scans_the_documents_in_their_own_tasks(spark, tmp_path):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).repartition(12)
    path = str(tmp_path / "docs")
    d.write.parquet(path)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 30)  # a task for each file
    try:
        read = spark.read.parquet(path)
        sample = linear.labelled_sample(read, spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")), F.col("toxic"), F.lit(True))
        assert read.rdd.getNumPartitions() == 12 and "Coalesce" not in sample._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def _drop(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, d, SF_SMALL).collect()), key=str)


def test_pipeline_keeps_one_row_of_each_group(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = lambda t: t.replace("7 ", "q ", 1)
    assert _drop(spark, [(1, a), (2, near(a)), (2, b), (3, near(b))]) == [(1, a), (2, b)]
    assert _drop(spark, [(None, a), (1, near(a))]) == [(1, near(a))]
    assert len(_drop(spark, [(4, a), (4, near(a)), (4, b)])) == 2
    assert _drop(spark, [(None, None), (None, None), (5, ""), (5, "")]) == sorted([(None, None)] * 2 + [(5, "")] * 2, key=str)


def test_pipeline_keeps_what_no_label_speaks_against(spark, docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path / "none")).count() == docs.count()
    words_of = docs.where("text IS NOT NULL AND length(trim(text)) > 20")
    mostly = words_of.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 9 == 0, 0).otherwise(1).alias("toxic"))
    mostly.write.parquet(str(tmp_path / "mostly" / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path / "mostly")).collect()}
    assert {r.doc_id for r in docs.where("text IS NULL OR trim(text) = ''").collect()} <= kept


def test_pipeline_near_duplicates_keep_the_right_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: frozenset(zip(*[words(r"[^\x20\x09-\x0D]+", r.text)[i:] for i in range(5)])) or frozenset(words(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                lo, hi = sorted((label[i], label[j]))
                label = {k: lo if x == hi else x for k, x in label.items()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL).collect()}
    assert kept == {i for i in sets if label[i] == i}
