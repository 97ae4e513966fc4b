"""Registered queries of the package: thin digests of each operator over its whole table, as the contracts ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import decontam, fingerprints, jaccard, langid, mixing, negatives, pii, quality, secrets, setsketch, toxicity, urls, whitening
from churnscope.llm.store import scratch_path
from churnscope.session import ensure_checkpoint_dir
from churnscope.sources.tables import read_table


def crc(mod: int) -> Column:
    """crc32 of the document id as text, modulo ``mod``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod


def _joined(kinds: tuple, spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counts(kinds: tuple, spans: Column) -> dict:
    def one(i: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")
    return {f"n_{k}": one(i) for i, k in enumerate(kinds, 1)}


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    d = pii.find(docs, pii.fit(docs))
    both = F.array_sort(F.concat("base_spans", "added_spans"))  # by kind, then start
    return (d.withColumns(_counts(pii.KINDS, F.col("base_spans")))
            .withColumn("base_sha256", F.sha2(_joined(pii.KINDS, F.col("base_spans")), 256))
            .withColumn("spans", _joined(pii.KINDS, both)).withColumn("n_added", F.size("added_spans").cast("long"))
            .drop("text", "base_spans", "added_spans"))


def _grade() -> Column:
    """Three grades from the two labels: 0 low quality, 1 sound but toxic, 2 sound; null if a label is missing."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, _grade(), 3, crc(5) != 0)
    d = quality.grade(docs.withColumn("held_out", crc(5) == 0), model)
    return d.select("doc_id", "held_out", "expected_grade", F.col("tails")[0].alias("p_ge_1"), F.col("tails")[1].alias("p_ge_2"), "grade_pred")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    d = secrets.findings(docs, scratch_path(spark, "secret-ledger"))  # a new ledger: every blob is scanned once
    text = _joined(secrets.KINDS, F.col("secrets"))
    return (d.withColumns(_counts(secrets.KINDS, F.col("secrets"))).withColumn("spans", text)
            .withColumn("base_sha256", F.sha2("spans", 256)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc(4) != 2))
    d = langid.identify(docs.withColumn("held_out", crc(4) == 2), model, ~F.col("held_out"))
    return d.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, crc(5) != 0)
    return toxicity.score(docs.withColumn("held_out", crc(5) == 0), model).select("doc_id", "held_out", "score", "predicted")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = jaccard.groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_shingles", "component_id")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = urls.judge(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "host", "path", "rule", "verdict", "p_block", F.array_join("words", " ").alias("words"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.tempered(docs))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    d = decontam.contamination(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows, whitening.fit(rows, 4))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = setsketch.groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_shingles", "component_id", "kept")


def _words(text: str, pattern: str) -> str:
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{az}', '{az.lower()}'), '{pattern}')"


def _groups_sql(n: int, hundredths: int, more: str = "") -> str:
    """Components of documents whose sets of n-word shingles have a Jaccard similarity of so many hundredths."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words('text', '[^ ' + chr(92) + 't-' + chr(92) + 'r]+')} AS w FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {hundredths} * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id{more}
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""


OP6_SQL = _groups_sql(5, 75)
OP13_SQL = _groups_sql(2, 80, ", d.doc_id = min(r.c) AS kept")

OP8_SQL = f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
u AS (SELECT *, ('0x' || substr(md5('{mixing.SEED}|' || doc_id || '|1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
m AS (SELECT doc_id, count(*) AS m FROM u JOIN c ON c.source = u.source AND c.c <= u.u GROUP BY doc_id)
SELECT d.*, x.copy::INTEGER AS copy, substr(md5('{mixing.SEED}|' || doc_id || '|copy|' || x.copy), 1, 16) AS shuffle_key
FROM documents d JOIN m USING (doc_id), LATERAL (SELECT unnest(range(1, m + 1)) AS copy) x
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_words('text', '[0-9a-z' + chr(92) + 'x{80}-' + chr(92) + 'x{10FFFF}]+')} AS w FROM documents),
b AS (SELECT item_id, {_words('text', '[0-9a-z' + chr(92) + 'x{80}-' + chr(92) + 'x{10FFFF}]+')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS s FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
hit AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM dw) dw JOIN bw ON bw.s = dw.s AND bw.m = dw.m),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
ii AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN ii USING (doc_id)
"""

OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS la, b.vec_id AS id, b.label AS lb, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM r a, r b WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE la = lb AND id <> anchor_id),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.lb <> s.la
      WHERE p.k <= 5 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

_RUNS = {f.__name__: f for f in (op1_pii, op2_quality, op3_secrets, op4_langid, op5_toxicity, op6_jaccard, op7_urls, op8_mixing, op9_fingerprints, op10_decontam,
                                  op11_hard_negatives, op12_whitening, op13_setsketch)}
SQL = {"op6_jaccard": OP6_SQL, "op8_mixing": OP8_SQL, "op10_decontam": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_setsketch": OP13_SQL}


def queries() -> dict:
    """name -> callable of (spark, sf_dir)."""
    def wrap(f):
        def run(spark, sf_dir):
            ensure_checkpoint_dir(spark)
            return f(spark, sf_dir)
        run.__name__ = f.__name__
        return run
    return {name: wrap(f) for name, f in _RUNS.items()}
