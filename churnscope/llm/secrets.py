r"""Secret scanning with an incremental, content-addressed blob ledger.

Every version of every path is a blob, named by the SHA-256 of its content. The ledger is a Parquet
table of (blob, rule, rule_version, spans) rows: which rule version has scanned which blob, and what
it found. A call scans only (blob, rule version) pairs that the ledger doesn't have, once for each
blob however many paths or versions hold it, appends them, and joins the findings back to all paths.

Blobs are deduplicated before the shuffle in each task (a partial aggregate), so a blob that a
third of the paths share costs one row a task. With a ledger, the known blobs are removed by their
digests first; texts move only for blobs that some rule hasn't seen.

Defined results: null content is the empty blob; repeated rows are paths of their own; an empty
table adds nothing; extra columns stay in the result; no findings give an empty array.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm import text as X
from churnscope.llm.store import bounded_batches, written

#: rule -> (version, pattern, smallest length of the group, group)
RULES = {
    "assign": (1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": (1, r"AKIA[A-Z0-9]+", 16, 0),
    "hex": (1, r"(?<![0-9a-f])[0-9a-f]{32,}", 32, 0),  # whole runs: a shorter run can't match
}
KINDS = tuple(RULES)
#: findings are broadcast when joined back to the paths up to this many blobs
SMALL = 500_000

_ASSIGN = re.compile(RULES["assign"][1], re.IGNORECASE | re.ASCII)
_ACCESS, _HEX = (re.compile(RULES[k][1]) for k in ("access", "hex"))
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rule", T.StringType()),
                       T.StructField("rule_version", T.IntegerType()), T.StructField("spans", _SPANS)])


def scan_text(rule: str, t: str) -> list[tuple[int, int]]:
    """Spans of one rule in a text: leftmost non-overlapping matches, those that are too short dropped."""
    if rule == "assign":
        return [m.span() for m in _ASSIGN.finditer(t) if len(m[2]) >= 8] if "=" in t or ":" in t else []
    if rule == "access":
        return [m.span() for m in _ACCESS.finditer(t) if len(m[0]) >= 16] if "AKIA" in t else []
    return [m.span() for m in _HEX.finditer(t)]


def _scanner(rules: list[str]):
    def f(texts: pa.Array) -> pa.Array:
        found = {k: [[] for _ in range(len(texts))] for k in rules}
        for lo, buf, offs in X.chunks(texts):
            # a match has "=" or ":", a run of 32 hex digits, or "AKIA": the rest of the texts isn't decoded
            hexa = ((buf >= 48) & (buf <= 57)) | ((buf >= 97) & (buf <= 102))
            far = np.concatenate([[0], np.cumsum(hexa)])
            mark = (buf == 61) | (buf == 58)
            mark[:max(0, len(buf) - 31)] |= (far[32:] - far[:-32] == 32)[:max(0, len(buf) - 31)] if len(buf) > 31 else False
            if len(buf) > 3:
                mark[:-3] |= (buf[:-3] == 65) & (buf[1:-2] == 75) & (buf[2:-1] == 73) & (buf[3:] == 65)
            hit = np.concatenate([[0], np.cumsum(mark)])[offs]
            raw = None
            for r in np.flatnonzero(hit[1:] > hit[:-1]):
                raw = buf.tobytes() if raw is None else raw
                t = raw[offs[r]:offs[r + 1]].decode("utf-8", "replace")
                for k in rules:
                    found[k][lo + r] = [{"start": a, "end": b} for a, b in scan_text(k, t)]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(found[k], span) for k in rules], names=list(rules))

    return F.arrow_udf(f, T.StructType([T.StructField(k, _SPANS) for k in rules]))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger, or None if nothing has been written to it."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update(versions: DataFrame, ledger: str, versions_of_rules: dict[str, int] | None = None) -> DataFrame:
    """Scan what the ledger hasn't and append it; returns the ledger's rows for the present rule versions.

    versions: DataFrame with a ``text`` column, one row for each version of each path."""
    spark = versions.sparkSession
    bounded_batches(spark)
    rules = {k: (versions_of_rules or {}).get(k, RULES[k][0]) for k in KINDS}
    blobs = versions.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blobs = blobs.select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    known = read_ledger(spark, ledger)
    for group in _groups(spark, blobs, known, rules, ledger):
        names, todo = group
        once = todo.groupBy("blob").agg(F.first("text").alias("text"))
        found = once.select("blob", _scanner(names)("text").alias("found"))
        rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(rules[k]).cast("int").alias("rule_version"),
                                            F.col(f"found.{k}").alias("spans")) for k in names]))
        found.select("blob", rows.alias("r")).select("blob", "r.*").write.mode("append").parquet(ledger)
    wanted = None
    for k, v in rules.items():
        c = (F.col("rule") == k) & (F.col("rule_version") == v)
        wanted = c if wanted is None else wanted | c
    now = read_ledger(spark, ledger)
    return (spark.createDataFrame([], LEDGER) if now is None else now).where(wanted)


def _groups(spark, blobs, known, rules, ledger):
    """(rules, blobs that none of them has scanned): rules that have seen the same part of the ledger go together."""
    if known is None:
        return [(list(rules), blobs)]
    out = []
    digests = blobs.select("blob").distinct()
    for k, v in rules.items():
        seen = known.where((F.col("rule") == k) & (F.col("rule_version") == v)).select("blob")
        unseen = digests.join(seen, "blob", "left_anti")
        n = unseen.count()
        if n:
            out.append(([k], blobs.join(F.broadcast(unseen) if n <= SMALL else unseen, "blob", "left_semi")))
    return out


def findings(versions: DataFrame, ledger: str) -> DataFrame:
    """``versions`` with blob and secrets: array of (start, kind as in KINDS from 1, end), by start, then kind. Columns
    of these two names that ``versions`` may have are replaced, all others stay."""
    spark = versions.sparkSession
    versions = versions.drop("blob", "secrets")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i + 1)])
    hits = (update(versions, ledger).where(F.size("spans") > 0)
            .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[F.col("rule")].alias("kind"), s["end"].alias("end"))).alias("s"))
            .groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("secrets")))
    hits = written(hits, "secret-hits")  # only blobs with findings: at most one row for each rule met here
    n = hits.count()
    d = versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    d = d.join(F.broadcast(hits) if n <= SMALL else hits, "blob", "left")
    empty = F.array().cast(hits.schema["secrets"].dataType)
    return d.withColumn("secrets", F.coalesce("secrets", empty))
