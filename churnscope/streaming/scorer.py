"""Structured Streaming scorer (ST1): JSON customer records arrive as lines of files; each
micro-batch is parsed and validated once, written once, and feeds both sinks from that copy:
valid records are scored, explained and tiered by the same function as the batch scorer and go
to one parquet sink; rejected ones go to a quarantine sink with their errors and the line they
came from, unchanged, also where it isn't JSON at all. Counts of each batch are observed while
it is written and kept in a third table.

Stateless on purpose (every record is scored on its own), so no watermark is needed.
Writes are idempotent per micro-batch (``batch_id=<epoch>`` folders overwritten on a
retry), and the checkpoint location makes the query resume where it stopped. The batch's copy
and the scorer's intermediate tables lie in ``_work/batch_id=<epoch>`` of the output folder and
are dropped when both sinks are written. Blank lines are no records.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.operators.models import Benchmark
from churnscope.operators.rules import validate_records
from churnscope.operators.score import score_records
from churnscope.sources.artifacts import delete_folder

MALFORMED = "Malformed record"
_CORRUPT = "_corrupt"


def record_schema(spec) -> T.StructType:
    """Incoming records: the key plus every feature as text (validation casts)."""
    key_type = T.LongType()
    return T.StructType([T.StructField(spec.key, key_type)] + [T.StructField(c, T.StringType()) for c in spec.features])


def parse_records(df: DataFrame, spec, value_col: str = "value") -> DataFrame:
    """Records that arrive as JSON text (a file line, a message value) parsed with
    ``from_json`` against the declared record schema; a line that is not JSON gives
    null fields, which validation reports as missing."""
    return df.select(F.from_json(F.col(value_col), record_schema(spec)).alias("r")).select("r.*")


def checked_lines(lines: DataFrame, spec, value_col: str = "value") -> DataFrame:
    """One row for each line that isn't blank: the record's fields, the line as ``raw``, ``is_malformed`` (not JSON,
    or a value the declared schema can't hold), ``is_valid`` and ``errors``."""
    schema = record_schema(spec).add(_CORRUPT, T.StringType())
    parsed = (lines.where(F.trim(F.regexp_replace(value_col, r"\s", " ")) != "")
              .select(F.col(value_col).alias("raw"),
                      F.from_json(F.col(value_col), schema, {"columnNameOfCorruptRecord": _CORRUPT}).alias("r"))
              .select("raw", (F.col("r").isNull() | F.col(f"r.{_CORRUPT}").isNotNull()).alias("is_malformed"), "r.*")
              .drop(_CORRUPT))
    checked = validate_records(parsed, spec, extra=("raw", "is_malformed"))
    bad = F.col("is_malformed")
    return (checked.withColumn("is_valid", F.col("is_valid") & ~bad)
            .withColumn("errors", F.when(bad, F.concat_ws("; ", F.lit(MALFORMED), F.nullif("errors", F.lit(""))))
                        .otherwise(F.col("errors")))
            .select(spec.key, *spec.features, "raw", "is_malformed", "is_valid", "errors"))


def process_batch(lines: DataFrame, epoch_id: int, bench: Benchmark, model_name: str, out_dir: str,
                  model_accuracy: float | None = None) -> None:
    """One micro-batch: checked lines written once with observed counts, then both sinks and the counts."""
    spark, spec, part = lines.sparkSession, bench.spec, f"batch_id={epoch_id}"
    work = os.path.join(out_dir, "_work", part)

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(work, name)
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    counts = Observation()
    checked = keep(checked_lines(lines, spec).observe(
        counts, F.count(F.lit(1)).alias("n_lines"), F.count_if("is_malformed").alias("n_malformed"),
        F.count_if(~F.col("is_valid")).alias("n_rejected")), "checked")
    seen = counts.get
    score_records(checked.where("is_valid").select(spec.key, *spec.features), bench, model_name, model_accuracy, keep=keep) \
        .write.mode("overwrite").parquet(os.path.join(out_dir, "scored", part))
    checked.where("NOT is_valid").select(spec.key, "errors", "is_malformed", "raw") \
        .write.mode("overwrite").parquet(os.path.join(out_dir, "rejected", part))
    spark.range(1).select(*[F.lit(int(seen[n] or 0)).cast("long").alias(n) for n in ("n_lines", "n_malformed", "n_rejected")]) \
        .coalesce(1).write.mode("overwrite").parquet(os.path.join(out_dir, "metrics", part))
    delete_folder(spark, work)


def start_scorer(spark: SparkSession, bench: Benchmark, model_name: str, source_dir: str, out_dir: str,
                 checkpoint_dir: str, model_accuracy: float | None = None, available_now: bool = True,
                 max_files_per_trigger: int | None = None):
    """Start the streaming query; with ``available_now`` it processes what is there
    and stops (``awaitTermination`` returns)."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.text(source_dir)

    def process(batch_df: DataFrame, epoch_id: int) -> None:
        process_batch(batch_df, epoch_id, bench, model_name, out_dir, model_accuracy)

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_output(spark: SparkSession, out_dir: str) -> tuple:
    """(scored, rejected) rows written so far."""
    scored = spark.read.parquet(os.path.join(out_dir, "scored"))
    rejected = spark.read.parquet(os.path.join(out_dir, "rejected"))
    return scored, rejected


def read_metrics(spark: SparkSession, out_dir: str) -> DataFrame:
    """Lines, malformed lines and rejected records of every batch."""
    return spark.read.parquet(os.path.join(out_dir, "metrics"))
