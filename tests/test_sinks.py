"""Sinks and sources: run-stamped report folder, CSV round trip, JSON metadata document."""
import os

from pyspark.sql import functions as F

from churnscope.plans.registry import load_all
from churnscope.sources import sinks
from churnscope.sources.fixtures import churn_features
from conftest import SF_SMALL

REG = load_all()


def test_eda_report_writes_rounded_tables(spark):
    idx = {r.table_name: r for r in REG["eda_report"].run(spark, SF_SMALL).collect()}
    assert idx["correlation_matrix"].rows == 49
    assert len(idx) == 16 and idx["frequent_buyer_churn_stats"].rows >= 2
    assert idx["target_summary"].rows == 2
    folder = os.path.dirname(idx["target_summary"].path)
    assert os.path.basename(os.path.dirname(folder)).startswith("eda_output_")
    pct = [r.percentage for r in spark.read.option("header", True).csv(idx["target_summary"].path).collect()]
    assert all(len(p.split(".")[1]) <= 2 for p in pct if "." in p)


def test_csv_round_trip_keeps_rows_and_types(spark):
    cf = churn_features(spark, SF_SMALL)
    back = REG["csv_scan"].run(spark, SF_SMALL)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in cf.schema]
    assert back.exceptAll(cf).count() == 0 and cf.exceptAll(back).count() == 0


def test_metadata_document(spark):
    doc = REG["prep_metadata"].run(spark, SF_SMALL).first()
    names = list(doc.feature_names)
    assert names[:2] == ["age", "services"]
    for var, info in doc.category_info.asDict().items():
        assert info.reference_category == sorted(info.original_values)[0]
        assert list(info.encoded_columns) == [f"{var}_{v}" for v in sorted(info.original_values)[1:]]
    shapes = doc.data_shapes.asDict()
    n = churn_features(spark, SF_SMALL).count()
    assert shapes["X_train_processed"][0] + shapes["X_test_processed"][0] == n
    assert shapes["X_test_processed"][1] == len(names)


def test_json_document_round_trip(spark, tmp_path):
    df = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("xs"), F.lit(3).alias("n"))
    path = sinks.write_json_document(df, str(tmp_path / "doc"))
    r = sinks.read_json(spark, path).first()
    assert list(r.xs) == ["a", "b"] and r.n == 3


def test_readers_take_published_sets_only(spark, tmp_path):
    """A run that dies before its manifest leaves the set before it readable; a set with a changed file is refused."""
    import pytest

    from churnscope.sources import artifacts
    root = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        artifacts.published(spark, root)

    def write(n):
        return lambda folder: (spark.range(n).write.parquet(f"{folder}/rows"),
                               spark.range(1).write.json(f"{folder}/deep/er/one"))

    first = artifacts.publish(spark, root, write(3), {"best": "a"})

    def dies(folder):
        spark.range(9).write.parquet(f"{folder}/rows")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        artifacts.publish(spark, root, dies)
    folder, manifest = artifacts.published(spark, root)
    assert folder == first and manifest["best"] == "a"
    assert spark.read.parquet(f"{folder}/rows").count() == 3
    second = artifacts.publish(spark, root, write(5))
    assert artifacts.published(spark, root)[0] == second != first
    assert artifacts.published(spark, root, artifacts.versions(spark, root)[0])[0] == first
    gone = next(f for f in manifest["files"] if f.startswith("rows/") and f.endswith(".parquet"))
    with open(os.path.join(first, gone), "ab") as f:
        f.write(b"x")
    with pytest.raises(FileNotFoundError):
        artifacts.published(spark, root, artifacts.versions(spark, root)[0])


def test_model_registry_is_published(spark):
    """Every model with its metrics, report, importances and predictions, under one manifest."""
    import json

    from churnscope.session import ensure_checkpoint_dir
    from churnscope.sources import artifacts
    rows = REG["model_registry"].run(spark, SF_SMALL).collect()
    folder, manifest = artifacts.published(spark, os.path.join(ensure_checkpoint_dir(spark), "models"))
    assert sum(r.is_best for r in rows) == 1
    for r in rows:
        name = r.model.lower().replace(" ", "_")
        assert r.model_path == f"{folder}/{name}/model"
        for table in ("metrics", "importance", "predictions", "report"):
            assert any(f.startswith(f"results/{table}/model_file={name}/") for f in manifest["files"]), (table, json.dumps(name))
    report = spark.read.json(f"{folder}/results/report")
    assert report.count() == 5 * len(rows)
