"""The jobs as commands."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift import __main__ as jobs
from raresift.constants import FEATURE_PRESETS


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A catalogue in the default preset, as CSV."""
    place = tmp_path_factory.mktemp("jobs")
    names = FEATURE_PRESETS["default"]
    draw = np.random.default_rng(4)
    rows = []
    for i in range(240):
        code = [0, 1, 2, 3, 4][min(4, i // 60)] if i < 180 else 2 + i % 3
        rows.append((str(10**17 + i), *map(float, draw.normal(code * 3.0, 0.4, len(names))), f"class{code}"))
    columns = "sourceid string, " + ", ".join(f"{name} double" for name in names) + ", bestclassification_1 string"
    table = spark.createDataFrame(rows, columns)
    table.write.option("header", True).csv(str(place / "training.csv"))
    table.drop("bestclassification_1").write.option("header", True).csv(str(place / "catalogue.csv"))
    table.limit(40).select("sourceid").coalesce(1).write.option("header", True).csv(str(place / "known.csv"))
    return place


def test_quality(spark, files, capsys):
    jobs.main(["quality", "--catalogue", str(files / "catalogue.csv")], spark)
    report = json.loads(capsys.readouterr().out)
    assert len(report) == 17 and {row["total_bad"] for row in report} == {0}


def test_train_score_and_stream(spark, files, capsys, monkeypatch):
    small = jobs.CascadeConfig(gate_trees=5, gate_depth=4, specialist_views=5, generalist_rounds=2, generalist_depth=2)
    monkeypatch.setattr(jobs, "CascadeConfig", lambda use_augmentation: small)
    common = ["--bundles", str(files / "models"), "--name", "run1"]
    jobs.main(["train", "--training", str(files / "training.csv"), "--contaminants", str(files / "absent.csv"), *common], spark)
    trained = json.loads(capsys.readouterr().out)
    assert trained["contaminants"] is False
    assert trained["filter"] in ("Autoencoder", "IsolationForest")
    assert spark.read.option("header", True).csv(f"{trained['bundle']}/reports/classes").count() == 5
    jobs.main(
        ["score", "--catalogue", str(files / "catalogue.csv"), *common, "--output", str(files / "verdicts"), "--known", str(files / "known.csv")], spark
    )
    assert json.loads(capsys.readouterr().out)["rows"] == 200
    jobs.main(
        ["stream", "--catalogue", str(files / "catalogue.csv"), "--format", "csv", *common, "--output", str(files / "streamed"),
         "--checkpoint", str(files / "progress"), "--done", str(files / "verdicts")], spark,
    )
    assert json.loads(capsys.readouterr().out)["batches"] >= 1
    assert spark.read.parquet(str(files / "streamed")).count() == 40


def test_curate(spark, tmp_path, capsys):
    for name, rows in {"first": [(1, "a"), (2, "b")], "second": [(1, "a")], "target": [(2, "b"), (3, "c")]}.items():
        spark.createDataFrame(rows, "k int, v string").write.parquet(str(tmp_path / name))
    jobs.main(["curate", *sum(([f"--{name}", str(tmp_path / name)] for name in ("first", "second", "target")), []), "--output", str(tmp_path / "new")], spark)
    assert json.loads(capsys.readouterr().out) == {"removed": 1}
    assert [row.k for row in spark.read.parquet(str(tmp_path / "new")).collect()] == [3]


def test_contaminants_importance_and_columns(spark, files, tmp_path, capsys):
    names = FEATURE_PRESETS["default"]
    junk = spark.read.option("header", True).csv(str(files / "training.csv")).withColumnRenamed("bestclassification_1", "bestclassification")
    junk.withColumn(names[0], F.when(F.col("sourceid") % 2 == 0, "?").otherwise(F.col(names[0]))).write.option("header", True).csv(str(tmp_path / "junk.csv"))
    jobs.main(["contaminants", "--catalogue", str(tmp_path / "junk.csv"), "--output", str(tmp_path / "about")], spark)
    assert json.loads(capsys.readouterr().out)["reports"] == [f"contaminant_{name}" for name in ("inclusion", "kinds", "missing", "rows")]
    missing = {row["column"]: int(row["missing"]) for row in spark.read.option("header", True).csv(str(tmp_path / "about/contaminant_missing")).collect()}
    assert missing == {names[0]: 120}
    jobs.main(
        ["importance", "--catalogue", str(files / "training.csv"), "--target", "bestclassification_1", "--output", str(tmp_path / "top"), "--trees", "5", "--depth", "4"], spark
    )
    assert set(json.loads(capsys.readouterr().out)["features"]) <= set(names)
    jobs.main(["columns", "--catalogue", str(files / "training.csv"), "--drop", names[0], "absent", "--output", str(tmp_path / "less.csv")], spark)
    assert json.loads(capsys.readouterr().out)["columns"] == ["sourceid", *names[1:], "bestclassification_1"]
