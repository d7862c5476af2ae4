"""Files, training, scoring, bundles and streams, end to end on a separable catalogue."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.constants import FILTER_ISOLATION, FILTER_RECONSTRUCTION
from raresift.operators.models import CascadeConfig, feature_importance, train_cascade, train_classifier, with_vector
from raresift.plans.score import messages, score, score_to_files
from raresift.plans.train import TrainConfig, load_contaminants, train
from raresift.sources.bundle import load_bundle, save_bundle
from raresift.sources.tables import (
    count_rows,
    current_version,
    read_catalogue,
    read_known_lists,
    read_optional_ids,
    read_table,
    read_verdicts,
    read_version,
    rewrite_version_without,
    rewrite_without,
    write_verdicts,
    write_version,
)
from raresift.schema import MissingColumns
from raresift.streaming.score_stream import score_stream, stream_catalogue

FEATURES = ["f1", "f2", "f3"]
CLASSES = ["RRab", "RRc", "RRd", "ablazhko", "anomalous"]
CENTRES = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0], [0, 10, 4], [4, 10, 0]], dtype=float)
SMALL = CascadeConfig(gate_trees=10, gate_depth=5, specialist_views=32, generalist_rounds=5, generalist_depth=3)
CONFIG = TrainConfig(name="trial", isolation_trees=30, reconstruction_width=2, cascade=SMALL)


def _points(size_per_class, seed):
    draw = np.random.default_rng(seed)
    rows = []
    for code, size in enumerate(size_per_class):
        for point in CENTRES[code] + draw.normal(0, 0.5, (size, 3)):
            rows.append((f"{seed}-{len(rows)}", *map(float, point), CLASSES[code]))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = _points([400, 300, 60, 30, 20], 1)
    rows += [("gap", None, 1.0, 1.0, "RRab"), ("endless", float("inf"), 1.0, 1.0, "RRc"), ("nameless", 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "sourceid string, f1 double, f2 double, f3 double, bestclassification_1 string").cache()


@pytest.fixture(scope="module")
def junk(spark):
    draw = np.random.default_rng(9)
    rows = [(f"j{i}", *map(float, point)) for i, point in enumerate(draw.uniform(-30, 40, (300, 3)))]
    return spark.createDataFrame(rows, "sourceid string, f1 double, f2 double, f3 double")


@pytest.fixture(scope="module")
def system(labelled, junk):
    return train(labelled, junk, FEATURES, config=CONFIG)


@pytest.fixture(scope="module")
def catalogue(spark, junk):
    fresh = spark.createDataFrame(_points([200, 200, 30, 20, 10], 2), "sourceid string, f1 double, f2 double, f3 double, truth string")
    return fresh.unionByName(junk.withColumn("truth", F.lit("junk"))).cache()


def test_training_profile(system):
    assert system.bundle.labels.labels == tuple(CLASSES)
    assert tuple(system.profile["rows"].first())[:3] == (813, 810, 3)
    assert {row.column: row.missing for row in system.profile["missing"].collect()} == {"f1": 2, "bestclassification_1": 1}
    assert {row.label: row["rows"] for row in system.profile["classes"].collect()}["RRd"] == 60


def test_training_reports(system):
    final = {row.label: row for row in system.reports["final"].collect()}
    assert final["2"].recall > 0.8 and final["0"].recall > 0.9
    assert sum(final[code].support for code in ("0", "1", "2")) == 162
    flow = {row.step: row["rows"] for row in system.reports["contaminant_flow"].collect()}
    assert flow["blocked"] + flow["passed"] == 300 and flow["blocked"] > 200
    assert system.bundle.filter_type in (FILTER_ISOLATION, FILTER_RECONSTRUCTION)
    assert system.threshold in (0.9, 0.5)
    assert system.reports["gate_counts"].first().tp > 15


def test_scoring_finds_rare_rows_and_junk(system, catalogue):
    found = score(catalogue, system.bundle).join(catalogue.select(F.col("sourceid").alias("id"), "truth"), "id").collect()
    assert len(found) == 760
    junk_rows = [row for row in found if row.truth == "junk"]
    assert np.mean([row.status == "ANOMALY" for row in junk_rows]) > 0.7
    rare = [row for row in found if row.truth in CLASSES[2:] and row.status != "ANOMALY"]
    assert np.mean([row.stage == "Confirmed_Rare" for row in rare]) > 0.8
    assert {row.pred_label for row in found} <= {"RRab", "RRc", "RRd", "None"}
    assert all((row.stage == "Filter") == (row.status == "ANOMALY") for row in found)


def test_known_ids_are_skipped(system, catalogue):
    known = [(catalogue.filter("truth = 'RRab'"), "sourceid"), (catalogue.filter("truth = 'RRc'").select(F.col("sourceid").alias("id")), "id")]
    assert score(catalogue, system.bundle, known=known).count() == 360


@pytest.mark.parametrize("kind", [FILTER_ISOLATION, FILTER_RECONSTRUCTION])
def test_bundle_round_trip(spark, labelled, junk, system, catalogue, tmp_path, kind):
    bundle = system.bundle
    if bundle.filter_type != kind:
        from dataclasses import replace

        from raresift.operators.isolation import fit_isolation
        from raresift.operators.reconstruction import fit_linear

        scaled = bundle.scaler.transform(labelled.na.drop().filter("f1 < 1e9"))
        model = fit_isolation(scaled, FEATURES, "sourceid", 20) if kind == FILTER_ISOLATION else fit_linear(scaled, FEATURES, 2)
        bundle = replace(bundle, filter_type=kind, filter_model=model, threshold=None if kind == FILTER_ISOLATION else 0.01)
    place = save_bundle(spark, bundle, str(tmp_path))
    loaded = load_bundle(spark, str(tmp_path), "trial")
    assert (loaded.scaler, loaded.labels, loaded.filter_type, loaded.filter_model, loaded.threshold) == (
        bundle.scaler, bundle.labels, bundle.filter_type, bundle.filter_model, bundle.threshold,
    )
    assert sorted(map(tuple, score(catalogue, loaded).collect())) == sorted(map(tuple, score(catalogue, bundle).collect()))
    part = next(name for name in os.listdir(f"{place}/metadata.json") if name.startswith("part-"))
    with open(f"{place}/metadata.json/{part}") as file:
        assert set(json.load(file)) == {"features", "rare_classes", "filter_type", "ae_threshold", "exp_name"}


def test_missing_bundle(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, str(tmp_path), "nowhere")


def test_messages_follow_verdicts(system, catalogue):
    texts = {row.id: row.message for row in messages(catalogue, system.bundle).collect()}
    stages = {row.id: row.stage for row in score(catalogue, system.bundle).collect()}
    assert texts.keys() == stages.keys()
    assert all((text == "SCONOSCIUTO (Filtro)") == (stages[name] == "Filter") for name, text in texts.items())


@pytest.mark.parametrize("fmt,shards", [("parquet", None), ("csv", 3)])
def test_scoring_to_files(spark, system, catalogue, tmp_path, fmt, shards):
    path = str(tmp_path / "verdicts")
    counts = score_to_files(catalogue, system.bundle, path, fmt=fmt, shards=shards)
    assert counts["rows"] == 760 == counts["ok"] + counts["uncertain"] + counts["anomalies"]
    read = read_verdicts(spark, path, fmt)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, score(catalogue, system.bundle).collect()))
    assert read.filter("id = 'id'").count() == 0
    if shards:
        assert len([name for name in os.listdir(path) if name.startswith("shard=")]) == shards


@pytest.mark.parametrize("per_batch", [None, 1])
def test_stream_equals_batch(spark, system, catalogue, tmp_path, per_batch):
    plain = catalogue.select("sourceid", *FEATURES)
    incoming, outgoing = str(tmp_path / "in"), str(tmp_path / "out")
    plain.filter("f1 < 5").repartition(2).write.option("header", True).csv(incoming)
    known = [(catalogue.filter("truth = 'RRab'"), "sourceid")]

    def run():
        source = stream_catalogue(spark, incoming, plain.schema, files_per_batch=per_batch)
        score_stream(source, system.bundle, outgoing, str(tmp_path / "progress"), known=known).awaitTermination()

    run()
    plain.filter("f1 >= 5").write.mode("append").option("header", True).csv(incoming)
    run()  # only the new files are scored
    batch = score(plain, system.bundle, known=known)
    assert sorted(map(tuple, spark.read.parquet(outgoing).collect())) == sorted(map(tuple, batch.collect()))


def test_stream_scores_an_id_once_over_restarts(spark, system, catalogue, tmp_path, monkeypatch):
    from raresift.operators import sizing

    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)  # the long way of the id list, on a stream too
    rows = catalogue.select("sourceid", *FEATURES).limit(60).cache()
    first, again = rows.limit(40), rows
    incoming, outgoing = str(tmp_path / "in"), str(tmp_path / "out")
    known = [(rows.limit(5).select("sourceid"), "sourceid")]
    nameless = rows.limit(1).withColumn("sourceid", F.lit(None).cast("string"))
    for part in (first.unionByName(first.limit(3)), again.unionByName(nameless), nameless):
        part.coalesce(1).write.mode("append").option("header", True).csv(incoming)
        source = stream_catalogue(spark, incoming, rows.schema)
        score_stream(source, system.bundle, outgoing, str(tmp_path / "progress"), known=known, once_per_id=True).awaitTermination()
    listed = {row[0] for row in known[0][0].collect()}
    ids = [row.id for row in spark.read.parquet(outgoing).collect()]
    assert sorted(filter(None, ids)) == sorted({row.sourceid for row in rows.collect()} - listed)
    assert ids.count(None) == 2


def test_contaminants(spark, system, junk):
    scaler = system.bundle.scaler
    assert load_contaminants(junk, FEATURES, scaler, "sourceid", 100).count() == 100
    assert load_contaminants(None, FEATURES, scaler) is None
    assert load_contaminants(junk.drop("f1"), FEATURES, scaler) is None
    assert load_contaminants(junk.withColumn("f1", F.lit("?")), FEATURES, scaler) is None


def test_training_without_contaminants(labelled):
    made = train(labelled, None, FEATURES, config=CONFIG)
    assert sum(row["rows"] for row in made.reports["contaminant_flow"].filter("step IN ('blocked', 'passed')").collect()) == 200


def test_cascade_variants(labelled):
    coded = labelled.na.drop().filter("f1 < 1e9").withColumn("code", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("bestclassification_1")).cast("int") - 1)
    from dataclasses import replace

    augmented = train_cascade(coded, FEATURES, "code", "sourceid", replace(SMALL, use_augmentation=True))
    assert augmented.specialist.codes == (2, 99)
    # Three common classes: no boosting, and the generalist may be unsure.
    wide = train_cascade(coded, FEATURES, "code", "sourceid", replace(SMALL, rare_codes=(3, 4)))
    assert wide.generalist.codes == (0, 1, 2)
    columns = augmented.score(coded).columns
    assert columns[-5:] == ["p_rare", "spec_label", "spec_conf", "gen_label", "gen_conf"]
    # No rare row at all: the gate never opens.
    common = train_cascade(coded.filter("code < 2"), FEATURES, "code", "sourceid", SMALL)
    assert common.score(coded).agg(F.max("p_rare")).first()[0] == 0.0


@pytest.mark.parametrize("kind", ["rf", "xgb"])
def test_classifier(labelled, kind):
    coded = labelled.na.drop().filter("f1 < 1e9").withColumn("code", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("bestclassification_1")).cast("int") - 1)
    model = train_classifier(coded, FEATURES, "code", kind, trees=5, depth=4)
    made = model.probabilities(with_vector(coded, FEATURES), "p").select("code", "p", F.aggregate("p", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()
    assert all(abs(row.s - 1) < 1e-9 for row in made)
    assert np.mean([int(np.argmax(row.p)) == row.code for row in made]) > 0.9


def test_unknown_classifier(labelled):
    with pytest.raises(ValueError, match="svm"):
        train_classifier(labelled, FEATURES, "f1", "svm")


def test_importance(spark):
    rows = spark.range(600).select(
        "id",
        F.concat(F.lit("id-"), F.col("id")).alias("name"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"),
        (F.col("id") % 7).cast("double").alias("useless"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 3).cast("double").alias("sparse"),
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") != 1, "y").alias("target"),
    )
    found = feature_importance(rows, "target", "id", trees=10, depth=4).collect()
    assert [row.feature for row in found] == ["kind", "useless"]
    assert found[0].importance > found[1].importance and found[0].notable


def test_csv_is_read_by_name(spark, tmp_path):
    path = str(tmp_path / "table.csv")
    os.makedirs(path)
    for name, text in {"a.csv": "f2,sourceid,label,f1\n1.5,625266000000000001,NA,inf\n", "b.csv": "f2,sourceid,label,f1\nx,7,RRc,2\n"}.items():
        with open(f"{path}/{name}", "w") as file:
            file.write(text)
    read = read_catalogue(spark, path, ["f1", "f2"], label="label")
    assert sorted(map(tuple, read.collect())) == [("625266000000000001", None, "inf", "1.5"), ("7", "RRc", "2", "x")]
    assert count_rows(read_table(spark, path)) == 2
    with pytest.raises(MissingColumns):
        read_catalogue(spark, path, ["f9"])
    with open(f"{path}/c.csv", "w") as file:
        file.write("f1,f2,sourceid,label\n1,2,3,RRc\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_catalogue(spark, path, ["f1"]).collect()


def test_optional_lists(spark, tmp_path):
    assert read_optional_ids(spark, None).count() == 0
    assert read_optional_ids(spark, str(tmp_path / "nowhere")).count() == 0
    spark.createDataFrame([("1",)], "other string").write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(MissingColumns):
        read_optional_ids(spark, str(tmp_path / "wrong"))
    lists = read_known_lists(spark, [None, str(tmp_path / "nowhere")], [None])
    assert [column for _, column in lists] == ["sourceid", "sourceid", "id"]


def test_rewrite(spark, tmp_path):
    target = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    listed = spark.createDataFrame([(2, None)], "k int, v string")
    assert rewrite_without(target, listed, str(tmp_path / "new")) == 2
    assert [tuple(row) for row in spark.read.parquet(str(tmp_path / "new")).collect()] == [(1, "a")]
    assert rewrite_without(target, listed.filter("k = 9"), str(tmp_path / "same")) == 0
    assert not os.path.exists(tmp_path / "same")


def test_write_without_shards(spark, tmp_path, system, catalogue):
    write_verdicts(score(catalogue, system.bundle), str(tmp_path / "v"), compact=False)
    assert read_verdicts(spark, str(tmp_path / "v")).count() == 760


def test_thresholds_reach_the_verdicts(spark, system, catalogue, tmp_path):
    save_bundle(spark, system.bundle, str(tmp_path))
    loaded = load_bundle(spark, str(tmp_path), "trial")
    assert loaded.best_threshold == system.threshold

    def stages(name, **limits):
        score_to_files(catalogue, loaded, str(tmp_path / name), **limits)
        return {row.stage for row in read_verdicts(spark, str(tmp_path / name)).select("stage").distinct().collect()}

    assert "Confirmed_Rare" in stages("usual")
    assert "Confirmed_Rare" not in stages("strict", threshold=1.1)
    assert stages("shut", gate=1.1) == {"Filter", "Direct_Generalist"}


def test_versions_outlive_a_killed_write(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        read_version(spark, root)
    rows = spark.range(100).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3).alias("v"))
    first = write_version(rows.unionByName(rows.limit(5)), root)
    reader = read_version(spark, root)
    assert rewrite_version_without(spark, root, rows.filter("id < 20")) == 25
    assert reader.count() == 105 and read_version(spark, root).count() == 80  # readers keep what they have
    second = current_version(spark, root)
    broken = F.udf(lambda value: 1 // (value - 70), "bigint")
    with pytest.raises(Exception):
        write_version(read_version(spark, root).withColumn("v", broken("id")), root)
    assert current_version(spark, root) == second and read_version(spark, root).count() == 80
    assert rewrite_version_without(spark, root, rows.filter("id < 20")) == 0 and current_version(spark, root) == second
    assert read_version(spark, root, first).count() == 105
    assert rewrite_version_without(spark, root, rows) == 80 and read_version(spark, root).columns == ["id", "v"]
