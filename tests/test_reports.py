"""Profiles, confusion counts, reports and weights against plain recounts."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.constants import FILTER_ISOLATION, FILTER_RECONSTRUCTION
from raresift.operators.encoding import LabelCodes
from raresift.operators.metrics import (
    best_threshold,
    binary_counts,
    choose_filter,
    classification_report,
    confusion,
    confusion_matrix,
    evaluate_predictions,
    filter_rates,
    sweep_scores,
    threshold_sweep,
    with_balanced_weight,
)
from raresift.operators.profiling import (
    class_distribution,
    contaminant_report,
    guess_label_column,
    missing_counts,
    missing_inclusion,
    missing_patterns,
    quality_report,
    row_counts,
    top_labels,
)

PAIRS = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] + [(2, 0)] * 2


@pytest.fixture(scope="module")
def judged(spark):
    return spark.createDataFrame(PAIRS, "y int, p int")


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [(1.0, None, 1.0), (None, None, 2.0), (3.0, None, math.nan), (4.0, 4.0, math.inf), (5.0, 5.0, 5.0)]
    return spark.createDataFrame(rows, "a double, b double, c double")


def test_missing_counts_are_ordered(gappy):
    found = [(row.column, row.missing, row.percent) for row in missing_counts(gappy, ["a", "b", "c"]).collect()]
    assert found == [("b", 3, 60.0), ("a", 1, 20.0), ("c", 1, 20.0)]


def test_inclusion(gappy):
    found = {row.minor: (row.major, row.minor_missing, row.mismatch, row.is_subset) for row in missing_inclusion(gappy, ["a", "b", "c"]).collect()}
    assert found == {"a": ("b", 1, 0, True), "c": ("b", 1, 0, True)}


def test_inclusion_without_gaps(spark):
    full = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert missing_inclusion(full, ["a", "b"]).count() == 0


def test_patterns_cover_all_rows(gappy):
    patterns = missing_patterns(gappy, ["a", "b", "c"]).collect()
    assert sum(row["rows"] for row in patterns) == 5 and len(patterns) == 4


def test_row_counts(gappy):
    assert tuple(row_counts(gappy, ["a", "b", "c"]).first()) == (5, 2, 3, 60.0)


def test_quality(gappy):
    found = {row.feature: (row.nans, row.infs, row.total_bad, row.percent_bad, row.valid_rows) for row in quality_report(gappy, ["a", "b", "c"]).collect()}
    assert found == {"a": (1, 0, 1, 20.0, 1), "b": (3, 0, 3, 60.0, 1), "c": (1, 1, 2, 40.0, 1)}


def test_distribution(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string")
    assert [(row.label, row["rows"]) for row in class_distribution(rows, "label").collect()] == [("a", 1), ("b", 2)]
    assert [row.label for row in class_distribution(rows, "label", by_count=True).collect()] == ["b", "a"]
    assert sum(row.percent for row in class_distribution(rows, "label").collect()) == pytest.approx(100)
    assert guess_label_column(rows) == "label"
    assert [row.label for row in top_labels(rows, limit=1).collect()] == ["b"]
    with pytest.raises(ValueError):
        top_labels(rows.withColumnRenamed("label", "other"))


def test_contaminant_report_parts(gappy):
    assert set(contaminant_report(gappy, ["a", "b"])) == {"missing", "inclusion", "rows"}
    named = gappy.withColumn("class", F.lit("EB"))
    assert [row.label for row in contaminant_report(named, ["a", "b"])["kinds"].collect()] == ["EB"]
    assert "kinds" not in contaminant_report(gappy, ["a"], label="nowhere")


def test_confusion(judged):
    found = {(row.truth, row.predicted): row["rows"] for row in confusion_matrix(judged, "y", "p").collect()}
    assert found == {(0, 0): 5, (0, 1): 2, (0, 2): 0, (1, 0): 1, (1, 1): 3, (1, 2): 0, (2, 0): 2, (2, 1): 0, (2, 2): 0}
    assert confusion(judged, "y", "p").count() == 5


def test_report_equals_a_recount(judged):
    report = {row.label: row for row in classification_report(judged, "y", "p").collect()}
    for label in (0, 1, 2):
        hits = sum(y == p == label for y, p in PAIRS)
        claimed, support = sum(p == label for _, p in PAIRS), sum(y == label for y, _ in PAIRS)
        row = report[str(label)]
        assert row.precision == pytest.approx(hits / claimed if claimed else 0)
        assert row.recall == pytest.approx(hits / support)
        assert row.f1 == pytest.approx(2 * hits / (claimed + support))
        assert row.support == support
    assert report["accuracy"].f1 == pytest.approx(8 / 13)
    assert report["macro avg"].recall == pytest.approx((5 / 7 + 3 / 4 + 0) / 3)
    assert report["weighted avg"].recall == pytest.approx(8 / 13)


def test_report_of_nothing(judged):
    assert classification_report(judged.filter("y > 9"), "y", "p").filter("label NOT IN ('accuracy', 'macro avg', 'weighted avg')").count() == 0


def test_report_per_key(judged):
    twice = judged.withColumn("k", F.lit("a")).unionByName(judged.withColumn("k", F.lit("b")))
    assert classification_report(twice, "y", "p", ["k"]).count() == 2 * classification_report(judged, "y", "p").count()


def test_decoded_names(judged):
    report, matrix = evaluate_predictions(judged, "y", "p", LabelCodes(("x", "y", "z")))
    assert {row.label for row in report.collect()} == {"x", "y", "z", "accuracy", "macro avg", "weighted avg"}
    assert matrix.count() == 9


def test_binary_counts_with_one_class(spark):
    rows = spark.createDataFrame([(True, True), (True, False)], "t boolean, p boolean")
    assert tuple(rows.agg(*binary_counts(F.col("t"), F.col("p"))).first()) == (0, 0, 1, 1)


def test_weights(judged):
    weights = {row.y: row.weight for row in with_balanced_weight(judged, "y").collect()}
    assert weights == pytest.approx({0: 13 / 21, 1: 13 / 12, 2: 13 / 6})


def _rates(spark, *rows):
    return spark.createDataFrame(rows, "filter string, valid_accepted double, noise_rejected double")


@pytest.mark.parametrize(
    "isolation,reconstruction,winner",
    [
        ((0.99, 0.6), (0.96, 0.7), FILTER_RECONSTRUCTION),
        ((0.99, 0.6), (0.95, 0.9), FILTER_ISOLATION),  # 0.95 itself is not enough
        ((0.99, 0.6), (0.99, 0.6), FILTER_RECONSTRUCTION),
        ((0.99, 0.0), (0.99, 0.0), FILTER_RECONSTRUCTION),
        ((0.90, 1.0), (0.99, 0.4), FILTER_ISOLATION),
    ],
)
def test_filter_choice(spark, isolation, reconstruction, winner):
    rates = _rates(spark, (FILTER_ISOLATION, *isolation), (FILTER_RECONSTRUCTION, *reconstruction))
    assert choose_filter(rates).first()["filter"] == winner


def test_rates_without_noise(spark):
    rows = spark.createDataFrame([(True,), (False,), (False,), (False,)], "flag boolean")
    found = filter_rates(rows, None, {FILTER_ISOLATION: "flag"}).first()
    assert (found.valid_accepted, found.noise_rejected) == (0.75, 0.0)
    found = filter_rates(rows, rows.filter("flag"), {FILTER_ISOLATION: "flag"}).first()
    assert (found.valid_accepted, found.noise_rejected) == (0.75, 1.0)


def test_sweep(spark):
    rows = spark.createDataFrame([(2, 0.95), (2, 0.8), (0, 0.85), (0, 0.1)], "y int, s double")
    swept = threshold_sweep(rows, F.col("y") == 2, lambda value: F.col("s") >= value, [0.5, 0.9, 0.99])
    found = {row.threshold: (row.tp, row.fp, row.fn, row.f1) for row in swept.collect()}
    assert found == {0.5: (2, 1, 0, pytest.approx(0.8)), 0.9: (1, 0, 1, pytest.approx(2 / 3)), 0.99: (0, 0, 2, 0.0)}
    assert best_threshold(swept) == 0.5
    assert best_threshold(swept.filter("threshold > 0.95")) == 0.5


def test_sweep_over_scores_equals_one_threshold_at_a_time(spark):
    draw = np.random.default_rng(8)
    values = [(int(y), float(np.round(s, 2)), bool(a)) for y, s, a in zip(draw.integers(0, 3, 400), draw.uniform(0, 1, 400), draw.random(400) < 0.7)]
    rows = spark.createDataFrame([*values, (2, None, True), (2, 0.5, None)], "y int, s double, a boolean")
    asked = [0.9, 0.1, 0.5, 0.5, -1.0, 2.0]
    truth, able = F.col("y") == 2, F.col("a")
    one = threshold_sweep(rows, truth, lambda value: able & (F.col("s") >= value), asked)
    many = sweep_scores(rows, truth, able, "s", asked).orderBy("place")
    assert [tuple(row) for row in many.select(one.columns).collect()] == [tuple(row) for row in one.orderBy("place").collect()]
    every = sweep_scores(rows, truth, able, "s")
    seen = sorted({s for _, s, a in values if a})
    assert [row.threshold for row in every.orderBy("place").collect()] == seen
    assert sweep_scores(rows.limit(0), truth, able, "s").count() == 0


def test_ten_thousand_thresholds_in_one_aggregate(spark):
    rows = spark.range(30_000).select((F.col("id") % 3 == 0).alias("t"), (F.col("id") / 30_000).alias("s"))
    found = sweep_scores(rows, F.col("t"), F.lit(True), "s", [step / 10_000 for step in range(10_000)])
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Range (0, 30000") == 1 and "Python" not in text
    row = found.filter("place = 5000").first()
    assert (row.tp, row.fp, row.fn) == (5000, 10000, 5000) and found.count() == 10_000


def test_sweep_tries_every_one_of_many_scores(spark):
    rows = spark.range(30_000).select((F.col("id") >= 29_998).alias("t"), (F.col("id") / 30_000).alias("s"))
    rows = rows.unionByName(spark.createDataFrame([(True, None), (False, float("nan"))], "t boolean, s double"))
    swept = sweep_scores(rows, F.col("t"), F.lit(True), "s")
    assert swept.count() == 30_000
    assert best_threshold(swept) == 29_998 / 30_000
    row = swept.filter("place = 29998").first()
    assert (row.tp, row.fp, row.fn) == (2, 1, 1)  # a NaN reaches every threshold, a missing score none
