"""Coercion, missing values, scaling and codes."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from raresift.functions.values import finite_or_null, is_finite, position_of_max, text_to_number
from raresift.operators.cleaning import (
    clean_features,
    coerce_features,
    drop_columns,
    drop_missing,
    id_like_columns,
    impute_constant,
    normalise_missing,
    require_target,
    with_valid_flag,
)
from raresift.operators.encoding import LabelCodes, factorize, fit_labels, label_table, merged_code
from raresift.operators.scaling import fit_minmax
from raresift.schema import MissingColumns, preset, project_features, require_columns, split_by_type

GOOD = {"1": 1.0, " 1.5 ": 1.5, "-.5": -0.5, "+3.": 3.0, "1e5": 1e5, "2E-3": 0.002, "-0": 0.0}
BAD = ["1.5d", "2f", "1_000", "?", "", " ", "NA", "null", "0x10", "1,5", "--1", "e5", "."]


@pytest.mark.parametrize("text,number", GOOD.items())
def test_number_from_text(spark, text, number):
    assert spark.range(1).select(text_to_number(F.lit(text))).first()[0] == number


@pytest.mark.parametrize("text", BAD)
def test_text_that_is_no_number(spark, text):
    assert spark.range(1).select(text_to_number(F.lit(text))).first()[0] is None


def test_infinite_text_is_read_and_then_missing(spark):
    row = spark.range(1).select(
        text_to_number(F.lit("-Infinity")).alias("a"), finite_or_null(text_to_number(F.lit("inf"))).alias("b"),
        text_to_number(F.lit("nan")).alias("c"),
    ).first()
    assert row.a == -math.inf and row.b is None and math.isnan(row.c)


@pytest.fixture()
def dirty(spark):
    rows = [("a", "1", 1.0), ("b", "x", 2.0), ("c", "3", math.nan), ("d", "4", math.inf), ("e", None, 5.0), ("f", "6", 6.0)]
    return spark.createDataFrame(rows, "id string, text string, number double")


def test_cleaning_keeps_complete_finite_rows(dirty):
    kept = {row.id for row in clean_features(dirty, ["text", "number"]).collect()}
    assert kept == {"a", "f"}
    flagged = {row.id for row in with_valid_flag(coerce_features(dirty, ["text"]), ["text", "number"]).filter("is_valid").collect()}
    assert flagged == kept
    slow = drop_missing(normalise_missing(coerce_features(dirty, ["text", "number"]), ["text", "number"]), ["text", "number"])
    assert {row.id for row in slow.collect()} == kept


def test_kept_and_dropped_add_up(dirty):
    assert drop_missing(dirty, ["number"]).count() + dirty.filter("isnan(number)").count() == dirty.count()


def test_impute_and_target(dirty):
    filled = {row.id: row.number for row in impute_constant(dirty, ["number"]).collect()}
    assert filled["c"] == -999.0 and filled["d"] == -999.0  # infinite is missing
    assert require_target(dirty, "number").count() == 5
    assert require_target(dirty, "text").count() == 5


def test_missing_columns_raise(dirty):
    with pytest.raises(MissingColumns, match="nowhere"):
        require_columns(dirty, ["nowhere"])
    with pytest.raises(MissingColumns):
        project_features(dirty, "default", "id")
    assert drop_columns(dirty, ["text", "nowhere"]).columns == ["id", "number"]


def test_presets_keep_their_order():
    assert len(preset()) == 17 and preset()[0] == "phi21" and preset()[-1] == "nhg1"
    with pytest.raises(KeyError):
        preset("unknown")


def test_types_are_split(dirty):
    assert split_by_type(dirty) == (["id", "text"], ["number"])


def test_id_like_column(spark):
    rows = spark.range(1000).select(
        F.col("id").cast("string").alias("own"),
        (F.col("id") % 949).cast("string").alias("nearly"),
        (F.col("id") % 951).cast("string").alias("just"),
        F.lit("same").alias("one"),
    )
    assert id_like_columns(rows) == ["own", "just"]


def test_constant_feature_scales_to_zero(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    scaler = fit_minmax(rows, ["a", "c"])
    assert [tuple(row) for row in scaler.transform(rows).orderBy("a").collect()] == [(0.0, 0.0), (1.0, 0.0)]
    beyond = spark.createDataFrame([(5.0, 6.0)], "a double, c double")
    assert tuple(scaler.transform(beyond).first()) == (2.0, 1.0)
    assert tuple(scaler.inverse(scaler.transform(beyond)).first()) == (5.0, 6.0)


def test_scaler_needs_rows(spark):
    with pytest.raises(ValueError):
        fit_minmax(spark.createDataFrame([], "a double"), ["a"])


def test_codes_and_labels(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), (None,), ("a",)], "label string")
    labels = fit_labels(rows, "label")
    assert labels == LabelCodes(("a", "b", "c"))
    assert {(row.label, row.code) for row in label_table(rows, "label").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    coded = labels.encode(rows, "label", "code")
    assert sorted((row.label or "", row.code) for row in coded.collect() if row.label) == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]
    assert coded.filter("label IS NULL").first().code is None
    shown = spark.createDataFrame([(0,), (7,)], "code int").select(labels.decoded(F.col("code")))
    assert [row[0] for row in shown.collect()] == ["a", "7"]


def test_factorize_by_first_appearance(spark):
    rows = spark.createDataFrame([(5, "x"), (1, "z"), (2, None), (3, "x"), (4, "y")], "at int, v string")
    found = {row.at: row.code for row in factorize(rows, "v", "at").collect()}
    assert found == {1: 0, 2: -1, 3: 1, 4: 2, 5: 1}


def test_merge(spark):
    codes = spark.range(5).select(merged_code(F.col("id").cast("int"), (2, 3, 4)).alias("m"))
    assert [row.m for row in codes.collect()] == [0, 1, 2, 2, 2]


def test_position_of_max_takes_the_first(spark):
    assert spark.range(1).select(position_of_max(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)))).first()[0] == 1


def test_is_finite(spark):
    values = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "v double")
    assert [row[0] for row in values.select(is_finite(F.col("v"))).collect()] == [True, False, False, False, False]
