"""Splits and samples: exact sizes, the same rows however the table is partitioned."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from raresift.operators.metrics import with_balanced_weight
from raresift.operators.sampling import (
    allocate,
    augmented_specialist_sample,
    balanced_bootstrap,
    cap_rows,
    gaussian_augment,
    holdout,
    shard_of,
    specialist_quotas,
    specialist_sample,
    split_rows,
    stratified_split,
    uniform_noise,
    uniform_noise_like,
)


@pytest.fixture(scope="module")
def table(spark):
    """Class 0 holds most rows, class 4 only a few."""
    code = F.when(F.col("n") < 1400, 0).when(F.col("n") < 1700, 1).when(F.col("n") < 1950, 2).when(F.col("n") < 1990, 3).otherwise(4)
    rows = spark.range(2000).withColumnRenamed("id", "n")
    return rows.select(F.col("n").cast("string").alias("id"), code.alias("code"), (F.col("n") % 17 / 16.0).alias("x"), F.lit(3.0).alias("c")).cache()


@given(st.dictionaries(st.integers(0, 20), st.integers(2, 10_000), min_size=1), st.floats(0.01, 0.99))
@settings(max_examples=200, deadline=None)
def test_allocation_is_exact_and_close(counts, share):
    wanted = math.ceil(share * sum(counts.values()))
    given_rows = allocate(counts, wanted)
    assert sum(given_rows.values()) == wanted
    for name, rows in counts.items():
        assert abs(given_rows[name] - rows * wanted / sum(counts.values())) < 1
        assert given_rows[name] <= rows


def test_split_sizes_per_class(table):
    found = Counter((row.code, row.is_test) for row in stratified_split(table, "code", "id").collect())
    assert [found[(code, True)] for code in range(5)] == [280, 60, 50, 8, 2]
    assert sum(found.values()) == 2000


@pytest.mark.parametrize("partitions", [1, 7])
def test_draws_do_not_depend_on_partitions(table, partitions):
    other = table.repartition(partitions)

    def ids(df):
        return sorted(row.id for row in df.collect())

    assert ids(stratified_split(table, "code", "id").filter("is_test")) == ids(stratified_split(other, "code", "id").filter("is_test"))
    assert ids(cap_rows(table, "id", 100)) == ids(cap_rows(other, "id", 100))
    assert ids(specialist_sample(table, "code", "id")) == ids(specialist_sample(other, "code", "id"))
    assert ids(holdout(table, "id").filter("is_validation")) == ids(holdout(other, "id").filter("is_validation"))
    pairs = [sorted((row.bag, row.code, row.draw, row.id) for row in balanced_bootstrap(df, "code", "id", 2).collect()) for df in (table, other)]
    assert pairs[0] == pairs[1]


def test_split_parts_are_disjoint(table):
    train, test = split_rows(stratified_split(table, "code", "id"))
    assert train.columns == test.columns == table.columns
    assert train.join(test, "id").count() == 0
    assert train.count() + test.count() == 2000


def test_split_refuses_a_class_of_one(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, label string")
    with pytest.raises(ValueError, match="b"):
        stratified_split(rows, "label", "id")


def test_holdout_share(table):
    assert 150 <= holdout(table, "id").filter("is_validation").count() <= 250


def test_cap(table):
    assert cap_rows(table, "id", 100).count() == 100
    assert cap_rows(table, "id", 2000) is table
    assert cap_rows(table, "id", 100).columns == table.columns


@pytest.mark.parametrize(
    "rare,common,expected",
    [(5000, 5000, (924, 100)), (924, 5000, (924, 100)), (300, 5000, (300, 724)), (300, 50, (300, 50)), (0, 5000, (0, 1024))],
)
def test_specialist_quotas(rare, common, expected):
    assert specialist_quotas(rare, common) == expected


def test_specialist_sample(table):
    found = Counter(row.spec_code for row in specialist_sample(table, "code", "id").collect())
    assert found == {2: 300, 99: 724}
    small = Counter(row.spec_code for row in specialist_sample(table, "code", "id", total=150, min_common=100).collect())
    assert small == {2: 50, 99: 100}


def test_augmentation(table):
    rare = table.filter("code > 1")
    made = gaussian_augment(rare, ["x", "c"], "id", 500, 0.03).toPandas()
    assert len(made) == 300 * (1 + 500 // 300)
    originals = made[made["copy"] == 0]
    assert len(originals) == 300
    noise = made[made["copy"] == 1].set_index("id").x - originals.set_index("id").x
    spread = np.std(originals.x)
    assert abs(noise.mean()) < 4 * spread * 0.03 / math.sqrt(300) and 0.8 < noise.std() / (spread * 0.03) < 1.2
    # A constant feature gets noise of unit spread.
    assert 0.8 < (made[made["copy"] == 1].c - 3.0).std() / 0.03 < 1.2
    assert gaussian_augment(rare, ["x"], "id", 300).filter("copy > 0").count() == 0


def test_augmented_specialist_table(table):
    found = Counter((row.spec_code, row.copy) for row in augmented_specialist_sample(table, ["x"], "code", "id").collect())
    assert found == {(2, 0): 300, (2, 1): 300, (99, 0): 500}


def test_noise(spark, table):
    values = uniform_noise(spark, ["a", "b"]).toPandas()
    assert len(values) == 200 and values.a.between(-0.2, 1.2).all() and values.a.min() < 0 and values.b.max() > 1
    assert uniform_noise_like(table, ["a"], "id").count() == 2000


def test_bootstrap_is_balanced(table):
    drawn = balanced_bootstrap(table, "code", "id", 3).collect()
    assert set(Counter((row.bag, row.code) for row in drawn).values()) == {10}
    assert len(drawn) == 3 * 5 * 10


def test_shards_cover_all_rows(table):
    found = Counter(row.shard for row in shard_of(table, "id", 4).collect())
    assert set(found) == {0, 1, 2, 3} and sum(found.values()) == 2000 and min(found.values()) > 400


def test_very_many_classes_and_boolean_ones(spark):
    """10,001 classes are split and weighed like few; a class may be true or false."""
    rows = spark.range(30_003).select(F.col("id"), F.concat(F.lit("c"), F.col("id") % 10_001).alias("label"))
    marked = stratified_split(rows, "label", "id", 0.5)
    assert marked.filter("is_test").count() == 15_002
    per_class = marked.groupBy("label").agg(F.count_if("is_test").alias("n"))
    assert per_class.count() == 10_001 and per_class.filter("n NOT BETWEEN 1 AND 2").count() == 0
    weighed = with_balanced_weight(rows, "label").agg(F.min("weight"), F.max("weight")).first()
    assert weighed[0] == weighed[1] == pytest.approx(1.0)
    flags = spark.range(100).select("id", (F.col("id") < 20).alias("label"))
    assert stratified_split(flags, "label", "id", 0.2).filter("is_test").groupBy("label").count().orderBy("label").collect() == [(False, 16), (True, 4)]
    assert {(row.label, row.weight) for row in with_balanced_weight(flags, "label").collect()} == {(True, 2.5), (False, 0.625)}
