"""Exact selection without gathering groups, including very uneven groups and repeated values."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.operators import ordering
from raresift.operators.ordering import mark_smallest, numbered, ranked_by_key, smallest_key_cutoffs, sums_before


@pytest.fixture(scope="module")
def keyed(spark):
    """One group holds nine tenths of the rows."""
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 10 == 0, F.lit("small")).otherwise(F.lit("large")).alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("k")
    )
    return rows.cache()


@pytest.mark.parametrize("task_rows", [200_000, 100, 3])
@pytest.mark.parametrize("quotas", [{"small": 37, "large": 1234}, {"small": 0, "large": 4500}, {"small": 1, "large": 4499}])
def test_cutoffs_keep_the_quota(monkeypatch, keyed, task_rows, quotas):
    monkeypatch.setattr(ordering.digits_for, "__defaults__", (task_rows,))
    counts = {"small": 500, "large": 4500}
    cutoffs = smallest_key_cutoffs(keyed, "g", "k", quotas, counts)
    everything = keyed.collect()
    for group, quota in quotas.items():
        keys = sorted(row.k for row in everything if row.g == group)
        assert [key for key in keys if key <= cutoffs[group].key] == keys[:quota]


@pytest.fixture(scope="module")
def repeated(spark):
    """Nine tenths of a group share one key: half of those differ in content, half are equal throughout."""
    hot = hashlib.md5(b"hot").hexdigest()
    rows = [("g", hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(200)]
    rows += [("g", hot, i) for i in range(900)] + [("g", hot, -1)] * 900 + [("h", hot, 5)] * 50
    return spark.createDataFrame(rows, "g string, k string, v int").repartition(5).cache()


@pytest.mark.parametrize("task_rows", [200_000, 20])
@pytest.mark.parametrize("quota", [1, 150, 700, 1300, 1999])
def test_quotas_are_exact_among_copies(monkeypatch, repeated, task_rows, quota):
    monkeypatch.setattr(ordering.digits_for, "__defaults__", (task_rows,))
    marked = mark_smallest(repeated, "g", "k", {"g": quota, "h": 20}, {"g": 2000, "h": 50}, "taken")
    assert marked.columns == ["g", "k", "v", "taken"]
    rows = marked.collect()
    assert sum(row.taken for row in rows if row.g == "g") == quota
    assert sum(row.taken for row in rows if row.g == "h") == 20
    assert Counter((row.g, row.k, row.v) for row in rows) == Counter(map(tuple, repeated.collect()))
    keys = sorted(row.k for row in repeated.collect() if row.g == "g")
    assert sorted(row.k for row in rows if row.taken and row.g == "g") == keys[:quota]


def test_rank_with_a_hot_key(monkeypatch, repeated):
    monkeypatch.setattr(ordering.digits_for, "__defaults__", (50,))
    monkeypatch.setattr(ordering, "TASK_ROWS", 50)
    ranked = ranked_by_key(repeated, "g", "k", "place", 2000)
    assert sorted(row.place for row in ranked.filter("g = 'g'").collect()) == list(range(2000))
    assert ranked.filter("g = 'g'").select("k", "v").exceptAll(repeated.filter("g = 'g'").select("k", "v")).count() == 0


@pytest.mark.parametrize("task_rows", [200_000, 50])
def test_rank_by_key(monkeypatch, keyed, task_rows):
    monkeypatch.setattr(ordering.digits_for, "__defaults__", (task_rows,))
    ranked = ranked_by_key(keyed, "g", "k", "place", 4500).collect()
    for group in ("small", "large"):
        rows = sorted((row for row in ranked if row.g == group), key=lambda row: row.k)
        assert [row.place for row in rows] == list(range(len(rows)))


@pytest.mark.parametrize("task_rows", [1_000_000, 10])
def test_numbered(spark, task_rows):
    values = spark.createDataFrame([(f"v{i:04d}",) for i in random.Random(1).sample(range(9000), 700)], "v string")
    found = numbered(values, "v", "n", task_rows).collect()
    assert [row.n for row in sorted(found, key=lambda row: row.v)] == list(range(700))


def test_sums_before_by_ranges(spark):
    rows = spark.range(3_000).select(((F.col("id") * 7) % 3_000 / 10).alias("x"), (F.col("id") % 11).alias("n"), F.lit(1).alias("one"))
    found = sums_before(rows, "x", {"upto": "n", "place": "one"}, task_rows=50)
    assert found.columns == ["x", "n", "one", "upto", "place"]
    upto = 0
    for place, row in enumerate(found.orderBy("x").collect()):
        assert (row.upto, row.place) == (upto, place)
        upto += row.n
    assert sums_before(rows, "x", {"upto": "n"}).exceptAll(found.select("x", "n", "one", "upto")).isEmpty()
