"""Selection by counted bits against numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from raresift.operators import selection
from raresift.operators.selection import exact_percentile, exact_percentiles, from_ordered_bits, ordered_bits, values_at_ranks

ODD = np.array([0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.0, np.nextafter(1.0, 2.0), -1e308, 1e308, 2.5, 2.5, 2.5])
TABLES = {
    "spread": np.random.default_rng(1).normal(size=4001),
    "third_equal": np.r_[np.full(1500, 0.25), np.random.default_rng(2).uniform(size=3000)],
    "few_values": np.random.default_rng(3).integers(-2, 4, 3000).astype(float),
    "all_equal": np.full(2000, 7.0),
    "close": 1.0 + np.random.default_rng(4).integers(0, 1000, 3000) * 2.0**-52,
    "two": np.array([1.0, 2.0]),
    "one": np.array([-3.0]),
}
PERCENTILES = [0.0, 1.0, 37.5, 50.0, 95.0, 99.99, 100.0]


def test_bits_sort_like_values():
    values = np.sort(ODD)
    bits = ordered_bits(values)
    assert (bits[1:] >= bits[:-1]).all()
    assert [from_ordered_bits(int(b)) for b in bits] == list(values)


@pytest.mark.parametrize("fetched", [0, 9_000, 200_000])
def test_many_columns_at_once(spark, monkeypatch, fetched):
    monkeypatch.setattr(selection, "FETCHED", fetched)
    longest = max(len(values) for values in TABLES.values())
    frame = pd.DataFrame({name: np.r_[values, np.full(longest - len(values), np.nan)] for name, values in TABLES.items()})
    rows = spark.createDataFrame(frame)
    made = [exact_percentiles(rows.repartition(parts), list(TABLES), PERCENTILES) for parts in (1, 7)]
    assert made[0] == made[1]
    for values, found in zip(TABLES.values(), made[0], strict=True):
        assert found == pytest.approx(np.percentile(values, PERCENTILES), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("fetched", [0, 200_000])
def test_odd_values(spark, monkeypatch, fetched):
    monkeypatch.setattr(selection, "FETCHED", fetched)
    rows = spark.createDataFrame([(float(v),) for v in ODD] + [(None,), (math.nan,)], "v double")
    assert values_at_ranks(rows, ["v"], [range(len(ODD))])[0] == list(np.sort(ODD))


def test_columns_without_values(spark):
    rows = spark.createDataFrame([(None, 1), (None, 3)], "v double, w int")
    assert exact_percentiles(rows, ["v", "w"], [50.0]) == [[None], [2.0]]
    assert exact_percentile(spark.createDataFrame([], "v double"), "v", 95.0) is None


def test_four_passes(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(selection, "FETCHED", 0)
    counted = selection._count_digits
    monkeypatch.setattr(selection, "_count_digits", lambda *given: passes.append(1) or counted(*given))
    rows = spark.createDataFrame([(float(v),) for v in TABLES["close"]], "v double")
    exact_percentile(rows, "v", 95.0)
    assert len(passes) == selection.PASSES == 4
