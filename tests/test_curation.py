"""Known-id exclusion and row differences."""

from __future__ import annotations

import pytest

from raresift.operators import curation
from raresift.operators.curation import (
    delete_rows,
    deletion_counts,
    exclude_known,
    filter_known_sources,
    known_source_stats,
    order_by_size,
    row_delta,
    rows_absent_from,
    union_ids,
)
from raresift.schema import MissingColumns


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame([("1", 1.0), ("2", 2.0), ("2", 2.5), ("3", 3.0), (None, 4.0)], "sourceid string, v double")


@pytest.fixture(scope="module")
def lists(spark):
    training = spark.createDataFrame([(2,), (2,), (9,), (None,)], "sourceid long")
    done = spark.createDataFrame([("3",), ("2",)], "id string")
    return {"training": (training, "sourceid"), "done": (done, "id")}


@pytest.mark.parametrize("broadcast", [True, False])
def test_listed_rows_go_and_rows_without_id_stay(monkeypatch, catalogue, lists, broadcast):
    if not broadcast:
        monkeypatch.setattr(curation, "broadcast_if_small", lambda ids, column: ids.hint("merge"))
    kept = exclude_known(catalogue, list(lists.values()), "sourceid")
    assert sorted(row.v for row in kept.collect()) == [1.0, 4.0]
    assert kept.columns == catalogue.columns


def test_result_is_disjoint_from_the_lists(catalogue, lists):
    ids = union_ids(list(lists.values()))
    assert sorted(row.id for row in ids.collect()) == ["2", "3", "9"]
    kept = exclude_known(catalogue, list(lists.values()), "sourceid")
    assert kept.join(ids, kept.sourceid == ids.id).count() == 0


def test_statistics(catalogue, lists):
    found = {row["list"]: (row.listed_ids, row.removed_rows, row.residual_rows) for row in known_source_stats(catalogue, lists, "sourceid").collect()}
    assert found == {"training": (2, 2, 2), "done": (2, 3, 2), "any": (None, 3, 2)}


def test_without_the_id_column_nothing_goes(catalogue, lists):
    kept, stats = filter_known_sources(catalogue, lists, "other")
    assert kept.count() == 5
    assert {row.removed_rows for row in stats.collect()} == {0}


def test_no_list(catalogue):
    assert exclude_known(catalogue, [], "sourceid").count() == 5
    with pytest.raises(ValueError):
        union_ids([])


def test_delta_treats_missing_as_equal_and_keeps_copies(spark):
    first = spark.createDataFrame([(1, None), (1, None), (2, "b"), (3, "c"), (3, "c")], "a int, b string")
    second = spark.createDataFrame([("b", 2), (None, 1)], "b string, a int")
    assert [tuple(row) for row in row_delta(second, first).collect()] == [(3, "c"), (3, "c")]


def test_the_first_is_larger_on_a_tie(spark):
    first, second = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    assert order_by_size(first, second)[0] is first


def test_deletion_matches_on_common_columns_only(spark):
    target = spark.createDataFrame([(1, "x", 0.1), (2, "y", 0.2), (2, "y", 0.3)], "a int, b string, extra double")
    listed = spark.createDataFrame([(2, "y", True), (2, "y", False)], "a int, b string, other boolean")
    assert [row.a for row in delete_rows(target, listed).collect()] == [1]
    assert tuple(deletion_counts(target, listed).first()) == (3, 2, 1)
    with pytest.raises(MissingColumns):
        rows_absent_from(target, spark.createDataFrame([(1,)], "z int"))
