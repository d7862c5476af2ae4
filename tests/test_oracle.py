"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest
from comparing import database, differences

import __spark_entry__ as registered
from raresift.plans.registry import QUERIES as CORE

QUERIES = {name: query.run for name, query in CORE.items()}
ORACLE = {name: query.sql for name, query in CORE.items() if query.sql is not None}
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE))


@pytest.fixture(scope="module")
def tables(folder):
    connection = database(folder)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, folder, tables, name):
    assert differences(QUERIES[name](spark, folder), tables, ORACLE[name]) == ""


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_model_query_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    result = registered.entry(spark)
    assert result.columns == ["id", "status", "pred_label", "confidence", "stage", "filter_score"]
    assert result.count() > 0


def test_registry_is_consistent():
    assert set(QUERIES) <= set(registered.queries())
    assert set(registered.oracle_sql()) <= set(registered.queries())
