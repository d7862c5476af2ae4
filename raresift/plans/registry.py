"""Register of named queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run

    return register


def with_parts(parts: Sequence[str], body: str) -> str:
    return f"WITH {', '.join(parts)}\n{body}"


def rounded(name: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns a negative zero into zero."""
    column = F.col(name) if isinstance(name, str) else name
    return F.round(column, digits) + F.lit(0.0)


def sql_rounded(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + CAST(0 AS DOUBLE))"


def round_all(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({name: rounded(name, digits) for name in names})
