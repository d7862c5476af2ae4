"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)  # exact, and -0.0 is not 0.0
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return str(value)
    return value


def spark_rows(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(_plain(row[name]) for name in names) for row in df.collect())


def sql_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    columns = [entry[0] for entry in cursor.description]
    order = sorted(range(len(columns)), key=lambda place: columns[place])
    rows = Counter(tuple(_plain(row[place]) for place in order) for row in cursor.fetchall())
    return [columns[place] for place in order], rows


def differences(df, connection, sql: str) -> str:
    """Empty when both give the same columns and rows."""
    columns, expected = sql_rows(connection, sql)
    if sorted(df.columns) != columns:
        return f"columns {sorted(df.columns)} != {columns}"
    found = spark_rows(df)
    if found == expected:
        return ""
    missing, extra = expected - found, found - expected
    return (
        f"{columns}: {sum(found.values())} rows against {sum(expected.values())}; "
        f"missing {list(missing.items())[:3]}; extra {list(extra.items())[:3]}"
    )
