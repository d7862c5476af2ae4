"""Size checks that decide between a broadcast lookup and a shuffled one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

# Lookup tables up to this many rows are held by the driver and broadcast.
LOOKUP_ROWS = 10_000
# Values that a class column may have: its counts and cutoffs are held by the driver and broadcast.
CLASS_ROWS = 1_000_000
# Id lists up to this many rows and bytes are broadcast. The driver holds such a list several times while it is hashed and sent.
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 8 * 1024 * 1024


def bounded_rows(df: DataFrame, limit: int = LOOKUP_ROWS) -> list[Row] | None:
    """All rows of a small table, or None when it has more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small_table(spark: SparkSession, columns: dict[str, Sequence], types: dict[str, pa.DataType]) -> DataFrame:
    """A local table from driver-held columns whose size was checked by the caller."""
    arrays = {name: pa.array(list(values), types[name]) for name, values in columns.items()}
    return spark.createDataFrame(pa.table(arrays))


@dataclass(frozen=True)
class Size:
    rows: int
    text_bytes: int

    def small(self, rows: int | None = None, size: int | None = None) -> bool:
        """Within the bounds of a broadcast."""
        return self.rows <= (BROADCAST_ROWS if rows is None else rows) and self.text_bytes <= (BROADCAST_BYTES if size is None else size)


def measure(ids: DataFrame, column: str) -> Size:
    """Rows of a list, and bytes of its ids as text."""
    length = F.octet_length(F.col(column).cast("string"))
    return Size(*ids.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first())


def column_type(values: Sequence) -> pa.DataType:
    """Arrow type of the values of one column."""
    return pa.array(list(values)).type if len(values) else pa.int64()


def broadcast_if_small(ids: DataFrame, column: str) -> DataFrame:
    """Hint a broadcast only when the list was counted and measured to be small.

    A longer list is left to the planner, which shuffles both sides on the id and splits skewed
    partitions at run time.
    """
    return F.broadcast(ids) if measure(ids, column).small() else ids
