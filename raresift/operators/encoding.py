"""Labels to integer codes and back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from raresift.constants import MERGED_RARE_CODE, RARE_CODES
from raresift.operators.ordering import numbered
from raresift.operators.sizing import CLASS_ROWS, LOOKUP_ROWS, bounded_rows, small_table
from raresift.schema import require_columns
from raresift.session import materialise


def _distinct_labels(df: DataFrame, label: str) -> DataFrame:
    require_columns(df, [label])
    return df.select(F.col(label).cast("string").alias("label")).filter("label IS NOT NULL").distinct()


def label_table(df: DataFrame, label: str) -> DataFrame:
    """``label, code``: sorted distinct labels numbered from zero, however many there are."""
    numbers = numbered(materialise(_distinct_labels(df, label)), "label", "code")
    return numbers.withColumn("code", F.col("code").cast("int"))


@dataclass(frozen=True)
class LabelCodes:
    """Fitted labels; the position of a label is its code."""

    labels: tuple[str, ...]

    def table(self, spark) -> DataFrame:
        return small_table(
            spark,
            {"label": self.labels, "code": range(len(self.labels))},
            {"label": pa.string(), "code": pa.int32()},
        )

    def encode(self, df: DataFrame, label: str, code: str = "label_code") -> DataFrame:
        """Add the code of a label; null when the label was not fitted."""
        table = self.table(df.sparkSession).select(F.col("label").alias("_label"), F.col("code").alias(code))
        # The table was size-checked when it was fitted.
        return df.join(F.broadcast(table), F.col(label).cast("string") == F.col("_label"), "left").drop("_label")

    def decoded(self, code: Column) -> Column:
        """Label of a code; an unknown code is shown as its own text."""
        known = F.get(F.array(*[F.lit(label) for label in self.labels]), code)
        return F.coalesce(known, code.cast("string"))


def fit_labels(df: DataFrame, label: str) -> LabelCodes:
    """Labels of a class column. A column with more values than a lookup holds is not a class column."""
    rows = bounded_rows(_distinct_labels(df, label), CLASS_ROWS)
    if rows is None:
        raise ValueError(f"{label!r} has more than {CLASS_ROWS} values; use factorize for such columns")
    return LabelCodes(tuple(sorted(row.label for row in rows)))


def factorize(df: DataFrame, column: str, position: str, code: str = "code") -> DataFrame:
    """Add codes numbered by first appearance along ``position``; missing values get -1."""
    require_columns(df, [column, position])
    # Copies of a value meet as one row per task before they are shuffled; the table is read again below.
    first = materialise(
        df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.min(position).alias("_first"))
    )
    codes = numbered(first, "_first", code).select("_value", F.col(code).cast("bigint").alias(code))
    if first.count() <= LOOKUP_ROWS:
        codes = F.broadcast(codes)
    joined = df.join(codes, F.col(column) == F.col("_value"), "left").drop("_value")
    return joined.withColumn(code, F.coalesce(F.col(code), F.lit(-1).cast("bigint")))


def is_rare(code: Column, rare: Sequence[int] = RARE_CODES) -> Column:
    return code.isin(*rare)


def merged_code(code: Column, rare: Sequence[int] = RARE_CODES, merged: int = MERGED_RARE_CODE) -> Column:
    """All rare codes as one."""
    return F.when(code.isin(*rare), F.lit(merged)).otherwise(code)
