"""Coercion to numbers, missing values, row and column dropping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from raresift.constants import ID_LIKE_SHARE, IMPUTE_VALUE
from raresift.functions.values import all_of, finite_or_null, is_finite, text_to_number
from raresift.schema import require_columns, split_by_type

# Relative error of the distinct-count sketch and the distance from the limit at which it is believed.
SKETCH_ERROR = 0.01
SKETCH_TRUST = 10 * SKETCH_ERROR


def coerce_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every feature as double; text that is not a number becomes null."""
    require_columns(df, features)
    text, _ = split_by_type(df, features)
    textual = set(text)
    return df.withColumns(
        {
            name: text_to_number(F.col(name)) if name in textual else F.col(name).cast("double")
            for name in features
        }
    )


def normalise_missing(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NaN and infinities to null."""
    return df.withColumns({name: finite_or_null(F.col(name)) for name in features})


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with every listed column present (null and NaN count as missing)."""
    require_columns(df, columns)
    return df.na.drop("any", subset=list(columns))


def clean_features(df: DataFrame, features: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Coerce and keep the rows whose features are all finite; ``also`` lists further columns that must be present.

    The test is one comparison per feature, because the planner repeats it next to the scan.
    """
    require_columns(df, also)
    coerced = coerce_features(df, features)
    kept = coerced.filter(all_of(is_finite(F.col(name)) for name in features))
    return kept.na.drop("any", subset=list(also)) if also else kept


def with_valid_flag(df: DataFrame, features: Sequence[str], flag: str = "is_valid") -> DataFrame:
    """True where every feature is a finite number."""
    require_columns(df, features)
    return df.withColumn(flag, all_of(is_finite(F.col(name).cast("double")) for name in features))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the listed columns; names that are absent are ignored."""
    return df.drop(*columns)


def impute_constant(df: DataFrame, columns: Sequence[str], value: float = IMPUTE_VALUE) -> DataFrame:
    """A constant for every missing value, infinite ones included."""
    return df.withColumns({name: F.coalesce(finite_or_null(F.col(name).cast("double")), F.lit(value)) for name in columns})


def require_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is present."""
    require_columns(df, [target])
    present = F.col(target).isNotNull()
    if isinstance(df.schema[target].dataType, (T.DoubleType, T.FloatType)):
        present = present & ~F.isnan(target)
    return df.filter(present)


def id_like_columns(df: DataFrame, columns: Sequence[str] | None = None, limit: float = ID_LIKE_SHARE) -> list[str]:
    """Text columns with more distinct values than ``limit`` times the row count.

    One pass with distinct-count sketches settles the clear cases. Only columns near the limit or above it
    are counted exactly, with copies combined before the shuffle.
    """
    text, _ = split_by_type(df, columns)
    if not text:
        return []
    sketch = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.approx_count_distinct(name, SKETCH_ERROR).alias(name) for name in text],
    ).first()
    rows = sketch["_rows"]
    candidates = [name for name in text if sketch[name] > (limit - SKETCH_TRUST) * rows]
    if not candidates:
        return []
    pairs = df.select(F.inline(F.array(*[_named_value(name) for name in candidates]))).filter("value IS NOT NULL")
    distinct = pairs.groupBy("column", "value").count().groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    found = {row.column for row in distinct.collect() if row.n > limit * rows}
    return [name for name in text if name in found]


def _named_value(name: str):
    return F.struct(F.lit(name).alias("column"), F.col(name).cast("string").alias("value"))
