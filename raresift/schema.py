"""Schemas and column checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, types as T

from raresift.constants import FEATURE_PRESETS, ID_COLUMN

VERDICT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("pred_label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("stage", T.StringType()),
        T.StructField("filter_score", T.DoubleType()),
    ]
)


class MissingColumns(ValueError):
    """Raised when a table lacks columns an operator needs."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    present = set(df.columns)
    absent = sorted(name for name in columns if name not in present)
    if absent:
        raise MissingColumns(f"missing columns: {', '.join(absent)}")
    return df


def preset(name: str = "default") -> list[str]:
    if name not in FEATURE_PRESETS:
        raise KeyError(f"unknown preset {name!r}; known: {', '.join(sorted(FEATURE_PRESETS))}")
    return list(FEATURE_PRESETS[name])


def project_features(
    df: DataFrame, features: Sequence[str] | str = "default", id_col: str = ID_COLUMN, extra: Sequence[str] = ()
) -> DataFrame:
    """Id, extra columns, then the features in preset order; the scan reads nothing else."""
    names = preset(features) if isinstance(features, str) else list(features)
    wanted = [id_col, *extra, *names]
    return require_columns(df, wanted).select(*wanted)


def split_by_type(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """(text columns, numeric columns) in table order."""
    names = set(columns if columns is not None else df.columns)
    text, numeric = [], []
    for field in df.schema.fields:
        if field.name not in names:
            continue
        if isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType)):
            text.append(field.name)
        elif isinstance(field.dataType, T.NumericType):
            numeric.append(field.name)
    return text, numeric
