"""Min-max scaling. A constant feature is divided by one; results are not clipped."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from raresift.schema import require_columns


@dataclass(frozen=True)
class MinMax:
    """Fitted ranges, in feature order."""

    features: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]

    def span(self, position: int) -> float:
        width = self.high[position] - self.low[position]
        return width if width != 0.0 else 1.0

    def scaled(self, name: str) -> Column:
        place = self.features.index(name)
        return (F.col(name) - F.lit(self.low[place])) / F.lit(self.span(place))

    def restored(self, name: str) -> Column:
        place = self.features.index(name)
        return F.col(name) * F.lit(self.span(place)) + F.lit(self.low[place])

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.features)
        return df.withColumns({name: self.scaled(name) for name in self.features})

    def inverse(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.features)
        return df.withColumns({name: self.restored(name) for name in self.features})


def _extremes(df: DataFrame, features: Sequence[str]) -> DataFrame:
    require_columns(df, features)
    return df.agg(
        *[F.min(F.col(name).cast("double")).alias(f"_low{i}") for i, name in enumerate(features)],
        *[F.max(F.col(name).cast("double")).alias(f"_high{i}") for i, name in enumerate(features)],
    )


def fit_minmax(df: DataFrame, features: Sequence[str]) -> MinMax:
    """Fit on a clean table with at least one row."""
    found = _extremes(df, features).first()
    if found["_low0"] is None:
        raise ValueError("cannot fit a scale on an empty table")
    places = range(len(features))
    return MinMax(tuple(features), tuple(found[f"_low{i}"] for i in places), tuple(found[f"_high{i}"] for i in places))


def minmax_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The fitted ranges as rows ``feature, low, high``."""
    entries = [
        F.struct(F.lit(name).alias("feature"), F.col(f"_low{i}").alias("low"), F.col(f"_high{i}").alias("high"))
        for i, name in enumerate(features)
    ]
    return _extremes(df, features).select(F.inline(F.array(*entries)))
