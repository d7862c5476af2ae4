"""Column expressions for numbers that may be missing, infinite or written as text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from raresift.constants import MISSING_LABEL_TOKENS, NUMERIC_TEXT

INFINITY = float("inf")


def text_to_number(value: Column) -> Column:
    """Double from text; anything that is not plainly a number becomes null."""
    text = F.trim(value)
    return F.when(F.lower(text).rlike(NUMERIC_TEXT), text.try_cast("double"))


def is_missing(value: Column) -> Column:
    """Null or NaN of a numeric column."""
    return value.isNull() | F.isnan(value)


def is_infinite(value: Column) -> Column:
    return F.coalesce(F.abs(value) == F.lit(INFINITY), F.lit(False))


def finite_or_null(value: Column) -> Column:
    """Null for NaN and infinities, so that one notion of missing is left.

    NaN orders above every number, so one comparison catches both.
    """
    return F.when(F.abs(value) < F.lit(INFINITY), value)


def is_finite(value: Column) -> Column:
    return F.coalesce(F.abs(value) < F.lit(INFINITY), F.lit(False))


def label_or_null(value: Column) -> Column:
    """Null for the texts a CSV file uses for a missing label."""
    return F.when(~value.isin(*MISSING_LABEL_TOKENS), value)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions, F.lit(True))


def total(terms: Iterable[Column]) -> Column:
    """Left-to-right sum."""
    return reduce(lambda left, right: left + right, terms)


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(1.0), whole), F.lit(0.0))


def mean_squared_error(left: list[Column], right: list[Column]) -> Column:
    """Mean of squared differences over the columns of one row."""
    return total((a - b) * (a - b) for a, b in zip(left, right, strict=True)) / F.lit(float(len(left)))


def position_of_max(values: Column) -> Column:
    """Zero-based position of the largest entry of an array; the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
