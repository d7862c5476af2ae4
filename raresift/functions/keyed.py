"""Reproducible random draws.

``rand(seed)`` depends on how rows are partitioned. Draws here depend on a seed and on the row's own id
only, so a sample stays the same after a repartition, a retry or a change of cluster size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_POW_32 = 4294967296.0


def _as_column(part: Column | str | int) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def draw_key(seed: int | str, *parts: Column | str | int) -> Column:
    """Hex digest of ``seed|part|part...``; uniform over rows with distinct parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_as_column(part) for part in parts]).cast("binary"))


def key_number(key: Column, word: int = 0) -> Column:
    """32-bit number from the ``word``-th group of eight hex digits of a key."""
    return F.conv(F.substring(key, 1 + 8 * word, 8), 16, 10).cast("bigint")


def wide_number(key: Column) -> Column:
    """60-bit number from the first fifteen hex digits of a key, for draws among very many rows."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def uniform(seed: int | str, *parts: Column | str | int) -> Column:
    """Uniform number in [0, 1)."""
    return key_number(draw_key(seed, *parts)) / F.lit(TWO_POW_32)


def standard_normal(seed: int | str, *parts: Column | str | int) -> Column:
    """Normal draw (Box-Muller) from two words of one key."""
    key = draw_key(seed, *parts)
    first = (key_number(key, 0) + F.lit(0.5)) / F.lit(TWO_POW_32)
    second = key_number(key, 1) / F.lit(TWO_POW_32)
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(2.0 * math.pi) * second)
