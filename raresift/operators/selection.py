"""Exact order statistics of many columns at once, by counting digits of the ordered bits of their values.

A double's bits, with those of negative numbers turned over, sort like the number itself. One pass counts the leading 16
bits of all values; the digit in which each wanted rank falls is found by running sums, and the next pass counts the
next 16 bits of the values that share it. After four passes at most every rank has all its 64 bits: no sketch, no
sort, no bracket that can miss. Once few values share the digits found so far, these values themselves are fetched. Counts are combined per task before they are shuffled, and all of it
runs inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from raresift.operators.sizing import small_table

DIGIT_BITS = 16
PASSES = 64 // DIGIT_BITS
_SIGN = np.uint64(1 << 63)
#: Values that the driver may fetch in place of further passes.
FETCHED = 200_000


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers that sort like the values. Zero has one form."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_ordered_bits(bits: int) -> float:
    plain = bits & ~(1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([plain], np.uint64).view(np.float64)[0])


def _keyed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``place, key`` of every value: the column's number and the ordered bits, as a 64-bit number read without sign."""
    value = F.col("value")
    plain = F.when(value == 0, F.lit(0.0)).otherwise(value)  # one zero
    # Spark has no function for the bits of a double; the Java method runs inside the JVM.
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), plain).cast("bigint")
    turned = F.when(F.col("bits") < 0, F.bitwise_not("bits")).otherwise(F.col("bits").bitwiseXOR(F.lit(-(1 << 63))))
    listed = df.select(F.posexplode(F.array(*columns)).alias("place", "value")).filter(value.isNotNull() & ~F.isnan(value))
    return listed.select("place", bits.alias("bits")).select("place", turned.alias("key"))


def _sharing(keyed: DataFrame, known: list[np.ndarray], shift: int) -> DataFrame:
    """Values whose bits above ``shift`` are among the ``known`` ones of their column."""
    entries = [(place, _signed(int(bits))) for place, own in enumerate(known) for bits in own]
    kinds = {"place": pa.int32(), "prefix": pa.int64()}
    # One row per wanted rank at most.
    wanted = small_table(keyed.sparkSession, {name: [entry[i] for entry in entries] for i, name in enumerate(kinds)}, kinds)
    return keyed.withColumn("prefix", F.shiftrightunsigned("key", shift)).join(F.broadcast(wanted), ["place", "prefix"], "left_semi")


def _count_digits(df: DataFrame, columns: Sequence[str], known: list[np.ndarray] | None, turn: int) -> DataFrame:
    """``place, prefix, digit, n`` of the values whose leading bits are among the ``known`` ones of their column."""
    shift = 64 - DIGIT_BITS * (turn + 1)
    keyed = _keyed(df, columns)
    if known is None:
        rows = keyed.withColumn("prefix", F.lit(0).cast("bigint"))
    else:
        rows = _sharing(keyed, known, shift + DIGIT_BITS)
    leading = F.shiftrightunsigned("key", shift) if shift else F.col("key")
    digit = leading.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")
    return rows.groupBy("place", "prefix", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))


def _fetch(df: DataFrame, columns: Sequence[str], known: list[np.ndarray], turn: int) -> list[np.ndarray]:
    """Ordered bits of all values of each column that share the bits found up to ``turn``, in order."""
    rows = _sharing(_keyed(df, columns), known, 64 - DIGIT_BITS * (turn + 1)).select("place", "key").toArrow()  # FETCHED at most
    place, bits = rows.column("place").to_numpy(), rows.column("key").to_numpy().view(np.uint64)
    return [np.sort(bits[place == own]) for own in range(len(columns))]


def _advance(counted: DataFrame, wanted: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], tuple[int, int, int]]:
    """Digit, rank within it and its count, of each wanted (place, prefix, rank); one row per wanted rank comes back."""
    spark = counted.sparkSession
    kinds = {"place": pa.int32(), "prefix": pa.int64(), "rank": pa.int64()}
    asked = small_table(spark, {name: [entry[i] for entry in wanted] for i, name in enumerate(kinds)}, kinds)
    order = Window.partitionBy("place", "prefix").orderBy("digit")
    # At most 65,536 digits per prefix.
    upto = counted.withColumn("upto", F.sum("n").over(order)).withColumn("before", F.col("upto") - F.col("n"))
    hit = upto.join(F.broadcast(asked), ["place", "prefix"]).filter("rank >= before AND rank < upto")
    return {(row.place, row.prefix, row.rank): (row.digit, row.rank - row.before, row.n) for row in hit.collect()}


def _signed(prefix: int) -> int:
    return prefix - (1 << 64) if prefix >> 63 else prefix


def counts_of(df: DataFrame, columns: Sequence[str]) -> list[int]:
    """How many values each column has, missing ones and NaN left out."""
    row = df.agg(*[F.count_if(F.col(name).isNotNull() & ~F.isnan(name)).alias(f"n{i}") for i, name in enumerate(columns)]).first()
    return list(row)


def values_at_ranks(df: DataFrame, columns: Sequence[str], ranks: Sequence[Sequence[int]]) -> list[list[float]]:
    """Values at zero-based ranks of each column; ranks must lie below the number of its values."""
    doubles = df.select(*[F.col(name).cast("double").alias(f"c{place}") for place, name in enumerate(columns)])
    names = doubles.columns
    # Every wanted rank as (place, bits so far, rank among the values with these bits).
    state = {(place, rank): (0, rank) for place, own in enumerate(ranks) for rank in own}
    known: list[np.ndarray] | None = None
    for turn in range(PASSES):
        if not state:
            break
        counted = _count_digits(doubles, names, known, turn)
        wanted = sorted({(place, _signed(bits), within) for (place, _), (bits, within) in state.items()})
        found = _advance(counted, wanted)
        sizes: dict[tuple[int, int], int] = {}
        for (place, rank), (bits, within) in state.items():
            digit, left, size = found[place, _signed(bits), within]
            state[place, rank] = (bits << DIGIT_BITS | digit, left)
            sizes[place, bits << DIGIT_BITS | digit] = size
        known = [
            np.array(sorted({bits for (own, _), (bits, _) in state.items() if own == place}), np.uint64) for place in range(len(names))
        ]
        if turn + 1 < PASSES and sum(sizes.values()) <= FETCHED:
            fetched = _fetch(doubles, names, known, turn)
            shift = 64 - DIGIT_BITS * (turn + 1)
            for (place, rank), (bits, within) in state.items():
                first = int(np.searchsorted(fetched[place], np.uint64(bits << shift)))
                state[place, rank] = (int(fetched[place][first + within]), 0)
            break
    return [[from_ordered_bits(state[place, rank][0]) for rank in own] for place, own in enumerate(ranks)]


def exact_percentiles(df: DataFrame, columns: Sequence[str], percentiles: Sequence[float]) -> list[list[float | None]]:
    """Percentiles of every column, with linear interpolation between the two nearest values as NumPy has it.

    Missing values and NaN are ignored; None for a column without values.
    """
    sizes = counts_of(df, columns)
    places = [[(size - 1) * percentile / 100.0 for percentile in percentiles] if size else [] for size in sizes]
    ranks = [
        sorted({rank for place in own for rank in (math.floor(place), min(math.floor(place) + 1, size - 1))})
        for own, size in zip(places, sizes, strict=True)
    ]
    values = [dict(zip(own, found, strict=True)) for own, found in zip(ranks, values_at_ranks(df, columns, ranks), strict=True)]
    made: list[list[float | None]] = []
    for own, size, known in zip(places, sizes, values, strict=True):
        if not size:
            made.append([None] * len(percentiles))
            continue
        pairs = [(known[math.floor(place)], known[min(math.floor(place) + 1, size - 1)], place - math.floor(place)) for place in own]
        made.append([low + (high - low) * part if high > low else low for low, high, part in pairs])
    return made


def exact_percentile(df: DataFrame, column: str, percentile: float) -> float | None:
    return exact_percentiles(df, [column], [percentile])[0][0]
