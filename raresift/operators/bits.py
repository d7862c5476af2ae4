"""A bit table of a long id list, and the test against it inside the JVM.

An id sets a few bits; a row all of whose bits are set *may* be on the list, any other row is certainly not. The table
is sized from the counted list up to a fixed most; beyond that it says "may be" more often, never less. It is built
by one aggregation, and reaches the tasks as the value of a scalar subquery: the test is a column expression. The driver sends
the table's value with every task set, once for each bit that is looked up, so the most is small, and a table that is
short for its list sets fewer bits for an id.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS_PER_ID = 12
HASHES = 4
WORD = 64
#: 2 MiB of bits: 1.4 million ids at twelve bits each.
MOST_BITS = 1 << 24
#: With fewer bits an id, a fourth of the other rows and more would be let through, after a second scan for them.
LEAST_BITS_PER_ID = 3


def table_bits(ids: int, most: int = MOST_BITS) -> int:
    """Power of two that gives each id ``BITS_PER_ID`` bits, within bounds."""
    return max(WORD, min(most, 1 << (max(1, ids * BITS_PER_ID) - 1).bit_length()))


def worth_it(ids: int, most: int = MOST_BITS) -> bool:
    """Whether the largest table would keep most rows that are not listed from the join."""
    return ids * LEAST_BITS_PER_ID <= most


def hashes_for(ids: int, bits: int) -> int:
    """Bits that an id sets: as many as let the fewest other ids through, within bounds."""
    return max(1, min(HASHES, round(math.log(2.0) * bits / max(1, ids))))


def _positions(value: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(turn), value), F.lit(bits)) for turn in range(hashes)]


def may_be_listed(ids: DataFrame, column: str, count: int, most: int = MOST_BITS) -> Callable[[Column], Column]:
    """Test for values (as text): false for one that is certainly not among the ``count`` ids, or is missing."""
    bits = table_bits(count, most)
    hashes = hashes_for(count, bits)
    place = F.explode(F.array(*_positions(F.col(column), bits, hashes))).alias("place")
    words = (
        ids.select(place)
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(WORD)).cast("int"))).alias("held"))
        .toArrow()  # at most MOST_BITS / 64 rows
    )
    table = np.zeros(bits // WORD, np.int64)
    table[words.column("word").to_numpy()] = words.column("held").to_numpy()
    whole = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table))
    held = ids.sparkSession.createDataFrame(pa.table({"held": whole})).scalar()

    def test(value: Column) -> Column:
        made = F.lit(True)
        for at in _positions(value.cast("string"), bits, hashes):
            word = F.get(held, F.shiftright(at, 6).cast("int"))
            made = made & (F.call_function("shiftright", word, F.pmod(at, F.lit(WORD)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return F.coalesce(value.isNotNull() & made, F.lit(False))

    return test
