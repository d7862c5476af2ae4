"""Exact order statistics without sorting a table or gathering a group in one task.

Each function narrows the range that can hold the answer by counting, with map-side combining, and only
looks at single values once that range is small. Groups of any size and any skew take the same path.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from raresift.operators.sizing import LOOKUP_ROWS, column_type, small_table
from raresift.session import materialise

# Rows that may be ranked by one task.
TASK_ROWS = 200_000
# Hex digits refined per pass over the data: 16 ** 4 counters per group.
DIGITS_PER_PASS = 4
KEY_DIGITS = 32
# A bucket of keys is hot when it holds this many times the rows it should.
HOT_FACTOR = 8


def digits_for(rows: int, rows_per_bucket: int = TASK_ROWS) -> int:
    """Leading hex digits that cut ``rows`` uniform keys into buckets of about the given size."""
    if rows <= rows_per_bucket:
        return 0
    return min(KEY_DIGITS, math.ceil(math.log(rows / rows_per_bucket, 16)))


@dataclass(frozen=True)
class Cutoff:
    """Where a sample ends: ``key <= cutoff.key`` keeps it, but for the surplus copies of that very key."""

    key: str
    wanted: int = 0  # rows to take among those that have exactly this key
    copies: int = 0  # rows that have exactly this key

    @property
    def divided(self) -> bool:
        return self.wanted < self.copies


NOTHING, EVERYTHING = Cutoff(""), Cutoff("~")


def smallest_key_cutoffs(
    df: DataFrame, group: str, key: str, quotas: Mapping[object, int], counts: Mapping[object, int]
) -> dict[object, Cutoff]:
    """Per group the largest key among its ``quota`` smallest ones.

    ``key`` holds hex digests. Keys are counted by their leading digits; the bucket in which the quota ends is
    looked at again with more digits, until it is small or holds copies of a single key.
    """
    cutoffs: dict[object, Cutoff] = {}
    state: dict[object, tuple[str, int, int]] = {}
    for name, quota in quotas.items():
        if quota <= 0:
            cutoffs[name] = NOTHING
        elif quota >= counts[name]:
            cutoffs[name] = EVERYTHING
        else:
            state[name] = ("", quota, counts[name])

    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"))
    depth = 0
    while state:
        largest = max(left for _, _, left in state.values())
        step = min(digits_for(largest), DIGITS_PER_PASS, KEY_DIGITS - depth)
        span = depth + step if step else KEY_DIGITS
        within = _inside(rows, state, depth)
        # Digests of equal keys are equal, so one least and largest digest means one key.
        counted = within.groupBy("g", F.substring("k", 1, span).alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("k")).alias("least"), F.max(F.xxhash64("k")).alias("most")
        )
        running = F.sum("n").over(Window.partitionBy("g").orderBy("p"))
        wanted = small_table(
            df.sparkSession,
            {"g": list(state), "need": [need for _, need, _ in state.values()]},
            {"g": column_type(list(state)), "need": pa.int64()},
        )
        edge = (
            counted.withColumn("upto", running)
            .join(F.broadcast(wanted), "g")
            .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
            .select("g", "p", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "n", (F.col("least") == F.col("most")).alias("single"))
            .collect()
        )
        following: dict[object, tuple[str, int, int]] = {}
        for row in edge:
            if span == KEY_DIGITS:
                cutoffs[row.g] = Cutoff(row.p, row.need, row.n)
            elif row.need == row.n:
                # The quota ends with this bucket: every key that starts like it belongs to the sample.
                cutoffs[row.g] = Cutoff(row.p + "~")
            elif row.single:
                key_found = _inside(rows, {row.g: (row.p, row.need, row.n)}, span).select("k").first().k
                cutoffs[row.g] = Cutoff(key_found, row.need, row.n)
            else:
                following[row.g] = (row.p, row.need, row.n)
        state = following
        depth = span
    return cutoffs


def mark_smallest(
    df: DataFrame, group: str, key: str, quotas: Mapping[object, int], counts: Mapping[object, int], flag: str
) -> DataFrame:
    """Add a flag that is true for exactly ``quota`` rows of each group, those of the smallest keys.

    Rows only compare their key with the cutoff of their group. When a quota ends inside the copies of one
    key, those copies are told apart by their content, and rows that are equal throughout are counted out.
    """
    columns = df.columns
    cutoffs = smallest_key_cutoffs(df, group, key, quotas, counts)
    marked = _against(df, group, key, cutoffs, flag)
    divided = {name: cutoff for name, cutoff in cutoffs.items() if cutoff.divided}
    if not divided:
        return marked.select(*columns, flag)

    tied = marked.filter(F.col("_tied")).select(*columns).withColumn("_content", F.md5(F.to_json(F.struct(*columns)).cast("binary")))
    inner = smallest_key_cutoffs(
        tied,
        group,
        "_content",
        {name: cutoff.wanted for name, cutoff in divided.items()},
        {name: cutoff.copies for name, cutoff in divided.items()},
    )
    settled = _against(tied, group, "_content", inner, flag)
    result = marked.filter(~F.col("_tied")).select(*columns, flag)
    result = result.unionByName(settled.filter(~F.col("_tied")).select(*columns, flag))
    for name, cutoff in inner.items():
        if cutoff.divided:
            # Equal rows: one of them, repeated by a distributed range, of which the first ones are marked.
            one = settled.filter(F.col("_tied") & (F.col(group) == F.lit(name))).select(*columns).limit(1).withColumn("_same", F.lit(1))
            copies = df.sparkSession.range(cutoff.copies).select(F.lit(1).alias("_same"), (F.col("id") < cutoff.wanted).alias(flag))
            result = result.unionByName(copies.join(F.broadcast(one), "_same").select(*columns, flag))
    return result


def _against(df: DataFrame, group: str, key: str, cutoffs: Mapping[object, Cutoff], flag: str) -> DataFrame:
    """Compare keys with the cutoffs; ``_tied`` marks the rows a divided cutoff leaves open."""
    if len(cutoffs) == 1:
        ((name, cutoff),) = cutoffs.items()
        mine = F.col(group) == F.lit(name)
        tied = F.coalesce(mine & F.lit(cutoff.divided) & (F.col(key) == F.lit(cutoff.key)), F.lit(False))
        return df.withColumns({flag: F.coalesce(mine & (F.col(key) <= F.lit(cutoff.key)), F.lit(False)), "_tied": tied})
    table = small_table(
        df.sparkSession,
        {
            "_group": list(cutoffs),
            "_cutoff": [cutoff.key for cutoff in cutoffs.values()],
            "_divided": [cutoff.divided for cutoff in cutoffs.values()],
        },
        {"_group": column_type(list(cutoffs)), "_cutoff": pa.string(), "_divided": pa.bool_()},
    )
    # One row per class; the callers have checked their number.
    joined = df.join(F.broadcast(table), F.col(group) == F.col("_group"), "left")
    tied = F.coalesce(F.col("_divided") & (F.col(key) == F.col("_cutoff")), F.lit(False))
    below = F.coalesce(F.col(key) <= F.col("_cutoff"), F.lit(False))
    return joined.withColumns({flag: below, "_tied": tied}).drop("_group", "_cutoff", "_divided")


def _inside(rows: DataFrame, state: Mapping[object, tuple[str, int, int]], depth: int) -> DataFrame:
    """Rows of the groups still open whose key starts like the group's edge bucket."""
    prefix = F.substring("k", 1, depth) if depth else F.lit("")
    if len(state) == 1:  # a join on a constant group would become a nested loop
        ((name, (edge, _, _)),) = state.items()
        return rows.filter((F.col("g") == F.lit(name)) & (prefix == F.lit(edge))).select("g", "k")
    table = small_table(
        rows.sparkSession,
        {"g": list(state), "edge": [edge for edge, _, _ in state.values()]},
        {"g": column_type(list(state)), "edge": pa.string()},
    )
    return rows.withColumn("edge", prefix).join(F.broadcast(table), ["g", "edge"], "left_semi").select("g", "k")


def ranked_by_key(df: DataFrame, group: str, key: str, rank: str, largest_group: int) -> DataFrame:
    """Zero-based rank by key within each group.

    A group is cut by leading key digits into even buckets; the ranks of a bucket start where the counts of
    the earlier buckets end. Only buckets, never groups, meet in one task.
    """
    digits = digits_for(largest_group)
    if digits == 0:
        order = Window.partitionBy(group).orderBy(key)
        return df.withColumn(rank, (F.row_number().over(order) - 1).cast("bigint"))
    keyed = df.withColumn("_bucket", F.substring(key, 1, digits))
    counted = _bucket_sizes(keyed, group)
    hot = counted.filter(F.col("_n") > HOT_FACTOR * TASK_ROWS).agg(F.collect_set("_bucket").alias("b"), F.max("_n").alias("n")).first()
    if hot.b:
        # Many rows under one key: such a bucket is cut further by the content of its rows.
        content = F.md5(F.to_json(F.struct(*df.columns)).cast("binary"))
        finer = F.concat("_bucket", F.substring(content, 1, max(1, digits_for(hot.n))))
        keyed = keyed.withColumn("_bucket", F.when(F.col("_bucket").isin(hot.b), finer).otherwise(F.col("_bucket")))
        counted = _bucket_sizes(keyed, group)
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_n")
    offsets = counted.select(group, "_bucket", before.alias("_before"))
    if counted.count() <= LOOKUP_ROWS:
        offsets = F.broadcast(offsets)
    order = Window.partitionBy(group, "_bucket").orderBy(key)
    return (
        keyed.join(offsets, [group, "_bucket"])
        .withColumn(rank, F.row_number().over(order) - 1 + F.col("_before"))
        .drop("_bucket", "_before")
    )


def _bucket_sizes(keyed: DataFrame, group: str) -> DataFrame:
    """Rows per bucket, frozen: they are looked at for hot buckets and then used for the offsets."""
    return materialise(keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n")))


def numbered(df: DataFrame, order: str, number: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Zero-based position of every row of a table of distinct ``order`` values.

    A small table is numbered in one task. A larger one is range partitioned, frozen, and numbered per
    partition on top of the counts of the partitions before.
    """
    if df.agg(F.count(F.lit(1)).alias("n")).first().n <= task_rows:
        return df.withColumn(number, F.row_number().over(Window.partitionBy().orderBy(order)) - 1)
    ranged = materialise(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy().orderBy("_part")) - F.col("_n")
    offsets = counts.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return (
        ranged.withColumn(number, within)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(number, F.col(number) + F.col("_before"))
        .drop("_part", "_before")
    )


def sums_before(df: DataFrame, order: str, sums: Mapping[str, str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Add, per entry of ``sums`` (new column: summed column), the sum over all rows of smaller ``order``.

    ``order`` tells rows apart. As in ``numbered``, a larger table is range partitioned and frozen; the sums of a
    partition go on from those of the partitions before.
    """

    def before(window, column: str) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if df.agg(F.count(F.lit(1)).alias("n")).first().n <= task_rows:
        return df.withColumns({name: before(Window.partitionBy().orderBy(order), column) for name, column in sums.items()})
    ranged = materialise(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(column).alias(f"_of_{name}") for name, column in sums.items()])
    offsets = totals.select("_part", *[before(Window.partitionBy().orderBy("_part"), f"_of_{name}").alias(f"_to_{name}") for name in sums])
    within = ranged.withColumns({name: before(Window.partitionBy("_part").orderBy(order), column) for name, column in sums.items()})
    return (
        within.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumns({name: F.col(name) + F.col(f"_to_{name}") for name in sums})
        .drop("_part", *[f"_to_{name}" for name in sums])
    )
