"""Running sums over a table in a given order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from raresift.session import materialise

PART = "_part"


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str], group: Sequence[str] = ()) -> DataFrame:
    """Add, per entry of ``sums`` (new column: summed column), the sum over all earlier rows of the group.

    Rows are range-sorted by group and order, so a group of any size spreads over many partitions. Sums within
    a partition are added to the totals of the partitions before it; only one row per partition and group takes
    part in that second step. ``order`` should tell rows apart; rows that are equal in it are ordered arbitrarily.
    """
    spark = df.sparkSession
    group = list(group)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(
        df.repartitionByRange(partitions, *group, *order).withColumn(PART, F.spark_partition_id())
    )
    inside = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    names = list(sums)
    totals = ranged.groupBy(PART, *group).agg(*[F.sum(sums[name]).alias(f"_{name}") for name in names])
    over = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(
        F.col(PART).alias("_at"),
        *[F.col(name).alias(f"_g{place}") for place, name in enumerate(group)],
        *[F.coalesce(F.sum(f"_{name}").over(over), F.lit(0)).alias(f"_{name}") for name in names],
    )
    same = F.col(PART) == F.col("_at")
    for place, name in enumerate(group):
        same = same & F.col(name).eqNullSafe(F.col(f"_g{place}"))
    local = ranged.select(
        *df.columns, PART, *[F.coalesce(F.sum(sums[name]).over(inside), F.lit(0)).alias(name) for name in names]
    )
    return local.join(earlier, same).select(
        *df.columns, *[(F.col(name) + F.col(f"_{name}")).cast("bigint").alias(name) for name in names]
    )
