"""Splits, samples and made rows. Every draw is keyed on the row id, so results survive a repartition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raresift.constants import (
    AUGMENT_COMMON_ROWS,
    AUGMENT_SCALE,
    AUGMENT_TARGET,
    CONTAMINANT_CAP,
    FALSE_ALARM_CODE,
    MERGED_RARE_CODE,
    NOISE_HIGH,
    NOISE_LOW,
    NOISE_ROWS,
    RARE_CODES,
    SEED,
    SPECIALIST_MIN_COMMON,
    SPECIALIST_ROWS,
    TEST_SHARE,
)
from raresift.functions.keyed import draw_key, key_number, standard_normal, uniform, wide_number
from raresift.operators.ordering import mark_smallest, ranked_by_key
from raresift.operators.sizing import CLASS_ROWS, bounded_rows, column_type, small_table
from raresift.schema import require_columns


def group_counts(df: DataFrame, group: str) -> dict:
    """Rows per value of a class column; refuses a column that is no class column."""
    rows = bounded_rows(df.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n")), CLASS_ROWS)
    if rows is None:
        raise ValueError(f"{group!r} has more than {CLASS_ROWS} values and is no class column")
    return {row.g: row.n for row in rows if row.g is not None}


def allocate(counts: Mapping, wanted: int) -> dict:
    """Share ``wanted`` rows out over classes in proportion, by largest remainder, ties by class order."""
    total = sum(counts.values())
    given = {name: rows * wanted // total for name, rows in counts.items()}
    by_remainder = sorted(counts, key=lambda name: (-(counts[name] * wanted % total), name))
    for name in by_remainder[: wanted - sum(given.values())]:
        given[name] += 1
    return given


def stratified_split(
    df: DataFrame, label: str, id_col: str, share: float = TEST_SHARE, seed: int = SEED, flag: str = "is_test"
) -> DataFrame:
    """Mark ``ceil(share * n)`` rows as test rows, in proportion to the classes.

    Only counters are shuffled; the rows stay where they are and compare their key with their class's cutoff.
    """
    require_columns(df, [label, id_col])
    keyed = df.withColumn("_key", draw_key(seed, F.col(id_col)))
    counts = group_counts(df, label)
    small = [str(name) for name, rows in counts.items() if rows < 2]
    if small:
        raise ValueError(f"classes with fewer than two rows cannot be split: {', '.join(sorted(small))}")
    quotas = allocate(counts, ceil(round(share * sum(counts.values()), 9)))
    return mark_smallest(keyed, label, "_key", quotas, counts, flag).drop("_key")


def split_rows(df: DataFrame, flag: str = "is_test") -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows) of a marked table."""
    return df.filter(~F.col(flag)).drop(flag), df.filter(F.col(flag)).drop(flag)


def holdout(df: DataFrame, id_col: str, share: float = 0.1, seed: int | str = "holdout", flag: str = "is_validation") -> DataFrame:
    """Mark about ``share`` of the rows; a per-row test that needs no pass over the table."""
    return df.withColumn(flag, uniform(seed, F.col(id_col)) < F.lit(share))


def cap_rows(df: DataFrame, id_col: str, rows: int = CONTAMINANT_CAP, seed: int = SEED) -> DataFrame:
    """A keyed sample of ``rows`` rows, or the table itself when it is not larger."""
    total = df.agg(F.count(F.lit(1)).alias("n")).first().n
    if total <= rows:
        return df
    keyed = df.withColumn("_all", F.lit(0).cast("bigint")).withColumn("_key", draw_key(seed, F.col(id_col)))
    marked = mark_smallest(keyed, "_all", "_key", {0: rows}, {0: total}, "_taken")
    return marked.filter("_taken").drop("_key", "_all", "_taken")


def specialist_quotas(
    rare: int, common: int, total: int = SPECIALIST_ROWS, min_common: int = SPECIALIST_MIN_COMMON
) -> tuple[int, int]:
    """(rare rows, common rows) of the specialist's training table."""
    most_rare = total - min_common
    taken = min(rare, most_rare)
    room = min_common if rare > most_rare else total - rare
    return taken, min(room, common)


def specialist_sample(
    df: DataFrame,
    code: str,
    id_col: str,
    rare: Sequence[int] = RARE_CODES,
    total: int = SPECIALIST_ROWS,
    min_common: int = SPECIALIST_MIN_COMMON,
    seed: int = SEED,
    target: str = "spec_code",
) -> DataFrame:
    """Bounded table for the specialist: rare rows as one code, common rows as false alarms."""
    sided = df.withColumn("_side", F.col(code).isin(*rare).cast("bigint")).withColumn("_key", draw_key(seed, F.col(id_col)))
    counts = {0: 0, 1: 0, **group_counts(sided, "_side")}
    rare_rows, common_rows = specialist_quotas(counts[1], counts[0], total, min_common)
    marked = mark_smallest(sided, "_side", "_key", {1: rare_rows, 0: common_rows}, counts, "_taken")
    relabelled = F.when(F.col("_side") == 1, F.lit(MERGED_RARE_CODE)).otherwise(F.lit(FALSE_ALARM_CODE))
    return marked.filter("_taken").withColumn(target, relabelled).drop("_side", "_key", "_taken")


def population_spread(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Population standard deviation per feature, one for a constant feature."""
    found = df.agg(*[F.stddev_pop(name).alias(name) for name in features]).first()
    return {name: found[name] or 1.0 for name in features}


def gaussian_augment(
    df: DataFrame,
    features: Sequence[str],
    id_col: str,
    target_rows: int = AUGMENT_TARGET,
    scale: float = 0.02,
    seed: int = SEED,
) -> DataFrame:
    """Add noisy copies until about ``target_rows`` rows; unchanged when there are enough already.

    ``int(target / n)`` copies are added per row, so the result may exceed the target. Column ``copy`` is 0
    for the original rows.
    """
    rows = df.agg(F.count(F.lit(1)).alias("n")).first().n
    if rows == 0 or rows >= target_rows:
        return df.withColumn("copy", F.lit(0))
    spread = population_spread(df, features)
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(target_rows // rows))))

    def noisy(place: int, name: str) -> Column:
        noise = standard_normal(seed, F.col(id_col), F.col("copy"), place) * F.lit(spread[name] * scale)
        return F.when(F.col("copy") == 0, F.col(name)).otherwise(F.col(name) + noise)

    return copies.withColumns({name: noisy(place, name) for place, name in enumerate(features)})


def augmented_specialist_sample(
    df: DataFrame,
    features: Sequence[str],
    code: str,
    id_col: str,
    rare: Sequence[int] = RARE_CODES,
    target_rows: int = AUGMENT_TARGET,
    scale: float = AUGMENT_SCALE,
    common_rows: int = AUGMENT_COMMON_ROWS,
    seed: int = SEED,
    target: str = "spec_code",
) -> DataFrame:
    """The other specialist table: rare rows with noisy copies, against a fixed number of common rows."""
    is_rare = F.col(code).isin(*rare)
    rare_side = gaussian_augment(df.filter(is_rare), features, id_col, target_rows, scale, seed)
    common_side = cap_rows(df.filter(~is_rare), id_col, common_rows, seed).withColumn("copy", F.lit(0))
    return stack_rows(
        rare_side.withColumn(target, F.lit(MERGED_RARE_CODE)),
        common_side.withColumn(target, F.lit(FALSE_ALARM_CODE)),
    )


def stack_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both tables, by column name, copies kept."""
    return first.unionByName(second)


def _noise(features: Sequence[str], id_col: str, low: float, high: float, seed: int | str) -> list[Column]:
    return [
        (F.lit(low) + uniform(seed, F.col(id_col), place) * F.lit(high - low)).alias(name)
        for place, name in enumerate(features)
    ]


def uniform_noise(
    spark: SparkSession,
    features: Sequence[str],
    rows: int = NOISE_ROWS,
    low: float = NOISE_LOW,
    high: float = NOISE_HIGH,
    seed: int | str = SEED,
) -> DataFrame:
    """Rows of noise around the unit cube: the fallback when no contaminants are at hand."""
    return spark.range(rows).select(F.col("id").cast("string").alias("id"), *_noise(features, "id", low, high, seed))


def uniform_noise_like(
    df: DataFrame,
    features: Sequence[str],
    id_col: str,
    low: float = NOISE_LOW,
    high: float = NOISE_HIGH,
    seed: int | str = SEED,
) -> DataFrame:
    """One row of noise for every row of a table, under the same ids."""
    return df.select(F.col(id_col), *_noise(features, id_col, low, high, seed))


def balanced_bootstrap(
    df: DataFrame, label: str, id_col: str, bags: int, seed: int = SEED
) -> DataFrame:
    """Per bag, draws with replacement from every class up to the size of the smallest one.

    ``bag, draw`` are added. A draw is turned into a rank inside its class; ranks are found per bucket of
    keys, so a class that holds most rows is spread over many tasks.
    """
    counts = group_counts(df, label)
    smallest, largest = min(counts.values()), max(counts.values())
    ranked = ranked_by_key(
        df.filter(F.col(label).isNotNull()).withColumn("_key", draw_key(seed, F.col(id_col))), label, "_key", "_rank", largest
    ).drop("_key")
    names = list(counts)
    classes = small_table(
        df.sparkSession, {"_class": names, "_size": list(counts.values())}, {"_class": column_type(names), "_size": pa.int64()}
    )
    draws = (
        df.sparkSession.range(bags * smallest)
        .select(
            F.expr(f"CAST(id DIV {smallest} AS INT)").alias("bag"),
            F.expr(f"id % {smallest}").alias("draw"),
            F.explode(F.array(*[F.lit(name) for name in names])).alias("_class"),
        )
        .join(F.broadcast(classes), "_class")
        .withColumn(
            "_rank",
            wide_number(draw_key(seed, F.col("bag"), F.col("_class"), F.col("draw"))) % F.col("_size"),
        )
        .drop("_size")
    )
    return (
        draws.join(ranked, (F.col("_class") == F.col(label)) & (draws["_rank"] == ranked["_rank"]))
        .drop("_class", "_rank")
    )


def shard_of(df: DataFrame, id_col: str, shards: int, name: str = "shard") -> DataFrame:
    """Assign every row to one of ``shards`` output folders by its id."""
    return df.withColumn(name, (key_number(draw_key("shard", F.col(id_col))) % F.lit(shards)).cast("int"))
