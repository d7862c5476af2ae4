"""Exclusion of known ids and differences between versions of a list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from raresift.functions.values import all_of
from raresift.operators.bits import may_be_listed, worth_it
from raresift.operators.sizing import broadcast_if_small, measure
from raresift.schema import MissingColumns, require_columns
from raresift.session import materialise


def union_ids(lists: Sequence[tuple[DataFrame, str]], name: str = "id") -> DataFrame:
    """Distinct ids, as text, of several (table, id column) pairs."""
    columns = [
        require_columns(table, [column]).select(F.col(column).cast("string").alias(name)) for table, column in lists
    ]
    if not columns:
        raise ValueError("no id list given")
    return reduce(DataFrame.unionByName, columns).filter(F.col(name).isNotNull()).distinct()


def exclude_known(df: DataFrame, lists: Sequence[tuple[DataFrame, str]], id_col: str) -> DataFrame:
    """Rows whose id is on none of the lists. A row without id matches nothing and stays.

    A list measured to be small is broadcast. Of a longer one only a bit table is, and rows that are certainly on no list
    stay where they are; the rest, few but for the listed ones, are joined. A list too long for a bit table of bounded size
    is joined as a whole: neither the list nor anything made of it passes through the driver.
    """
    require_columns(df, [id_col])
    if not lists:
        return df
    # Written once: it is measured here and read again by the join, on a stream by every batch.
    known = materialise(union_ids(lists, "_known"))
    on_list = F.col(id_col).cast("string") == F.col("_known")
    size = measure(known, "_known")
    if size.small():
        return df.join(F.broadcast(known), on_list, "left_anti")
    if not worth_it(size.rows):
        return df.join(known, on_list, "left_anti")
    listed = may_be_listed(known, "_known", size.rows)(F.col(id_col))
    return df.filter(~listed).unionByName(df.filter(listed).join(known, on_list, "left_anti"))


def once_per_id(df: DataFrame, id_col: str) -> DataFrame:
    """One row per id; rows without id all stay.

    On a stream the ids seen so far are kept as state, so that a row is also dropped when its id came in an earlier batch,
    before a restart too. The state grows with the distinct ids; for very many keep it in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    require_columns(df, [id_col])
    nameless = F.col(id_col).isNull()
    return df.filter(~nameless).dropDuplicates([id_col]).unionByName(df.filter(nameless))


def known_source_stats(df: DataFrame, lists: Mapping[str, tuple[DataFrame, str]], id_col: str) -> DataFrame:
    """Per list: distinct ids on it and rows of ``df`` it removes; then the rows any list removes and the rest.

    Columns ``list``, ``listed_ids``, ``removed_rows``, ``residual_rows``. The lists are folded into one table
    with a flag per list, so the big table is joined once. Without the id column nothing is removed.
    """
    names = list(lists)
    flags = [f"_in_{position}" for position in range(len(names))]
    tagged = [
        require_columns(table, [column])
        .select(
            F.col(column).cast("string").alias("_known"),
            *[F.lit(position == own).alias(flag) for position, flag in enumerate(flags)],
        )
        .filter(F.col("_known").isNotNull())
        for own, (table, column) in enumerate(lists.values())
    ]
    ids = materialise(
        reduce(DataFrame.unionByName, tagged).groupBy("_known").agg(*[F.bool_or(flag).alias(flag) for flag in flags])
    )
    sizes = ids.agg(*[F.count_if(flag).alias(flag) for flag in flags])
    listed = sizes.select(_unpivot(names, [F.col(flag) for flag in flags], "listed_ids"))
    if id_col in df.columns:
        joined = df.select(F.col(id_col).cast("string").alias("_id")).join(
            broadcast_if_small(ids, "_known"), F.col("_id") == F.col("_known"), "left"
        )
    else:
        joined = df.select(*[F.lit(False).alias(flag) for flag in flags], F.lit(None).cast("string").alias("_known"))
    hit = F.col("_known").isNotNull()
    counts = joined.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(hit).alias("_any"),
        *[F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias(flag) for flag in flags],
    )
    removed = counts.select(
        _unpivot([*names, "any"], [*[F.col(flag) for flag in flags], F.col("_any")], "removed_rows"),
        (F.col("_rows") - F.col("_any")).alias("residual_rows"),
    )
    return removed.join(F.broadcast(listed), "list", "left").select(  # one row per list
        "list", "listed_ids", "removed_rows", "residual_rows"
    )


def _unpivot(names: Sequence[str], values: Sequence, name: str):
    return F.inline(
        F.array(*[F.struct(F.lit(label).alias("list"), value.alias(name)) for label, value in zip(names, values)])
    )


def filter_known_sources(
    df: DataFrame, lists: Mapping[str, tuple[DataFrame, str]], id_col: str
) -> tuple[DataFrame, DataFrame]:
    """(rows on no list, statistics)."""
    kept = exclude_known(df, list(lists.values()), id_col) if id_col in df.columns else df
    return kept, known_source_stats(df, lists, id_col)


def order_by_size(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(larger, smaller) by row count; the first one is the larger on a tie."""
    return (first, second) if first.count() >= second.count() else (second, first)


def _common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    names = [name for name in left.columns if name in set(right.columns)]
    if not names:
        raise MissingColumns("the tables have no column in common")
    return names


def rows_absent_from(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that equal no row of ``right`` on their common columns, missing equal to missing.

    Every copy of a matched row goes and every copy of an unmatched row stays. Copies in ``right`` are
    combined before the join, so a heavily repeated row is shuffled once per task.
    """
    names = _common_columns(left, right)
    listed = right.select(*[F.col(name).alias(f"_r_{name}") for name in names]).distinct()
    same = all_of(F.col(name).eqNullSafe(F.col(f"_r_{name}")) for name in names)
    return left.join(listed, same, "left_anti")


def row_delta(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows found only in the larger of two versions of a table."""
    larger, smaller = order_by_size(first, second)
    return rows_absent_from(larger, smaller)


def delete_rows(target: DataFrame, listed: DataFrame) -> DataFrame:
    """``target`` without the listed rows."""
    return rows_absent_from(target, listed)


def deletion_counts(target: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: rows before, removed and kept."""
    names = _common_columns(target, listed)
    flagged = listed.select(*[F.col(name).alias(f"_r_{name}") for name in names]).distinct().withColumn("_hit", F.lit(True))
    same = all_of(F.col(name).eqNullSafe(F.col(f"_r_{name}")) for name in names)
    hit = F.col("_hit").isNotNull()
    return target.join(flagged, same, "left").agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(hit).alias("rows_removed"),
        F.count_if(~hit).alias("rows_kept"),
    )
