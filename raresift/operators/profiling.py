"""Data-quality and class profiles. Each report is one aggregation over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from raresift.constants import LABEL_CANDIDATES, TOP_LABELS
from raresift.functions.values import all_of, is_infinite, is_missing, percent
from raresift.schema import require_columns
from raresift.session import materialise


def _missing(df: DataFrame, name: str) -> Column:
    numeric = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return is_missing(F.col(name)) if numeric else F.col(name).isNull()


def missing_counts(df: DataFrame, columns: Sequence[str], only_missing: bool = True) -> DataFrame:
    """``column, missing, percent`` per column, largest count first (ties in list order)."""
    require_columns(df, columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(_missing(df, name)).alias(f"_m{place}") for place, name in enumerate(columns)],
    )
    return _long_counts(counted, columns, only_missing)


def _long_counts(counted: DataFrame, columns: Sequence[str], only_missing: bool) -> DataFrame:
    """Counters ``_rows, _m0, _m1, ...`` of one row as a row per column."""
    entries = [
        F.struct(F.lit(place).alias("place"), F.lit(name).alias("column"), F.col(f"_m{place}").alias("missing"))
        for place, name in enumerate(columns)
    ]
    long = counted.select("_rows", F.inline(F.array(*entries)))
    if only_missing:
        long = long.filter(F.col("missing") > 0)
    return long.orderBy(F.desc("missing"), "place").select(
        "column", "missing", percent(F.col("missing"), F.col("_rows")).alias("percent")
    )


def row_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows before, kept and dropped when incomplete rows go."""
    require_columns(df, columns)
    whole = all_of(~_missing(df, name) for name in columns)
    return _kept_and_dropped(df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(whole).alias("rows_kept")))


def _kept_and_dropped(counted: DataFrame) -> DataFrame:
    return counted.select(
        "rows_before",
        "rows_kept",
        (F.col("rows_before") - F.col("rows_kept")).alias("rows_dropped"),
        percent(F.col("rows_before") - F.col("rows_kept"), F.col("rows_before")).alias("percent_dropped"),
    )


def missing_patterns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Row count per combination of missing flags; one boolean column per feature plus ``rows``."""
    require_columns(df, features)
    flags = df.select(*[_missing(df, name).alias(name) for name in features])
    return flags.groupBy(*features).agg(F.count(F.lit(1)).alias("rows"))


def counts_from_patterns(patterns: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``missing_counts`` out of a pattern table."""
    counted = patterns.agg(
        F.sum("rows").alias("_rows"),
        *[F.sum(F.when(F.col(name), F.col("rows")).otherwise(0)).alias(f"_m{place}") for place, name in enumerate(columns)],
    )
    return _long_counts(counted, columns, only_missing=True)


def rows_from_patterns(patterns: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``row_counts`` out of a pattern table."""
    whole = all_of(~F.col(name) for name in columns)
    kept = F.coalesce(F.sum(F.when(whole, F.col("rows"))), F.lit(0).cast("bigint"))
    return _kept_and_dropped(patterns.agg(F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("rows_before"), kept.alias("rows_kept")))


def missing_inclusion(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Is the missing set of each column inside that of the column that misses most?

    ``major, minor, minor_missing, mismatch, is_subset``, largest minor first. The data is read once, into
    the pattern table, which is small and frozen; both passes run on that.
    """
    return inclusion_from_patterns(materialise(missing_patterns(df, features)), features)


def inclusion_from_patterns(patterns: DataFrame, features: Sequence[str]) -> DataFrame:
    """``missing_inclusion`` out of a frozen pattern table."""
    sums = patterns.agg(*[F.sum(F.when(F.col(name), F.col("rows"))).alias(name) for name in features]).first()
    order = {name: place for place, name in enumerate(features)}
    ranked = sorted((name for name in features if sums[name]), key=lambda name: (-sums[name], order[name]))
    major = ranked[0] if ranked else features[0]
    minors = ranked[1:]
    if not minors:
        return patterns.select(
            F.lit(major).alias("major"),
            F.lit("").alias("minor"),
            F.lit(0).cast("bigint").alias("minor_missing"),
            F.lit(0).cast("bigint").alias("mismatch"),
            F.lit(True).alias("is_subset"),
        ).filter(F.lit(False))
    counted = patterns.agg(
        *[F.sum(F.when(F.col(name), F.col("rows")).otherwise(0)).alias(f"_n{i}") for i, name in enumerate(minors)],
        *[
            F.sum(F.when(F.col(name) & ~F.col(major), F.col("rows")).otherwise(0)).alias(f"_x{i}")
            for i, name in enumerate(minors)
        ],
    )
    entries = [
        F.struct(
            F.lit(major).alias("major"),
            F.lit(name).alias("minor"),
            F.col(f"_n{i}").alias("minor_missing"),
            F.col(f"_x{i}").alias("mismatch"),
        )
        for i, name in enumerate(minors)
    ]
    return counted.select(F.inline(F.array(*entries))).withColumn("is_subset", F.col("mismatch") == 0)


def class_distribution(df: DataFrame, label: str, by_count: bool = False) -> DataFrame:
    """``label, rows, percent``; ordered by label, or by count with ties by label. Missing labels are left out."""
    require_columns(df, [label])
    grouped = df.filter(~_missing(df, label)).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    total = grouped.agg(F.sum("rows")).scalar()
    shares = grouped.withColumn("percent", percent(F.col("rows"), total))
    return shares.orderBy(F.desc("rows"), "label") if by_count else shares.orderBy("label")


def guess_label_column(df: DataFrame) -> str | None:
    """First of the usual label names that the table has."""
    return next((name for name in LABEL_CANDIDATES if name in df.columns), None)


def top_labels(df: DataFrame, label: str | None = None, limit: int = TOP_LABELS) -> DataFrame:
    """Most frequent values of the label column, which is guessed when not named."""
    name = label or guess_label_column(df)
    if name is None:
        raise ValueError("the table has none of the usual label columns")
    grouped = df.filter(~_missing(df, name)).groupBy(F.col(name).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return grouped.orderBy(F.desc("rows"), "label").limit(limit).withColumn("label_column", F.lit(name))


def contaminant_report(df: DataFrame, features: Sequence[str], label: str | None = None) -> dict[str, DataFrame]:
    """Missing counts, inclusion, row counts and kinds of a contaminant table, each as a table of its own.

    The first three come from one pattern table, so the data is read once for them and once for the kinds.
    """
    patterns = materialise(missing_patterns(df, features))
    complete = df.na.drop("any", subset=list(features))
    report = {
        "missing": counts_from_patterns(patterns, features),
        "inclusion": inclusion_from_patterns(patterns, features),
        "rows": rows_from_patterns(patterns, features),
    }
    if label is not None:
        if label in df.columns:
            report["kinds"] = class_distribution(complete, label, by_count=True)
    elif guess_label_column(df) is not None:
        report["kinds"] = top_labels(complete)
    return report


def quality_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature ``nans, infs, total_bad, percent_bad``, plus ``valid_rows, valid_percent`` of the table."""
    require_columns(df, features)
    finite = all_of(~is_missing(F.col(name)) & ~is_infinite(F.col(name)) for name in features)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(finite).alias("valid_rows"),
        *[F.count_if(is_missing(F.col(name))).alias(f"_n{i}") for i, name in enumerate(features)],
        *[F.count_if(is_infinite(F.col(name))).alias(f"_i{i}") for i, name in enumerate(features)],
    )
    entries = [
        F.struct(F.lit(name).alias("feature"), F.col(f"_n{i}").alias("nans"), F.col(f"_i{i}").alias("infs"))
        for i, name in enumerate(features)
    ]
    bad = F.col("nans") + F.col("infs")
    return (
        counted.select("_rows", "valid_rows", F.inline(F.array(*entries)))
        .select(
            "feature",
            "nans",
            "infs",
            bad.alias("total_bad"),
            F.round(percent(bad, F.col("_rows")), 2).alias("percent_bad"),
            "valid_rows",
            percent(F.col("valid_rows"), F.col("_rows")).alias("valid_percent"),
        )
        .orderBy(F.desc("total_bad"), "feature")
    )


def importance_table(importances: DataFrame, missing: DataFrame, limit: int, max_missing: float, notable: float) -> DataFrame:
    """Importance beside the missing percentage; well filled columns only, most important first."""
    return (
        importances.join(missing.select(F.col("column").alias("feature"), F.col("percent").alias("missing_percent")), "feature")
        .filter(F.col("missing_percent") < max_missing)
        .withColumn("notable", F.col("importance") > notable)
        .orderBy(F.desc("importance"), "feature")
        .limit(limit)
    )
