"""Readers and writers of catalogues, id lists and verdicts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from raresift.constants import ID_COLUMN
from raresift.functions.values import label_or_null
from raresift.operators.curation import deletion_counts, delete_rows
from raresift.operators.sampling import shard_of
from raresift.schema import VERDICT_SCHEMA, require_columns
from raresift.session import spread


def format_of(path: str, given: str | None) -> str:
    if given:
        return given
    name = path.rstrip("/").lower()
    for kind in ("parquet", "csv", "orc", "json"):
        if name.endswith(f".{kind}") or name.endswith(f".{kind}.gz"):
            return kind
    return "parquet"


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A table with all its columns. CSV columns come as text, matched to the header of every file."""
    kind = format_of(path, fmt)
    if kind != "csv":
        return spark.read.format(kind).load(path)
    named = spark.read.option("header", True).csv(path).schema
    # Without this a file whose columns are in another order would be read by position.
    return spark.read.schema(named).option("header", True).option("enforceSchema", False).csv(path)


def read_catalogue(
    spark: SparkSession,
    path: str,
    features: Sequence[str],
    id_col: str = ID_COLUMN,
    label: str | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """Id as text, the label when asked for, and the features; nothing else is read from the files.

    A scan of few splits is dealt out over the cores.
    """
    wanted = [id_col, *([label] if label else []), *features]
    table = spread(require_columns(read_table(spark, path, fmt), wanted).select(*wanted), id_col)
    table = table.withColumn(id_col, F.col(id_col).cast("string"))
    return table.withColumn(label, label_or_null(F.col(label).cast("string"))) if label else table


def read_optional_table(spark: SparkSession, path: str | None, fmt: str | None = None) -> DataFrame | None:
    """Like ``read_table``, but None when there is no such path. A table that exists and cannot be read raises."""
    if not path:
        return None
    try:
        return read_table(spark, path, fmt)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_optional_ids(spark: SparkSession, path: str | None, id_col: str = ID_COLUMN, fmt: str | None = None) -> DataFrame:
    """The id column of a list, as text; empty when there is no such path."""
    table = read_optional_table(spark, path, fmt)
    if table is None:
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, T.StringType())]))
    return require_columns(table, [id_col]).select(F.col(id_col).cast("string").alias(id_col))


def read_known_lists(
    spark: SparkSession, source_lists: Sequence[str | None], verdict_lists: Sequence[str | None] = (), id_col: str = ID_COLUMN
) -> list[tuple[DataFrame, str]]:
    """Exclusion lists: source tables keyed by ``id_col`` and earlier verdicts keyed by ``id``."""
    return [
        *[(read_optional_ids(spark, path, id_col), id_col) for path in source_lists],
        *[(read_optional_ids(spark, path, "id"), "id") for path in verdict_lists],
    ]


def count_rows(df: DataFrame) -> int:
    return df.count()


def write_verdicts(
    df: DataFrame, path: str, fmt: str = "parquet", shards: int | None = None, compact: bool = False
) -> None:
    """Write verdict rows; with ``shards`` into that many folders. No header row ever ends up in the data.

    Rows are written where they are made. ``compact`` moves them first, into files of the advisory partition
    size: fewer files for the price of a shuffle.
    """
    rows = shard_of(df, "id", shards) if shards else df
    if compact:
        rows = rows.hint("rebalance", "shard") if shards else rows.hint("rebalance")
    writer = rows.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if shards:
        writer = writer.partitionBy("shard")
    writer.save(path)


def read_verdicts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The union of all shards of a verdict folder."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.schema(VERDICT_SCHEMA).option("header", True).option("enforceSchema", True)
    return reader.load(path).select(*VERDICT_SCHEMA.fieldNames())


def rewrite_without(target: DataFrame, listed: DataFrame, new_path: str, fmt: str = "parquet") -> int:
    """Write ``target`` without the listed rows to a new place and return how many went.

    Nothing is written when no row is listed. A table cannot be overwritten while it is being read, so the
    caller swaps paths.
    """
    removed = deletion_counts(target, listed).first().rows_removed
    if removed:
        writer = delete_rows(target, listed).write.mode("overwrite").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(new_path)
    return removed


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the newest committed version of a versioned table, None when there is none.

    A version counts once its name stands below ``commits``, where it is put by one small append after all its data
    is written. What a killed write left is named nowhere and never read.
    """
    try:
        return spark.read.text(f"{root}/commits").agg(F.max("value")).first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_version(spark: SparkSession, root: str, version: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A version of the table, the current one by default. Later writes do not touch it."""
    name = version or current_version(spark, root)
    if name is None:
        raise FileNotFoundError(f"no committed version below {root}")
    return read_table(spark, f"{root}/data/{name}", fmt)


def write_version(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Write the next version beside the others; it becomes the current one when it is complete."""
    name = _new_version(df.sparkSession, root)
    _write_data(df, f"{root}/data/{name}", fmt)
    _commit(df.sparkSession, root, name)
    return name


def rewrite_version_without(spark: SparkSession, root: str, listed: DataFrame, fmt: str = "parquet") -> int:
    """Make a version without the listed rows and return how many went; readers keep the version they have.

    The table is joined once: rows are counted before and after the join while they are written. When none was
    listed the current version stays.
    """
    name = _new_version(spark, root)
    before, after = Observation(), Observation()
    count = F.count(F.lit(1)).alias("rows")
    kept = delete_rows(read_version(spark, root, fmt=fmt).observe(before, count), listed).observe(after, count)
    _write_data(kept, f"{root}/data/{name}", fmt)
    removed = before.get["rows"] - after.get["rows"]
    if removed:
        _commit(spark, root, name)
    return removed


def _new_version(spark: SparkSession, root: str) -> str:
    current = current_version(spark, root)
    return f"{int(current.split('-')[0]) + 1 if current else 1:012d}-{uuid.uuid4().hex}"


def _write_data(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def _commit(spark: SparkSession, root: str, name: str) -> None:
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("append").text(f"{root}/commits")
