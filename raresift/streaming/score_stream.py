"""Scoring catalogue files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from raresift.constants import GATE_THRESHOLD, ID_COLUMN, SPECIALIST_THRESHOLD
from raresift.plans.score import score
from raresift.sources.bundle import Bundle


def stream_catalogue(
    spark: SparkSession, folder: str, schema: StructType, fmt: str = "csv", files_per_batch: int | None = None
) -> DataFrame:
    """A stream of catalogue files. CSV headers are checked against the schema's column order."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def score_stream(
    source: DataFrame,
    bundle: Bundle,
    output: str,
    checkpoint: str,
    id_col: str = ID_COLUMN,
    known: Sequence[tuple[DataFrame, str]] = (),
    fmt: str = "parquet",
    once: bool = True,
    gate: float = GATE_THRESHOLD,
    threshold: float = SPECIALIST_THRESHOLD,
    once_per_id: bool = False,
) -> StreamingQuery:
    """Score every new file exactly once and append the verdicts.

    The checkpoint remembers which files are done. With ``once`` the query stops when nothing new is left. With
    ``once_per_id`` it also remembers the ids scored: one that arrives again, in any later batch or run, is skipped.
    """
    writer = (
        score(source, bundle, id_col, known, gate, threshold, once_per_id)
        .writeStream.outputMode("append")
        .format(fmt)
        .option("checkpointLocation", checkpoint)
    )
    if fmt == "csv":
        writer = writer.option("header", True)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(output)
