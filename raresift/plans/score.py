"""Scoring a catalogue with a trained bundle. The same function serves tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from raresift.constants import GATE_THRESHOLD, ID_COLUMN, SPECIALIST_THRESHOLD
from raresift.operators.cascade import route, verdict_message, verdicts
from raresift.operators.cleaning import clean_features
from raresift.operators.curation import exclude_known, once_per_id
from raresift.schema import project_features
from raresift.sources.bundle import Bundle
from raresift.sources.tables import write_verdicts


def clean_catalogue(
    df: DataFrame, features: Sequence[str], id_col: str, known: Sequence[tuple[DataFrame, str]] = ()
) -> DataFrame:
    """Unknown, complete rows. Cheap tests come first: they run before any model sees a row."""
    return clean_features(exclude_known(project_features(df, features, id_col), known, id_col), features)


def scored_rows(
    df: DataFrame, bundle: Bundle, id_col: str = ID_COLUMN, known: Sequence[tuple[DataFrame, str]] = (), once: bool = False
) -> DataFrame:
    """Clean, scaled rows with every score column; with ``once`` an id is scored a single time."""
    clean = clean_catalogue(df, bundle.features, id_col, known)
    rows = bundle.scaler.transform(once_per_id(clean, id_col) if once else clean)
    return bundle.cascade.score(bundle.filtered(rows))


def score(
    df: DataFrame,
    bundle: Bundle,
    id_col: str = ID_COLUMN,
    known: Sequence[tuple[DataFrame, str]] = (),
    gate: float = GATE_THRESHOLD,
    threshold: float = SPECIALIST_THRESHOLD,
    once: bool = False,
) -> DataFrame:
    """One verdict row per complete, unknown source. Stateless and free of shuffles unless an id is to be scored ``once``."""
    rows = scored_rows(df, bundle, id_col, known, once)
    return verdicts(route(rows, gate=gate, threshold=threshold), id_col, bundle.labels)


def messages(
    df: DataFrame,
    bundle: Bundle,
    id_col: str = ID_COLUMN,
    gate: float = GATE_THRESHOLD,
    threshold: float = SPECIALIST_THRESHOLD,
) -> DataFrame:
    """``id, message`` for every complete row."""
    routed = route(scored_rows(df, bundle, id_col), gate=gate, threshold=threshold)
    return routed.select(F.col(id_col).cast("string").alias("id"), verdict_message(bundle.labels).alias("message"))


def score_to_files(
    df: DataFrame,
    bundle: Bundle,
    path: str,
    id_col: str = ID_COLUMN,
    known: Sequence[tuple[DataFrame, str]] = (),
    fmt: str = "parquet",
    shards: int | None = None,
    gate: float = GATE_THRESHOLD,
    threshold: float = SPECIALIST_THRESHOLD,
) -> dict[str, int]:
    """Score and write; rows written and rows per status are counted along the way."""
    progress = Observation("verdicts")
    counted = score(df, bundle, id_col, known, gate, threshold).observe(
        progress,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("status") == "OK").alias("ok"),
        F.count_if(F.col("status") == "UNCERTAIN").alias("uncertain"),
        F.count_if(F.col("status") == "ANOMALY").alias("anomalies"),
    )
    write_verdicts(counted, path, fmt, shards)
    return progress.get
