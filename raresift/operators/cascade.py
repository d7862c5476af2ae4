"""Routing of scored rows, verdict rows and verdict texts.

Routing takes score columns, not models, so any scorer can feed it:
``filter_score, is_anomaly, p_rare, spec_label, spec_conf, gen_label, gen_conf``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from raresift.constants import (
    GATE_THRESHOLD,
    MERGED_RARE_CODE,
    MESSAGE_CONFIRMED,
    MESSAGE_PLAIN,
    MESSAGE_REJECTED,
    MESSAGE_UNKNOWN,
    NO_LABEL,
    OK_CONFIDENCE,
    SPECIALIST_THRESHOLD,
    STAGE_CONFIRMED,
    STAGE_DIRECT,
    STAGE_FILTER,
    STAGE_REJECTED,
    STATUS_ANOMALY,
    STATUS_OK,
    STATUS_UNCERTAIN,
)
from raresift.operators.encoding import LabelCodes
from raresift.schema import require_columns

SCORE_COLUMNS = ("p_rare", "spec_label", "spec_conf", "gen_label", "gen_conf")


def suspected(gate: float = GATE_THRESHOLD) -> Column:
    """The gate lets the row through to the specialist."""
    return F.col("p_rare") >= F.lit(gate)


def confirmed(threshold: float = SPECIALIST_THRESHOLD, rare_code: int = MERGED_RARE_CODE) -> Column:
    """The specialist calls the row rare and is sure enough."""
    return (F.col("spec_label") == F.lit(rare_code)) & (F.col("spec_conf") >= F.lit(threshold))


def route(
    df: DataFrame,
    rare_code: int = MERGED_RARE_CODE,
    gate: float = GATE_THRESHOLD,
    threshold: float = SPECIALIST_THRESHOLD,
) -> DataFrame:
    """Add ``pred_code, confidence, stage``. Rows flagged ``is_anomaly`` stop at the filter with no code."""
    require_columns(df, SCORE_COLUMNS)
    stopped = F.col("is_anomaly") if "is_anomaly" in df.columns else F.lit(False)
    rare = suspected(gate) & confirmed(threshold, rare_code)
    stage = (
        F.when(stopped, STAGE_FILTER)
        .when(~suspected(gate), STAGE_DIRECT)
        .when(confirmed(threshold, rare_code), STAGE_CONFIRMED)
        .otherwise(STAGE_REJECTED)
    )
    code = F.when(stopped, F.lit(None).cast("int")).when(rare, F.lit(rare_code)).otherwise(F.col("gen_label").cast("int"))
    confidence = F.when(stopped, 0.0).when(rare, F.col("spec_conf")).otherwise(F.col("gen_conf"))
    return df.withColumns({"pred_code": code, "confidence": confidence, "stage": stage})


def _label(labels: LabelCodes | None) -> Column:
    return labels.decoded(F.col("pred_code")) if labels else F.col("pred_code").cast("string")


def verdicts(df: DataFrame, id_col: str, labels: LabelCodes | None = None) -> DataFrame:
    """The six output columns of routed rows; numbers are rounded here and nowhere earlier."""
    stopped = F.col("stage") == STAGE_FILTER
    status = (
        F.when(stopped, STATUS_ANOMALY)
        .when(F.col("confidence") >= F.lit(OK_CONFIDENCE), STATUS_OK)
        .otherwise(STATUS_UNCERTAIN)
    )
    return df.select(
        F.col(id_col).cast("string").alias("id"),
        status.alias("status"),
        F.when(stopped, F.lit(NO_LABEL)).otherwise(_label(labels)).alias("pred_label"),
        F.round("confidence", 4).alias("confidence"),
        F.col("stage"),
        F.round("filter_score", 6).alias("filter_score"),
    )


def verdict_message(labels: LabelCodes | None = None) -> Column:
    """One line of text per routed row."""
    plain = F.format_string(MESSAGE_PLAIN, _label(labels), F.col("confidence"))
    return (
        F.when(F.col("stage") == STAGE_FILTER, F.lit(MESSAGE_UNKNOWN))
        .when(F.col("stage") == STAGE_CONFIRMED, F.concat(F.lit(MESSAGE_CONFIRMED), plain))
        .when(F.col("stage") == STAGE_REJECTED, F.concat(F.lit(MESSAGE_REJECTED), plain))
        .otherwise(plain)
    )
