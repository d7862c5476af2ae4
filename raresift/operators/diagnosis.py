"""Where the cascade wins and loses rows. Inputs are scored rows with a true class code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from raresift.constants import GATE_THRESHOLD, MERGED_RARE_CODE, RARE_CODES, SPECIALIST_THRESHOLD
from raresift.functions.values import share
from raresift.operators.cascade import confirmed, suspected
from raresift.operators.metrics import binary_counts, classification_report


def _with_flags(df: DataFrame, truth: str, rare: Sequence[int], gate: float, threshold: float) -> DataFrame:
    return df.withColumns(
        {
            "is_rare": F.col(truth).isin(*rare),
            "is_suspect": suspected(gate),
            "is_confirmed": confirmed(threshold),
        }
    )


def gate_diagnostics(
    df: DataFrame, truth: str, rare: Sequence[int] = RARE_CODES, gate: float = GATE_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """(report, counts) of "let through" against "truly rare" over all rows."""
    flagged = df.select(F.col(truth).isin(*rare).alias("is_rare"), suspected(gate).alias("is_suspect"))
    return (
        classification_report(flagged, "is_rare", "is_suspect"),
        flagged.agg(*binary_counts(F.col("is_rare"), F.col("is_suspect"))),
    )


def specialist_diagnostics(
    df: DataFrame,
    truth: str,
    rare: Sequence[int] = RARE_CODES,
    gate: float = GATE_THRESHOLD,
    threshold: float = SPECIALIST_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(report, counts) of "confirmed" against "truly rare" over the rows past the gate."""
    past = _with_flags(df, truth, rare, gate, threshold).filter("is_suspect")
    counts = past.agg(
        F.count(F.lit(1)).alias("analysed"),
        F.count_if("is_rare").alias("truly_rare"),
        *binary_counts(F.col("is_rare"), F.col("is_confirmed")),
    )
    return classification_report(past, "is_rare", "is_confirmed"), counts


def generalist_diagnostics(df: DataFrame, truth: str, rare: Sequence[int] = RARE_CODES) -> DataFrame:
    """Report of the generalist over every truly common row, however it was routed."""
    return classification_report(df.filter(~F.col(truth).isin(*rare)), truth, "gen_label")


def contaminant_flow(
    df: DataFrame,
    gate: float = GATE_THRESHOLD,
    threshold: float = SPECIALIST_THRESHOLD,
    rare_code: int = MERGED_RARE_CODE,
) -> DataFrame:
    """``step, rows, share``: where known junk is stopped, and how much leaks out as rare.

    Shares are of all rows; steps nothing reaches are zero.
    """
    passed = ~F.col("is_anomaly")
    suspect = passed & suspected(gate)
    leaked = suspect & confirmed(threshold, rare_code)
    steps = {
        "blocked": F.col("is_anomaly"),
        "passed": passed,
        "to_generalist": passed & ~suspected(gate),
        "to_specialist": suspect,
        "false_alarm": suspect & ~confirmed(threshold, rare_code),
        "leaked": leaked,
    }
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(test).alias(step) for step, test in steps.items()])
    entries = [F.struct(F.lit(step).alias("step"), F.col(step).alias("rows")) for step in steps]
    return counted.select("_rows", F.inline(F.array(*entries))).select(
        "step", "rows", share(F.col("rows"), F.col("_rows")).alias("share")
    )
