"""Confusion counts, reports and weights. Everything is derived from one grouped count over the rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from raresift.constants import (
    DEFAULT_SWEEP_THRESHOLD,
    FILTER_ISOLATION,
    FILTER_RECONSTRUCTION,
    LOW_ACCEPTANCE_PENALTY,
    MIN_VALID_ACCEPTANCE,
)
from raresift.functions.values import share
from raresift.operators.encoding import LabelCodes
from raresift.operators.ordering import sums_before
from raresift.operators.sizing import broadcast_if_small, small_table
from raresift.schema import require_columns
from raresift.session import materialise


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``truth, predicted, rows`` for the pairs that occur."""
    require_columns(df, [truth, predicted])
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("rows"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Every cell over the sorted union of labels, zeros included. The matrix itself is the output."""
    pairs = confusion(df, truth, predicted)
    labels = pairs.select(F.explode(F.array("truth", "predicted")).alias("label"))
    axis = labels.agg(F.sort_array(F.collect_set("label")).alias("axis"))
    cells = axis.select("axis", F.explode("axis").alias("truth")).select("truth", F.explode("axis").alias("predicted"))
    return cells.join(pairs, ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows")
    )


def binary_counts(truth: Column, predicted: Column) -> list[Column]:
    """Aggregates ``tn, fp, fn, tp`` of two boolean columns; zeros when a side never occurs."""
    return [
        F.count_if(~truth & ~predicted).alias("tn"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
        F.count_if(truth & predicted).alias("tp"),
    ]


def _per_label(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Support, predicted and correct rows per label."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("rows")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("truth").cast("string").alias("label"), F.col("rows").alias("support"), zero.alias("claimed"), hit.alias("hits")),
        F.struct(F.col("predicted").cast("string").alias("label"), zero.alias("support"), F.col("rows").alias("claimed"), zero.alias("hits")),
    )
    return (
        pairs.select(*keys, F.inline(sides))
        .groupBy(*keys, "label")
        .agg(*[F.sum(name).alias(name) for name in ("support", "claimed", "hits")])
    )


def _scored(per_label: DataFrame) -> DataFrame:
    return per_label.withColumns(
        {
            "precision": share(F.col("hits"), F.col("claimed")),
            "recall": share(F.col("hits"), F.col("support")),
            "f1": share(F.lit(2.0) * F.col("hits"), F.col("claimed") + F.col("support")),
        }
    )


def classification_report(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """``label, precision, recall, f1, support`` per class, then accuracy, macro and weighted averages.

    ``keys`` yields one report per value of further columns.
    """
    pairs = df.groupBy(*keys, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return report_from_pairs(pairs, keys)


def report_from_pairs(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The report of counted pairs ``truth, predicted, rows``."""
    scored = _scored(_per_label(pairs, keys))
    weight = F.col("support") * F.lit(1.0)

    def average(name: str) -> Column:
        return F.avg(name).alias(f"macro_{name}")

    def weighted(name: str) -> Column:
        return share(F.sum(F.col(name) * weight), F.sum("support")).alias(f"weighted_{name}")

    summary = scored.groupBy(*keys).agg(
        share(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("rows"),
        *[average(name) for name in ("precision", "recall", "f1")],
        *[weighted(name) for name in ("precision", "recall", "f1")],
    )
    nothing = F.lit(None).cast("double")

    def entry(label: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            F.col("rows").alias("support"),
        )

    overall = summary.select(
        *keys,
        F.inline(
            F.array(
                entry("accuracy", nothing, nothing, F.col("accuracy")),
                entry("macro avg", *[F.col(f"macro_{name}") for name in ("precision", "recall", "f1")]),
                entry("weighted avg", *[F.col(f"weighted_{name}") for name in ("precision", "recall", "f1")]),
            )
        ),
    )
    return scored.select(*keys, "label", "precision", "recall", "f1", "support").unionByName(overall)


def with_balanced_weight(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Weight ``n / (classes * rows of the class)`` per row; rows without class get none.

    The class counts are looked up, not windowed; a table of more classes than a broadcast holds is joined by shuffle.
    """
    counts = materialise(df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n")))
    rows, classes = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    weights = counts.select("_class", (F.lit(float(rows or 0)) / (F.lit(float(classes)) * F.col("_n"))).alias(weight))
    return df.join(broadcast_if_small(weights, "_class"), F.col(label) == F.col("_class"), "left").drop("_class")


def evaluate_predictions(
    df: DataFrame, truth: str, predicted: str, labels: LabelCodes | None = None
) -> tuple[DataFrame, DataFrame]:
    """(report, confusion matrix) with decoded class names when labels are given."""
    if labels is not None:
        df = df.withColumns({name: labels.decoded(F.col(name)) for name in (truth, predicted)})
    return classification_report(df, truth, predicted), confusion_matrix(df, truth, predicted)


def filter_rates(
    valid: DataFrame, noise: DataFrame | None, flags: dict[str, str]
) -> DataFrame:
    """``filter, valid_accepted, noise_rejected`` for each filter and its anomaly flag column.

    Without noise the rejected share is zero.
    """
    def rates(df: DataFrame, flagged: bool, name: str) -> DataFrame:
        wanted = df.agg(
            *[
                F.coalesce(F.avg(F.when(F.col(flag) == F.lit(flagged), 1.0).otherwise(0.0)), F.lit(0.0)).alias(flag)
                for flag in flags.values()
            ]
        )
        rows = [F.struct(F.lit(kind).alias("filter"), F.col(flag).alias(name)) for kind, flag in flags.items()]
        return wanted.select(F.inline(F.array(*rows)))

    accepted = rates(valid, False, "valid_accepted")
    if noise is None:
        return accepted.withColumn("noise_rejected", F.lit(0.0))
    return accepted.join(rates(noise, True, "noise_rejected"), "filter")


def choose_filter(rates: DataFrame) -> DataFrame:
    """One row ``filter, score``: best noise rejection, marked down when too many valid rows are lost.

    The reconstruction filter wins a tie.
    """
    score = F.col("noise_rejected") - F.when(F.col("valid_accepted") > MIN_VALID_ACCEPTANCE, 0.0).otherwise(
        LOW_ACCEPTANCE_PENALTY
    )
    preference = F.when(F.col("filter") == FILTER_RECONSTRUCTION, 0).when(F.col("filter") == FILTER_ISOLATION, 1).otherwise(2)
    return (
        rates.select("filter", score.alias("score"), preference.alias("_preference"))
        .orderBy(F.desc("score"), "_preference")
        .limit(1)
        .drop("_preference")
    )


def threshold_sweep(
    df: DataFrame, truth: Column, claim, thresholds: Sequence[float]
) -> DataFrame:
    """``threshold, tp, fp, fn, precision, recall, f1`` of the rare class for every threshold, in one pass.

    ``claim(threshold)`` is the boolean column "called rare at this threshold".
    """
    places = list(enumerate(thresholds))
    counted = df.agg(
        *[F.count_if(truth & claim(value)).alias(f"_tp{i}") for i, value in places],
        *[F.count_if(~truth & claim(value)).alias(f"_fp{i}") for i, value in places],
        F.count_if(truth).alias("_rare"),
    )
    entries = [
        F.struct(
            F.lit(i).alias("place"),
            F.lit(float(value)).alias("threshold"),
            F.col(f"_tp{i}").alias("tp"),
            F.col(f"_fp{i}").alias("fp"),
            (F.col("_rare") - F.col(f"_tp{i}")).alias("fn"),
        )
        for i, value in places
    ]
    return _rates(counted.select(F.inline(F.array(*entries))))


def _rates(figures: DataFrame) -> DataFrame:
    return figures.withColumns(
        {
            "precision": share(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": share(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": share(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def _sweep_observed(rows: DataFrame) -> DataFrame:
    """The sweep of ``_truth, _score`` at every distinct score, however many there are.

    Rows are counted per score; a threshold is reached by all rows but those of smaller scores, whose counts are added
    up range by range. NaN reaches every threshold and is none.
    """
    score = F.when(F.col("_score") == 0, F.lit(0.0)).otherwise(F.col("_score"))  # one zero
    counted = rows.filter("_score IS NOT NULL").groupBy(score.alias("threshold"))
    counted = materialise(counted.agg(F.count_if("_truth").alias("_rare"), F.count_if(~F.col("_truth")).alias("_common"), F.lit(1).alias("_one")))
    able = F.col("_score").isNotNull()
    totals = rows.agg(
        F.count_if("_truth").alias("_all"), F.count_if(F.col("_truth") & able).alias("_able_rare"), F.count_if(~F.col("_truth") & able).alias("_able_common")
    )
    before = sums_before(counted, "threshold", {"place": "_one", "_less_rare": "_rare", "_less_common": "_common"})
    # One row of totals.
    figures = before.filter(~F.isnan("threshold")).crossJoin(F.broadcast(totals))
    reached = figures.withColumns({"tp": F.col("_able_rare") - F.col("_less_rare"), "fp": F.col("_able_common") - F.col("_less_common")})
    return _rates(reached.select("place", "threshold", "tp", "fp", (F.col("_all") - F.col("tp")).alias("fn")))


def sweep_scores(
    df: DataFrame, truth: Column, able: Column, score: str, thresholds: Sequence[float] | None = None
) -> DataFrame:
    """The same table for claims of the form "``able`` and score at least the threshold", at any number of thresholds.

    Without ``thresholds`` all observed scores of able rows are tried. Else a row is counted once, under the number of
    thresholds that its score reaches (a binary search inside the JVM); sums over these counts give every
    threshold's figures, so the data is read once and a row per threshold is shuffled.
    """
    rows = df.select(F.coalesce(truth, F.lit(False)).alias("_truth"), F.when(able, F.col(score).cast("double")).alias("_score"))
    if thresholds is None:
        # Read by the counts and by their totals, so the scores are worked out once.
        return _sweep_observed(materialise(rows))
    spark, rising = df.sparkSession, sorted(range(len(thresholds)), key=lambda place: thresholds[place])
    steps = [1 << power for power in reversed(range(max(1, len(rising).bit_length())))]
    # One text, which the planner folds into a literal array.
    listed = F.split(F.lit(",".join(repr(float(thresholds[place])) for place in rising)), ",").cast("array<double>")

    def further(passed: Column, step: Column) -> Column:
        ahead = passed + step
        return F.when((ahead <= len(rising)) & (F.get(listed, ahead - 1) <= F.col("_score")), ahead).otherwise(passed)

    reached = F.when(F.col("_score").isNull(), 0).otherwise(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further))
    counted = (
        rows.withColumn("_reached", reached)
        .groupBy("_reached")
        .agg(F.count_if("_truth").alias("_rare"), F.count_if(~F.col("_truth")).alias("_common"))
    )
    kinds = {"_rank": pa.int32(), "place": pa.int32(), "threshold": pa.float64()}
    places = {"_rank": range(len(rising) + 1), "place": [-1, *rising], "threshold": [None, *[float(thresholds[place]) for place in rising]]}
    joined = small_table(spark, places, kinds).join(counted, F.col("_rank") == F.col("_reached"), "left")
    # One row per threshold.
    from_here = Window.partitionBy().orderBy(F.desc("_rank"))
    figures = joined.select(
        "place",
        "threshold",
        F.sum(F.coalesce("_rare", F.lit(0))).over(from_here).alias("tp"),
        F.sum(F.coalesce("_common", F.lit(0))).over(from_here).alias("fp"),
        F.sum(F.coalesce("_rare", F.lit(0))).over(Window.partitionBy()).alias("_all"),
    )
    return _rates(figures.filter("place >= 0").select("place", "threshold", "tp", "fp", (F.col("_all") - F.col("tp")).alias("fn")))


def best_threshold(sweep: DataFrame) -> float:
    """Threshold of the best F1, the earlier one on ties; the default when no F1 is above zero."""
    best = sweep.filter("f1 > 0").orderBy(F.desc("f1"), "place").limit(1).collect()
    return best[0].threshold if best else DEFAULT_SWEEP_THRESHOLD
