"""Training: from a labelled table and known contaminants to a bundle and its reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from raresift.constants import (
    CONTAMINANT_LABEL_COLUMN,
    FILTER_ISOLATION,
    FILTER_RECONSTRUCTION,
    GATE_THRESHOLD,
    ID_COLUMN,
    LABEL_COLUMN,
    MERGED_RARE_CODE,
    SEED,
    SPECIALIST_THRESHOLD,
    TEST_SHARE,
)
from raresift.operators.cascade import route, suspected
from raresift.operators.cleaning import clean_features, coerce_features, normalise_missing
from raresift.operators.diagnosis import contaminant_flow, gate_diagnostics, generalist_diagnostics, specialist_diagnostics
from raresift.operators.encoding import LabelCodes, fit_labels, merged_code
from raresift.operators.isolation import fit_isolation, strange
from raresift.operators.metrics import best_threshold, choose_filter, classification_report, filter_rates, sweep_scores
from raresift.operators.models import Cascade, CascadeConfig, train_cascade
from raresift.operators.profiling import (
    class_distribution,
    contaminant_report,
    counts_from_patterns,
    inclusion_from_patterns,
    missing_patterns,
    rows_from_patterns,
)
from raresift.operators.reconstruction import above, fit_dense, fit_linear, fit_threshold
from raresift.operators.sampling import cap_rows, split_rows, stratified_split, uniform_noise
from raresift.operators.scaling import MinMax, fit_minmax
from raresift.schema import project_features
from raresift.session import materialise, materialise_evenly
from raresift.sources.bundle import Bundle


@dataclass(frozen=True)
class TrainConfig:
    name: str = "cascade"
    isolation_trees: int = 500
    contamination: float = 0.01
    reconstruction: str = "linear"  # or "dense"
    reconstruction_width: int | None = None
    epochs: int = 100
    #: Specialist thresholds to try; None tries all scores observed on held-out rows.
    sweep: tuple[float, ...] | None = (SPECIALIST_THRESHOLD,)
    cascade: CascadeConfig = field(default_factory=CascadeConfig)
    seed: int = SEED


@dataclass(frozen=True)
class Prepared:
    """A labelled table ready for fitting, with its profile."""

    rows: DataFrame
    labels: LabelCodes
    profile: dict[str, DataFrame]


def prepare_training(
    df: DataFrame, features: Sequence[str], label: str = LABEL_COLUMN, id_col: str = ID_COLUMN
) -> Prepared:
    """Profile missing values, keep complete rows and give every class its code (column ``code``)."""
    raw = project_features(df, features, id_col, extra=[label])
    table = normalise_missing(coerce_features(raw, features), features)
    rows = clean_features(raw, features, also=[label])
    labels = fit_labels(rows, label)
    patterns = materialise(missing_patterns(table, [*features, label]))
    profile = {
        "missing": counts_from_patterns(patterns, [*features, label]),
        "inclusion": inclusion_from_patterns(patterns, features),
        "rows": rows_from_patterns(patterns, [*features, label]),
        "classes": class_distribution(rows, label),
    }
    return Prepared(labels.encode(rows, label, "code"), labels, profile)


def load_contaminants(
    df: DataFrame | None, features: Sequence[str], scaler: MinMax, id_col: str = ID_COLUMN, rows: int | None = None
) -> DataFrame | None:
    """Clean and scaled contaminants, all of them unless ``rows`` asks for a sample; None when nothing is usable.

    An id column is needed for a sample only.
    """
    if df is None or not set(features) <= set(df.columns):
        return None
    ids = [id_col] if rows is not None or id_col in df.columns else []
    clean = clean_features(df.select(*ids, *features), features)
    if clean.isEmpty():
        return None
    return scaler.transform(clean if rows is None else cap_rows(clean, id_col, rows))


def profile_contaminants(
    df: DataFrame | None, features: Sequence[str], label: str = CONTAMINANT_LABEL_COLUMN
) -> dict[str, DataFrame]:
    """What a contaminant table holds: missing values, which features miss together, complete rows, kinds.

    Text that is no number and infinite values count as missing. Kinds come from ``label`` where the table has it, else from
    the first usual label column. Nothing without a table or without all features.
    """
    if df is None or not set(features) <= set(df.columns):
        return {}
    table = normalise_missing(coerce_features(df, features), features)
    made = contaminant_report(table, features, label if label in df.columns else None)
    return {f"contaminant_{name}": report for name, report in made.items()}


@dataclass(frozen=True)
class Trained:
    bundle: Bundle
    threshold: float
    profile: dict[str, DataFrame]
    reports: dict[str, DataFrame]


def train(
    df: DataFrame,
    contaminants: DataFrame | None,
    features: Sequence[str],
    label: str = LABEL_COLUMN,
    id_col: str = ID_COLUMN,
    config: TrainConfig = TrainConfig(),
) -> Trained:
    """Fit scaler, both filters and the cascade; keep the better filter; report on the held-out rows.

    Contaminants are profiled as they come (reports ``contaminant_missing``, ``_inclusion``, ``_rows``, ``_kinds``). Where
    there are none, or none with all features in numbers, uniform noise takes their place.
    """
    features = list(features)
    prepared = prepare_training(df, features, label, id_col)
    # The raw table is read once more; the split and every fit below work on what is written here.
    clean = materialise_evenly(prepared.rows.select(id_col, label, "code", *features))
    marked = materialise(stratified_split(clean, label, id_col, TEST_SHARE, config.seed))
    fitted, held_out = split_rows(marked)
    scaler = fit_minmax(fitted, features)
    kept = [id_col, "code", *features]
    training = scaler.transform(fitted).select(*kept)
    testing = scaler.transform(held_out).select(*kept)
    noise = load_contaminants(contaminants, features, scaler, id_col)
    about_noise = profile_contaminants(contaminants, features)
    if noise is None:
        noise = uniform_noise(df.sparkSession, features, seed=config.seed)

    bundle, rates = _filters(training, testing, noise, scaler, features, id_col, prepared.labels, config)
    rare = config.cascade.rare_codes
    scored = materialise(bundle.cascade.score(testing))
    sweep = sweep_scores(
        scored, F.col("code").isin(*rare), suspected(GATE_THRESHOLD) & (F.col("spec_label") == MERGED_RARE_CODE), "spec_conf", config.sweep
    )
    threshold = best_threshold(sweep)
    routed = route(scored, threshold=threshold).withColumn("merged", merged_code(F.col("code"), rare))
    gate_report, gate_counts = gate_diagnostics(scored, "code", rare)
    specialist_report, specialist_counts = specialist_diagnostics(scored, "code", rare)
    reports = {
        "filters": rates,
        "sweep": sweep,
        "final": classification_report(routed, "merged", "pred_code"),
        "gate": gate_report,
        "gate_counts": gate_counts,
        "specialist": specialist_report,
        "specialist_counts": specialist_counts,
        "generalist": generalist_diagnostics(scored, "code", rare),
        **about_noise,
        "contaminant_flow": contaminant_flow(bundle.cascade.score(bundle.filtered(noise)), rare_code=MERGED_RARE_CODE),
    }
    return Trained(replace(bundle, best_threshold=threshold), threshold, prepared.profile, reports)


def _filters(training, testing, noise, scaler, features, id_col, labels, config) -> tuple[Bundle, DataFrame]:
    """Fit both filters, compare them on held-out rows and noise, and wrap the winner with the cascade."""
    isolation = fit_isolation(training, features, id_col, config.isolation_trees, config.contamination, seed=config.seed)
    if config.reconstruction == "dense":
        rebuilt = fit_dense(training, features, config.reconstruction_width or 32, config.epochs, seed=config.seed)
    else:
        rebuilt = fit_linear(training, features, config.reconstruction_width or 8)
    threshold = fit_threshold(materialise(rebuilt.score(training).select("filter_score")))

    def flagged(rows: DataFrame) -> DataFrame:
        both = isolation.score(rebuilt.score(rows, "_error"), "_strangeness")
        return both.select(strange("_strangeness").alias("by_isolation"), above(threshold, "_error").alias("by_error"))

    rates = filter_rates(
        flagged(testing), flagged(noise), {FILTER_ISOLATION: "by_isolation", FILTER_RECONSTRUCTION: "by_error"}
    )
    rates = materialise(rates)
    winner = choose_filter(rates).first()["filter"]
    cascade: Cascade = train_cascade(training, features, "code", id_col, config.cascade)
    bundle = Bundle(
        name=config.name,
        scaler=scaler,
        filter_type=winner,
        filter_model=isolation if winner == FILTER_ISOLATION else rebuilt,
        threshold=None if winner == FILTER_ISOLATION else threshold,
        cascade=cascade,
        labels=labels,
    )
    return bundle, rates
