"""The scoring job as one query, filter scores, and queries that fit models."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raresift.functions.values import mean_squared_error, position_of_max, total
from raresift.operators.cascade import route, verdicts
from raresift.operators.cleaning import clean_features
from raresift.operators.curation import exclude_known
from raresift.operators.isolation import fit_score_isolation, strange
from raresift.operators.metrics import classification_report
from raresift.operators.models import CascadeConfig, feature_importance, train_classifier, with_vector
from raresift.operators.reconstruction import LinearReconstruction, above, fit_dense, fit_linear, fit_threshold
from raresift.operators.sampling import population_spread
from raresift.operators.scaling import fit_minmax
from raresift.operators.sizing import small_table
from raresift.plans.inputs import (
    LINES,
    LINE_FEATURES,
    ORDER_FEATURES,
    VECTORS,
    VECTOR_FEATURES,
    lines,
    measurements,
    orders,
    vectors,
)
from raresift.plans.queries_samples import FLAGS, SQL_ROUTED, SQL_SCALED_LINES, SQL_VERDICT, scaled_lines
from raresift.plans.queries_tables import CLEANED, scratch, sql_scaled
from raresift.plans.registry import query, round_all, sql_rounded, with_parts
from raresift.plans.score import messages, score
from raresift.plans.train import TrainConfig, Trained, load_contaminants, train
from raresift.session import materialise, materialise_evenly
from raresift.sources.bundle import load_bundle, save_bundle
from raresift.streaming.score_stream import score_stream, stream_catalogue

# --- the reconstruction filter with given weights ------------------------------------------------

GIVEN = LinearReconstruction(tuple(LINE_FEATURES), (0.5, 0.5, 0.5, 0.5), ((0.5, 0.5, 0.5, 0.5), (0.5, 0.5, -0.5, -0.5)))


def _double(number: float) -> str:
    return f"CAST({number} AS DOUBLE)"


def sql_reconstruction(source: str, result: str) -> str:
    """Parts that add ``filter_score`` to ``source`` under the given weights."""
    codes = ", ".join(
        "("
        + " + ".join(
            f"({name} - {_double(middle)}) * {_double(weight)}" for name, middle, weight in zip(LINE_FEATURES, GIVEN.mean, direction)
        )
        + f") AS code_{j}"
        for j, direction in enumerate(GIVEN.components)
    )
    length = " + ".join(f"({name} - {_double(middle)}) * ({name} - {_double(middle)})" for name, middle in zip(LINE_FEATURES, GIVEN.mean))
    coded = " + ".join(f"code_{j} * code_{j}" for j in range(len(GIVEN.components)))
    error = f"greatest(({length}) - ({coded}), {_double(0.0)}) / {_double(len(LINE_FEATURES))}"
    return f"{result}_codes AS (SELECT *, {codes} FROM {source}), {result} AS (SELECT *, {error} AS filter_score FROM {result}_codes)"


def sql_rebuilt(place: int) -> str:
    return " + ".join(f"code_{j} * {_double(direction[place])}" for j, direction in enumerate(GIVEN.components))


@query("recon_score", with_parts([SQL_SCALED_LINES, sql_reconstruction("scaled", "errors")], f"SELECT id, {sql_rounded('filter_score')} AS filter_score FROM errors"))
def recon_score(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(GIVEN.score(scaled_lines(spark, folder)).select("id", "filter_score"), ["filter_score"])


@query(
    "row_error",
    with_parts(
        [SQL_SCALED_LINES, sql_reconstruction("scaled", "errors")],
        "SELECT id, "
        + sql_rounded(
            "("
            + " + ".join(f"power({name} - ({_double(GIVEN.mean[i])} + {sql_rebuilt(i)}), 2)" for i, name in enumerate(LINE_FEATURES))
            + f") / {_double(len(LINE_FEATURES))}"
        )
        + " AS error FROM errors",
    ),
)
def row_error(spark: SparkSession, folder: str) -> DataFrame:
    """Mean squared difference between each row and its rebuilt form, spelled out."""
    error = mean_squared_error([F.col(name) for name in LINE_FEATURES], GIVEN.rebuilt())
    return round_all(scaled_lines(spark, folder).select("id", error.alias("error")), ["error"])


@query(
    "percentile_threshold",
    with_parts([SQL_SCALED_LINES, sql_reconstruction("scaled", "errors")], f"SELECT {sql_rounded('quantile_cont(filter_score, 0.95)')} AS threshold FROM errors"),
)
def percentile_threshold(spark: SparkSession, folder: str) -> DataFrame:
    threshold = fit_threshold(GIVEN.score(scaled_lines(spark, folder)))
    return round_all(small_table(spark, {"threshold": [threshold]}, {"threshold": pa.float64()}), ["threshold"])


@query(
    "population_spread",
    with_parts([SQL_SCALED_LINES], "SELECT " + ", ".join(f"{sql_rounded(f'stddev_pop({name})')} AS {name}" for name in LINE_FEATURES) + " FROM scaled"),
)
def population_spread_query(spark: SparkSession, folder: str) -> DataFrame:
    spread = population_spread(scaled_lines(spark, folder), LINE_FEATURES)
    return round_all(small_table(spark, {name: [value] for name, value in spread.items()}, {name: pa.float64() for name in spread}), LINE_FEATURES)


@query(
    "row_maximum",
    with_parts(
        [VECTORS, "listed AS (SELECT id, [" + ", ".join(VECTOR_FEATURES) + "] AS x FROM vectors)"],
        f"SELECT id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS place, {sql_rounded('list_max(x)')} AS top FROM listed",
    ),
)
def row_maximum(spark: SparkSession, folder: str) -> DataFrame:
    """Position and value of the largest number of each row: how class and confidence come from probabilities."""
    listed = vectors(spark, folder).select("id", F.array(*VECTOR_FEATURES).alias("x"))
    return round_all(listed.select("id", position_of_max(F.col("x")).alias("place"), F.array_max("x").alias("top")), ["top"])


CONTAMINANT_FEATURES = ["written", "unstable", "value"]


@query(
    "load_contaminants",
    with_parts(
        [CLEANED, "capped AS (SELECT * FROM cleaned ORDER BY md5('42|' || id) LIMIT 10000)"],
        "SELECT id, "
        + ", ".join(f"{sql_rounded(sql_scaled(name, 'cleaned'))} AS {name}" for name in CONTAMINANT_FEATURES)
        + " FROM capped",
    ),
)
def load_contaminants_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = measurements(spark, folder).select("id", *CONTAMINANT_FEATURES)
    scaler = fit_minmax(clean_features(rows, CONTAMINANT_FEATURES), CONTAMINANT_FEATURES)
    return round_all(load_contaminants(rows, CONTAMINANT_FEATURES, scaler, "id"), CONTAMINANT_FEATURES)


# --- the flagship: score a catalogue -------------------------------------------------------------

#: Weights per scaled feature and shift of three logistic scorers, given as the reconstruction above is.
GIVEN_SCORERS = {
    "gate": ((7.0, -5.0, 4.0, 2.0), -6.0),
    "specialist": ((-3.0, 2.0, 9.0, -6.0), 0.5),
    "generalist": ((-4.0, 6.0, 1.0, 3.0), -1.5),
}


def given_chance(name: str) -> Column:
    weights, shift = GIVEN_SCORERS[name]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total([*[F.col(x) * F.lit(w) for x, w in zip(LINE_FEATURES, weights)], F.lit(shift)])))


def given_scores() -> dict[str, Column]:
    """Score columns of a cascade whose three models are the given scorers over the scaled features."""
    rare, common = given_chance("specialist"), given_chance("generalist")
    return {
        "p_rare": given_chance("gate"),
        "spec_label": F.when(rare >= 0.5, F.lit(2)).otherwise(F.lit(99)),
        "spec_conf": F.greatest(rare, F.lit(1.0) - rare),
        "gen_label": F.when(common >= 0.5, F.lit(0)).otherwise(F.lit(1)),
        "gen_conf": F.greatest(common, F.lit(1.0) - common),
    }


def sql_chance(name: str) -> str:
    weights, shift = GIVEN_SCORERS[name]
    summed = " + ".join([*[f"{x} * {_double(w)}" for x, w in zip(LINE_FEATURES, weights)], _double(shift)])
    return f"({_double(1.0)} / ({_double(1.0)} + exp(-({summed}))))"


SQL_GIVEN_SCORES = f"""{sql_chance('gate')} AS p_rare,
       CASE WHEN {sql_chance('specialist')} >= 0.5 THEN 2 ELSE 99 END AS spec_label,
       greatest({sql_chance('specialist')}, 1 - {sql_chance('specialist')}) AS spec_conf,
       CASE WHEN {sql_chance('generalist')} >= 0.5 THEN 0 ELSE 1 END AS gen_label,
       greatest({sql_chance('generalist')}, 1 - {sql_chance('generalist')}) AS gen_conf"""


def raw_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with one feature written as text, in places badly."""
    hundredths = (F.col("tax") * 100 + 0.5).cast("int")
    written = (
        F.when((hundredths == 0) & (F.col("flag") == "N"), F.lit("?"))
        .when((hundredths == 0) & (F.col("flag") == "A"), F.lit("inf"))
        .otherwise(F.concat(hundredths.cast("string"), F.lit("e-2")))
    )
    return lines(spark, folder, heavy=True).withColumn("tax", written)


SQL_SCORING = [
    LINES,
    """raw AS (SELECT id, flag, tax AS number, quantity, price, discount,
       CASE WHEN round(tax * 100) = 0 AND flag = 'N' THEN '?' WHEN round(tax * 100) = 0 AND flag = 'A' THEN 'inf'
            ELSE CAST(CAST(round(tax * 100) AS INTEGER) AS VARCHAR) || 'e-2' END AS written FROM lines)""",
    "coerced AS (SELECT id, flag, number, quantity, price, discount, TRY_CAST(written AS DOUBLE) AS tax FROM raw)",
    "clean AS (SELECT * FROM coerced WHERE isfinite(tax))",
    "training AS (SELECT * FROM clean WHERE flag = 'R')",
    "known AS (SELECT id FROM raw WHERE flag = 'R' UNION SELECT id FROM raw WHERE flag = 'A' AND number >= CAST(0.08 AS DOUBLE))",
    "scaled_training AS (SELECT id, " + ", ".join(f"{sql_scaled(name, 'training')} AS {name}" for name in LINE_FEATURES) + " FROM training)",
    "scaled_catalogue AS (SELECT id, "
    + ", ".join(f"{sql_scaled(name, 'training')} AS {name}" for name in LINE_FEATURES)
    + " FROM clean WHERE id NOT IN (SELECT id FROM known))",
    sql_reconstruction("scaled_training", "training_errors"),
    sql_reconstruction("scaled_catalogue", "errors"),
    "cut AS (SELECT quantile_cont(filter_score, 0.95) AS threshold FROM training_errors)",
    f"scored AS (SELECT id, {SQL_GIVEN_SCORES}, filter_score, filter_score > threshold AS is_anomaly FROM errors, cut)",
    SQL_ROUTED,
]


@query("score_catalogue", with_parts(SQL_SCORING, SQL_VERDICT))
def score_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Exclude known ids, clean, scale, filter, route: one verdict row per source.

    The models are given ones (a projection and three logistic scorers over the scaled features), so that SQL can check
    every row.
    """
    catalogue = raw_catalogue(spark, folder)
    # Read by the scale and by every pass of the percentile, so the coercion is paid once.
    training = materialise(clean_features(catalogue.filter("flag = 'R'"), LINE_FEATURES).select(*LINE_FEATURES))
    scaler = fit_minmax(training, LINE_FEATURES)
    threshold = fit_threshold(GIVEN.score(scaler.transform(training)))
    source = lines(spark, folder)
    known = [
        (source.filter("flag = 'R'").select("id"), "id"),
        (source.filter((F.col("flag") == "A") & (F.col("tax") >= 0.08)).select("id"), "id"),
    ]
    rows = clean_features(exclude_known(catalogue.select("id", *LINE_FEATURES), known, "id"), LINE_FEATURES)
    scored = GIVEN.score(scaler.transform(rows)).withColumns(given_scores()).withColumn("is_anomaly", above(threshold))
    return verdicts(route(scored), "id", FLAGS)


# --- fitted filters ------------------------------------------------------------------------------


@query("isolation_score")
def isolation_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = scaled_lines(spark, folder)
    _, scored = fit_score_isolation(rows, LINE_FEATURES, ["id"], "id")
    return scored.select("id", "filter_score", strange().alias("is_anomaly"))


def scaled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    return fit_minmax(rows, VECTOR_FEATURES).transform(rows)


@query("pca_recon")
def pca_recon(spark: SparkSession, folder: str) -> DataFrame:
    rows = scaled_vectors(spark, folder)
    scored = fit_linear(rows, VECTOR_FEATURES).score(rows)
    return scored.select("id", "filter_score", above(fit_threshold(scored)).alias("is_anomaly"))


@query("dense_recon")
def dense_recon(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialise_evenly(scaled_vectors(spark, folder).select("id", *VECTOR_FEATURES))
    scored = fit_dense(rows, VECTOR_FEATURES, epochs=20).score(rows)
    return scored.select("id", "filter_score", above(fit_threshold(scored)).alias("is_anomaly"))


# --- fitted classifiers --------------------------------------------------------------------------

# Smaller than the defaults, which suit millions of rows.
TRIAL = TrainConfig(
    name="trial",
    isolation_trees=100,
    cascade=CascadeConfig(gate_trees=30, gate_depth=6, specialist_views=16, generalist_rounds=10, generalist_depth=4),
)


def frozen_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled catalogue written once: training and scoring read it some ten times, and each time would count the lines again."""
    return materialise(orders(spark, folder).select("id", "state", "label", *ORDER_FEATURES))


def trial_system(rows: DataFrame) -> Trained:
    labelled = rows.select("id", "label", *ORDER_FEATURES)
    unfinished = rows.filter("state = 'P'").select("id", *ORDER_FEATURES)
    return train(labelled, unfinished, ORDER_FEATURES, "label", "id", TRIAL)


@query("cascade_fit_score")
def cascade_fit_score(spark: SparkSession, folder: str) -> DataFrame:
    """Train the whole system on the labelled table, then score that table's rows."""
    rows = frozen_orders(spark, folder)
    return score(rows, trial_system(rows).bundle, "id")


@query("training_reports")
def training_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The per-class reports of a training run, one after the other."""
    reports = trial_system(frozen_orders(spark, folder)).reports
    made = [reports[name].withColumn("report", F.lit(name)) for name in ("final", "gate", "specialist", "generalist")]
    result = made[0]
    for other in made[1:]:
        result = result.unionByName(other)
    return result


@query("bundle_roundtrip")
def bundle_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Save the system, load it again, and write its texts for every order."""
    place = scratch(spark, "bundle")
    rows = frozen_orders(spark, folder)
    save_bundle(spark, trial_system(rows).bundle, place)
    return messages(rows, load_bundle(spark, place, TRIAL.name), "id")


@query("stream_score")
def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    """The orders arrive as CSV files and are scored by a bounded stream; ids on a list are skipped."""
    rows = frozen_orders(spark, folder)
    system = trial_system(rows)
    arriving = rows.select("id", *ORDER_FEATURES)
    incoming, outgoing = scratch(spark, "incoming"), scratch(spark, "verdicts")
    arriving.repartition(4).write.option("header", True).csv(incoming)
    known = [(rows.filter("state = 'P'").select("id"), "id")]
    source = stream_catalogue(spark, incoming, arriving.schema)
    score_stream(source, system.bundle, outgoing, scratch(spark, "progress"), "id", known).awaitTermination()
    return spark.read.parquet(outgoing)


@query("multiclass_fit")
def multiclass_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Both kinds of classifier over ten classes, with their reports."""
    rows = scaled_vectors(spark, folder)
    reports = []
    for kind, trees in (("rf", 30), ("xgb", 5)):
        model = train_classifier(rows, VECTOR_FEATURES, "code", kind, trees=trees, depth=5)
        made = model.classify(with_vector(rows, VECTOR_FEATURES), "predicted", "confidence")
        reports.append(classification_report(made, "code", "predicted").withColumn("kind", F.lit(kind)))
    return reports[0].unionByName(reports[1])


@query("feature_importance")
def feature_importance_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = orders(spark, folder)
    return feature_importance(rows.select("o_orderkey", "id", "state", "label", *ORDER_FEATURES), "label", "o_orderkey", trees=20, depth=5)
