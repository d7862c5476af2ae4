"""Queries over samples, splits, weights, reports and routing of rows whose scores are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from raresift.constants import FILTER_ISOLATION, FILTER_RECONSTRUCTION, RARE_CODES
from raresift.functions.keyed import uniform
from raresift.operators.cascade import confirmed, route, suspected, verdict_message, verdicts
from raresift.operators.diagnosis import contaminant_flow, gate_diagnostics, generalist_diagnostics, specialist_diagnostics
from raresift.operators.encoding import LabelCodes, fit_labels, merged_code
from raresift.operators.metrics import (
    choose_filter,
    classification_report,
    confusion_matrix,
    evaluate_predictions,
    filter_rates,
    sweep_scores,
    threshold_sweep,
    with_balanced_weight,
)
from raresift.operators.sampling import (
    augmented_specialist_sample,
    balanced_bootstrap,
    cap_rows,
    gaussian_augment,
    holdout,
    shard_of,
    specialist_sample,
    stratified_split,
    uniform_noise_like,
)
from raresift.operators.scaling import fit_minmax
from raresift.plans.inputs import (
    LINES,
    LINE_FEATURES,
    SQL_SCORES,
    lines,
    made_scores,
    sql_uniform,
    table,
)
from raresift.plans.queries_tables import SQL_CODED, coded_orders, scratch, sql_scaled
from raresift.plans.registry import query, round_all, sql_rounded, with_parts
from raresift.sources.tables import read_verdicts, write_verdicts

ANOMALY_CUT = 0.9

# --- splits and samples --------------------------------------------------------------------------

SQL_QUOTAS = """class_rows AS (SELECT label, count(*) AS n FROM coded GROUP BY 1),
wanted AS (SELECT CAST(ceil(round(0.2 * sum(n), 9)) AS BIGINT) AS w, CAST(sum(n) AS BIGINT) AS total FROM class_rows),
shares AS (SELECT label, n * w // total AS base, n * w % total AS rest, w FROM class_rows, wanted),
quotas AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= w - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id)) AS place FROM coded)"""


@query("stratified_split", with_parts([SQL_CODED, SQL_QUOTAS], "SELECT id, label, place <= quota AS is_test FROM placed JOIN quotas USING (label)"))
def stratified_split_query(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_split(coded_orders(spark, folder).select("id", "label"), "label", "id")


@query("holdout_split", with_parts([SQL_CODED], f"SELECT id, {sql_uniform('holdout')} < 0.1 AS is_validation FROM coded"))
def holdout_split(spark: SparkSession, folder: str) -> DataFrame:
    return holdout(coded_orders(spark, folder).select("id"), "id")


@query("cap_sample", with_parts([LINES], "SELECT id, quantity FROM lines ORDER BY md5('42|' || id) LIMIT 10000"))
def cap_sample(spark: SparkSession, folder: str) -> DataFrame:
    return cap_rows(lines(spark, folder, heavy=True).select("id", "quantity"), "id")


SQL_BOUNDED = """sided AS (SELECT id, code, code IN (2, 3, 4) AS rare, row_number() OVER (PARTITION BY code IN (2, 3, 4) ORDER BY md5('42|' || id)) AS place FROM coded),
sizes AS (SELECT count(*) FILTER (rare) AS r, count(*) FILTER (NOT rare) AS c FROM sided),
limits AS (SELECT least(r, 924) AS rare_limit, least(c, CASE WHEN r > 924 THEN 100 ELSE 1024 - r END) AS common_limit FROM sizes)"""


@query(
    "bounded_sample",
    with_parts(
        [SQL_CODED, SQL_BOUNDED],
        "SELECT id, CASE WHEN rare THEN 2 ELSE 99 END AS spec_code FROM sided, limits WHERE place <= CASE WHEN rare THEN rare_limit ELSE common_limit END",
    ),
)
def bounded_sample(spark: SparkSession, folder: str) -> DataFrame:
    return specialist_sample(coded_orders(spark, folder), "code", "id").select("id", "spec_code")


BAGS = 3


@query(
    "balanced_bootstrap",
    with_parts(
        [
            SQL_CODED,
            "class_rows AS (SELECT label, count(*) AS n FROM coded GROUP BY 1)",
            "placed AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id)) - 1 AS place FROM coded)",
            "smallest AS (SELECT min(n) AS m FROM class_rows)",
            f"numbers AS (SELECT unnest(range({BAGS} * (SELECT m FROM smallest))) AS i)",
            "draws AS (SELECT CAST(i // m AS INTEGER) AS bag, i % m AS draw, label, n FROM numbers, smallest, class_rows)",
            "picks AS (SELECT bag, draw, label, CAST(('0x' || substr(md5('42|' || bag || '|' || label || '|' || draw), 1, 15)) AS BIGINT) % n AS place FROM draws)",
        ],
        "SELECT bag, draw, label, id FROM picks JOIN placed USING (label, place)",
    ),
)
def balanced_bootstrap_query(spark: SparkSession, folder: str) -> DataFrame:
    return balanced_bootstrap(coded_orders(spark, folder).select("id", "label"), "label", "id", BAGS)


def scaled_lines(spark: SparkSession, folder: str, *also: str) -> DataFrame:
    rows = lines(spark, folder, heavy=True).select("id", *also, *LINE_FEATURES)
    return fit_minmax(rows, LINE_FEATURES).transform(rows)


SQL_SCALED_LINES = (
    LINES
    + ",\nscaled AS (SELECT id, flag, status, "
    + ", ".join(f"{sql_scaled(name, 'lines')} AS {name}" for name in LINE_FEATURES)
    + " FROM lines)"
)


def sql_noisy(name: str, place: int, scale: float) -> str:
    ids = f"id || '|' || copy || '|{place}'"
    first = f"(CAST(CAST(('0x' || substr(md5('42|' || {ids}), 1, 8)) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)"
    normal = f"sqrt(CAST(-2 AS DOUBLE) * ln({first})) * cos(CAST(2 AS DOUBLE) * pi() * {sql_uniform('42', ids, 1)})"
    return f"CASE WHEN copy = 0 THEN {name} ELSE {name} + {normal} * (sd_{name} * CAST({scale} AS DOUBLE)) END"


SQL_SPREAD = "(SELECT " + ", ".join(f"CASE WHEN stddev_pop({name}) = 0 THEN 1 ELSE stddev_pop({name}) END AS sd_{name}" for name in LINE_FEATURES) + " FROM {source})"


@query(
    "gaussian_augment",
    with_parts(
        [SQL_SCALED_LINES, f"spread AS {SQL_SPREAD.format(source='scaled')}", "copies AS (SELECT unnest([0, 1]) AS copy)"],
        "SELECT id, copy, "
        + ", ".join(f"{sql_rounded(sql_noisy(name, place, 0.02))} AS {name}" for place, name in enumerate(LINE_FEATURES))
        + " FROM scaled, copies, spread",
    ),
)
def gaussian_augment_query(spark: SparkSession, folder: str) -> DataFrame:
    """The target is set one above the table's size, so that every row of it gets a copy."""
    rows = scaled_lines(spark, folder)
    return round_all(gaussian_augment(rows, LINE_FEATURES, "id", target_rows=rows.count() + 1), LINE_FEATURES)


@query(
    "augmented_sample",
    with_parts(
        [
            SQL_SCALED_LINES,
            "sided AS (SELECT *, flag = 'R' AS rare, row_number() OVER (PARTITION BY flag = 'R' ORDER BY md5('42|' || id)) AS place FROM scaled)",
        ],
        "SELECT id, 0 AS copy, CASE WHEN rare THEN 2 ELSE 99 END AS spec_code FROM sided WHERE rare OR place <= 500",
    ),
)
def augmented_sample(spark: SparkSession, folder: str) -> DataFrame:
    """More rare rows than the target, so none is copied; the common side is cut to its fixed size."""
    rows = fit_labels(lines(spark, folder), "flag").encode(scaled_lines(spark, folder, "flag"), "flag", "code")
    return augmented_specialist_sample(rows, LINE_FEATURES, "code", "id", rare=(2,)).select("id", "copy", "spec_code")


def sql_noise(place: int) -> str:
    draw = sql_uniform("42", f"id || '|{place}'")
    return f"CAST(-0.2 AS DOUBLE) + {draw} * (CAST(1.2 AS DOUBLE) - CAST(-0.2 AS DOUBLE))"


@query(
    "uniform_noise",
    with_parts(
        [LINES],
        "SELECT id, "
        + ", ".join(f"{sql_rounded(sql_noise(place))} AS {name}" for place, name in enumerate(LINE_FEATURES))
        + " FROM lines",
    ),
)
def uniform_noise_query(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(uniform_noise_like(lines(spark, folder, heavy=True), LINE_FEATURES, "id"), LINE_FEATURES)


@query(
    "shard_assign",
    with_parts([LINES], "SELECT id, CAST(CAST(('0x' || substr(md5('shard|' || id), 1, 8)) AS BIGINT) % 4 AS INTEGER) AS shard FROM lines"),
)
def shard_assign(spark: SparkSession, folder: str) -> DataFrame:
    return shard_of(lines(spark, folder).select("id"), "id", 4)


# --- weights and reports -------------------------------------------------------------------------


@query(
    "balanced_weights",
    with_parts(
        [LINES, "class_rows AS (SELECT flag, count(*) AS n FROM lines GROUP BY 1)"],
        f"SELECT id, flag, {sql_rounded('(SELECT sum(n) FROM class_rows) / CAST((SELECT count(*) FROM class_rows) * n AS DOUBLE)')} AS weight FROM lines JOIN class_rows USING (flag)",
    ),
)
def balanced_weights(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(with_balanced_weight(lines(spark, folder).select("id", "flag"), "flag"), ["weight"])


def judged(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select("doc_id", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("predicted"))


JUDGED = "judged AS (SELECT quality AS truth, 1 - toxic AS predicted FROM labels)"


@query(
    "confusion",
    with_parts(
        [JUDGED, "axis AS (SELECT truth AS label FROM judged UNION SELECT predicted FROM judged)"],
        """SELECT a.label AS truth, b.label AS predicted, (SELECT count(*) FROM judged WHERE truth = a.label AND predicted = b.label) AS rows
        FROM axis a, axis b""",
    ),
)
def confusion_query(spark: SparkSession, folder: str) -> DataFrame:
    return confusion_matrix(judged(spark, folder), "truth", "predicted")


REPORT_COLUMNS = ["precision", "recall", "f1"]


def sql_report(source: str) -> list[str]:
    """Parts that report on ``source(truth, predicted)``; the result is ``report``."""
    def ratio(part: str, whole: str) -> str:
        return f"CASE WHEN {whole} = 0 THEN CAST(0 AS DOUBLE) ELSE {part} / CAST({whole} AS DOUBLE) END"

    return [
        f"sides AS (SELECT CAST(truth AS VARCHAR) AS label, 1 AS s, 0 AS c, CASE WHEN truth = predicted THEN 1 ELSE 0 END AS h FROM {source} "
        f"UNION ALL SELECT CAST(predicted AS VARCHAR), 0, 1, 0 FROM {source})",
        "sums AS (SELECT label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(c) AS BIGINT) AS claimed, CAST(sum(h) AS BIGINT) AS hits FROM sides GROUP BY 1)",
        f"per_class AS (SELECT *, {ratio('hits', 'claimed')} AS precision, {ratio('hits', 'support')} AS recall, "
        f"{ratio('2 * hits', '(claimed + support)')} AS f1 FROM sums)",
        "report AS (SELECT label, precision, recall, f1, support FROM per_class "
        "UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits) / CAST(sum(support) AS DOUBLE), CAST(sum(support) AS BIGINT) FROM per_class HAVING count(*) > 0 "
        "UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per_class HAVING count(*) > 0 "
        "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
        "sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per_class HAVING count(*) > 0)",
    ]


SQL_REPORT_ROWS = "SELECT label, " + ", ".join(f"{sql_rounded(name)} AS {name}" for name in REPORT_COLUMNS) + ", support FROM report"


@query("classification_report", with_parts([JUDGED, *sql_report("judged")], SQL_REPORT_ROWS))
def classification_report_query(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(classification_report(judged(spark, folder), "truth", "predicted"), REPORT_COLUMNS)


SQL_JUDGED_LINES = (
    SQL_SCALED_LINES
    + f", judged AS (SELECT flag AS truth, CASE WHEN {sql_uniform('guess')} < 0.5 THEN flag WHEN {sql_uniform('guess')} < 0.8 THEN 'N' ELSE 'A' END AS predicted FROM scaled)"
)


@query("evaluate_predictions", with_parts([SQL_JUDGED_LINES, *sql_report("judged")], SQL_REPORT_ROWS))
def evaluate_query(spark: SparkSession, folder: str) -> DataFrame:
    """Codes are decoded before the report."""
    rows = lines(spark, folder).select("id", "flag")
    labels = fit_labels(rows, "flag")
    draw = uniform("guess", F.col("id"))
    coded = labels.encode(rows, "flag", "truth").withColumn(
        "predicted", F.when(draw < 0.5, F.col("truth")).when(draw < 0.8, F.lit(1)).otherwise(F.lit(0))
    )
    report, _ = evaluate_predictions(coded, "truth", "predicted", labels)
    return round_all(report, REPORT_COLUMNS)


# --- filters -------------------------------------------------------------------------------------


def flagged_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).select("id", "status", "quantity", "discount")
    return rows.select(
        "status",
        (F.col("quantity") > 48).alias("by_isolation"),
        ((F.col("discount") >= 0.1) & (F.col("quantity") > 25)).alias("by_error"),
    )


SQL_RATES = [
    LINES,
    "flagged AS (SELECT status, quantity > 48 AS i, discount >= CAST(0.1 AS DOUBLE) AND quantity > 25 AS e FROM lines)",
    "rates AS ("
    + " UNION ALL ".join(
        f"SELECT '{kind}' AS filter, avg(CASE WHEN status = 'O' THEN CASE WHEN {flag} THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END END) AS valid_accepted, "
        f"avg(CASE WHEN status = 'F' THEN CASE WHEN {flag} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END) AS noise_rejected FROM flagged"
        for kind, flag in ((FILTER_ISOLATION, "i"), (FILTER_RECONSTRUCTION, "e"))
    )
    + ")",
]


def made_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = flagged_lines(spark, folder)
    return filter_rates(
        rows.filter("status = 'O'"),
        rows.filter("status = 'F'"),
        {FILTER_ISOLATION: "by_isolation", FILTER_RECONSTRUCTION: "by_error"},
    )


@query(
    "filter_rates",
    with_parts(SQL_RATES, f"SELECT filter, {sql_rounded('valid_accepted')} AS valid_accepted, {sql_rounded('noise_rejected')} AS noise_rejected FROM rates"),
)
def filter_rates_query(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(made_rates(spark, folder), ["valid_accepted", "noise_rejected"])


@query(
    "filter_choice",
    with_parts(
        SQL_RATES,
        f"""SELECT filter, {sql_rounded('noise_rejected - CASE WHEN valid_accepted > 0.95 THEN 0 ELSE 0.5 END')} AS score FROM rates
        ORDER BY noise_rejected - CASE WHEN valid_accepted > 0.95 THEN 0 ELSE 0.5 END DESC, filter LIMIT 1""",
    ),
)
def filter_choice(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(choose_filter(made_rates(spark, folder)), ["score"])


# --- routing -------------------------------------------------------------------------------------


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder, heavy=True).select("id", "flag").withColumns(made_scores())
    truth = F.when(F.col("flag") == "A", 0).when(F.col("flag") == "N", 1).otherwise(2)
    return rows.withColumns({"is_anomaly": F.col("filter_score") > ANOMALY_CUT, "code": truth})


SQL_SCORED = [
    LINES,
    f"""drawn AS (SELECT id, flag, {SQL_SCORES} FROM lines)""",
    f"""scored AS (SELECT *, filter_score > CAST({ANOMALY_CUT} AS DOUBLE) AS is_anomaly,
         CASE WHEN flag = 'A' THEN 0 WHEN flag = 'N' THEN 1 ELSE 2 END AS code FROM drawn)""",
]
SQL_ROUTED = """routed AS (SELECT *,
  CASE WHEN is_anomaly THEN 'Filter' WHEN p_rare < CAST(0.05 AS DOUBLE) THEN 'Direct_Generalist'
       WHEN spec_label = 2 AND spec_conf >= CAST(0.9 AS DOUBLE) THEN 'Confirmed_Rare' ELSE 'Rejected_by_Spec' END AS stage,
  CASE WHEN is_anomaly THEN NULL WHEN p_rare >= CAST(0.05 AS DOUBLE) AND spec_label = 2 AND spec_conf >= CAST(0.9 AS DOUBLE) THEN 2 ELSE gen_label END AS pred_code,
  CASE WHEN is_anomaly THEN CAST(0 AS DOUBLE) WHEN p_rare >= CAST(0.05 AS DOUBLE) AND spec_label = 2 AND spec_conf >= CAST(0.9 AS DOUBLE) THEN spec_conf ELSE gen_conf END AS confidence
  FROM scored)"""
SQL_VERDICT = f"""SELECT id, CASE WHEN stage = 'Filter' THEN 'ANOMALY' WHEN confidence >= 0.5 THEN 'OK' ELSE 'UNCERTAIN' END AS status,
  CASE WHEN stage = 'Filter' THEN 'None' WHEN pred_code = 0 THEN 'A' WHEN pred_code = 1 THEN 'N' ELSE 'R' END AS pred_label,
  {sql_rounded('confidence', 4)} AS confidence, stage, {sql_rounded('filter_score')} AS filter_score FROM routed"""

FLAGS = LabelCodes(("A", "N", "R"))


@query("route", with_parts([*SQL_SCORED, SQL_ROUTED], f"SELECT id, pred_code, {sql_rounded('confidence')} AS confidence, stage FROM routed"))
def route_query(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(route(scored_lines(spark, folder)).select("id", "pred_code", "confidence", "stage"), ["confidence"])


@query("verdict", with_parts([*SQL_SCORED, SQL_ROUTED], SQL_VERDICT))
def verdict_query(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(route(scored_lines(spark, folder)), "id", FLAGS)


@query("verdict_files", with_parts([*SQL_SCORED, SQL_ROUTED], SQL_VERDICT))
def verdict_files(spark: SparkSession, folder: str) -> DataFrame:
    """Written as CSV in four shards and read back as one table."""
    path = scratch(spark, "verdicts.csv")
    write_verdicts(verdict_query(spark, folder), path, "csv", shards=4)
    return read_verdicts(spark, path, "csv")


@query(
    "verdict_message",
    with_parts(
        [*SQL_SCORED, SQL_ROUTED],
        """SELECT id, CASE WHEN stage = 'Filter' THEN 'SCONOSCIUTO (Filtro)'
          ELSE CASE stage WHEN 'Confirmed_Rare' THEN '💎 RARA CONFERMATA: ' WHEN 'Rejected_by_Spec' THEN '⚠️ SOSPETTO (Scartato da Specialist): ' ELSE '' END
          || printf('Classe %s (Conf: %.2f)', CASE WHEN pred_code = 0 THEN 'A' WHEN pred_code = 1 THEN 'N' ELSE 'R' END, confidence) END AS message FROM routed""",
    ),
)
def verdict_message_query(spark: SparkSession, folder: str) -> DataFrame:
    return route(scored_lines(spark, folder)).select("id", verdict_message(FLAGS).alias("message"))


#: An even grid of trial thresholds.
SWEEP = tuple(step / 20 for step in range(8, 20))


@query(
    "threshold_sweep",
    with_parts(
        [
            *SQL_SCORED,
            f"steps AS (SELECT unnest([{', '.join(map(str, SWEEP))}]::DOUBLE[]) AS threshold, unnest(range({len(SWEEP)})) AS place)",
            "counted AS (SELECT CAST(place AS INTEGER) AS place, threshold, count(*) FILTER (code = 2 AND hit) AS tp, count(*) FILTER (code <> 2 AND hit) AS fp, count(*) FILTER (code = 2 AND NOT hit) AS fn "
            "FROM (SELECT *, p_rare >= CAST(0.05 AS DOUBLE) AND spec_label = 2 AND spec_conf >= threshold AS hit FROM scored, steps) GROUP BY 1, 2)",
        ],
        f"""SELECT place, threshold, tp, fp, fn, {sql_rounded('tp / CAST(greatest(tp + fp, 1) AS DOUBLE)')} AS precision,
          {sql_rounded('tp / CAST(greatest(tp + fn, 1) AS DOUBLE)')} AS recall,
          {sql_rounded('2 * tp / CAST(greatest(2 * tp + fp + fn, 1) AS DOUBLE)')} AS f1 FROM counted""",
    ),
)
def threshold_sweep_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_lines(spark, folder)
    swept = threshold_sweep(rows, F.col("code") == 2, lambda value: suspected() & confirmed(value), SWEEP)
    return round_all(swept, REPORT_COLUMNS)


@query(
    "best_threshold",
    with_parts(
        [
            *SQL_SCORED,
            "able AS (SELECT code = 2 AS truth, spec_conf FROM scored WHERE p_rare >= CAST(0.05 AS DOUBLE) AND spec_label = 2)",
            "counted AS (SELECT spec_conf AS threshold, count(*) FILTER (truth) AS rare, count(*) FILTER (NOT truth) AS common FROM able GROUP BY spec_conf)",
            "summed AS (SELECT threshold, sum(rare) OVER (ORDER BY threshold DESC) AS tp, sum(common) OVER (ORDER BY threshold DESC) AS fp, (SELECT count(*) FROM scored WHERE code = 2) AS rare FROM counted)",
            "rated AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(rare - tp AS BIGINT) AS fn, 2 * tp / CAST(2 * tp + fp + rare - tp AS DOUBLE) AS f1 FROM summed)",
        ],
        f"SELECT {sql_rounded('threshold')} AS threshold, tp, fp, fn, {sql_rounded('f1')} AS f1 FROM rated ORDER BY rated.f1 DESC, rated.threshold LIMIT 1",
    ),
)
def best_threshold_query(spark: SparkSession, folder: str) -> DataFrame:
    """The specialist threshold of the best F1 among all observed scores."""
    able = suspected() & (F.col("spec_label") == 2)
    swept = sweep_scores(scored_lines(spark, folder), F.col("code") == 2, able, "spec_conf")
    best = swept.orderBy(F.desc("f1"), "threshold").limit(1)
    return round_all(best.select("threshold", "tp", "fp", "fn", "f1"), ["threshold", "f1"])


SQL_BINARY = "count(*) FILTER (NOT truth AND NOT predicted) AS tn, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn, count(*) FILTER (truth AND predicted) AS tp"
SQL_GATE = [*SQL_SCORED, "judged AS (SELECT code = 2 AS truth, p_rare >= CAST(0.05 AS DOUBLE) AS predicted FROM scored)"]
SQL_SPECIALIST = [
    *SQL_SCORED,
    "judged AS (SELECT code = 2 AS truth, spec_label = 2 AND spec_conf >= CAST(0.9 AS DOUBLE) AS predicted FROM scored WHERE p_rare >= CAST(0.05 AS DOUBLE))",
]


@query("gate_report", with_parts([*SQL_GATE, *sql_report("judged")], SQL_REPORT_ROWS))
def gate_report(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(gate_diagnostics(scored_lines(spark, folder), "code", RARE_CODES)[0], REPORT_COLUMNS)


@query("gate_counts", with_parts(SQL_GATE, f"SELECT {SQL_BINARY} FROM judged"))
def gate_counts(spark: SparkSession, folder: str) -> DataFrame:
    return gate_diagnostics(scored_lines(spark, folder), "code", RARE_CODES)[1]


@query("specialist_report", with_parts([*SQL_SPECIALIST, *sql_report("judged")], SQL_REPORT_ROWS))
def specialist_report(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(specialist_diagnostics(scored_lines(spark, folder), "code", RARE_CODES)[0], REPORT_COLUMNS)


@query("specialist_counts", with_parts(SQL_SPECIALIST, f"SELECT count(*) AS analysed, count(*) FILTER (truth) AS truly_rare, {SQL_BINARY} FROM judged"))
def specialist_counts(spark: SparkSession, folder: str) -> DataFrame:
    return specialist_diagnostics(scored_lines(spark, folder), "code", RARE_CODES)[1]


@query(
    "generalist_report",
    with_parts([*SQL_SCORED, "judged AS (SELECT code AS truth, gen_label AS predicted FROM scored WHERE code <> 2)", *sql_report("judged")], SQL_REPORT_ROWS),
)
def generalist_report(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(generalist_diagnostics(scored_lines(spark, folder), "code", RARE_CODES), REPORT_COLUMNS)


@query(
    "merged_report",
    with_parts(
        [*SQL_SCORED, SQL_ROUTED, "judged AS (SELECT code AS truth, coalesce(pred_code, -1) AS predicted FROM routed)", *sql_report("judged")],
        SQL_REPORT_ROWS,
    ),
)
def merged_report(spark: SparkSession, folder: str) -> DataFrame:
    """The final report: merged truth against routed codes; a row stopped by the filter counts as class -1."""
    routed = route(scored_lines(spark, folder)).withColumns(
        {"merged": merged_code(F.col("code"), RARE_CODES), "pred_code": F.coalesce(F.col("pred_code"), F.lit(-1))}
    )
    return round_all(classification_report(routed, "merged", "pred_code"), REPORT_COLUMNS)


FLOW_STEPS = {
    "blocked": "is_anomaly",
    "passed": "NOT is_anomaly",
    "to_generalist": "NOT is_anomaly AND p_rare < CAST(0.05 AS DOUBLE)",
    "to_specialist": "NOT is_anomaly AND p_rare >= CAST(0.05 AS DOUBLE)",
    "false_alarm": "NOT is_anomaly AND p_rare >= CAST(0.05 AS DOUBLE) AND NOT (spec_label = 2 AND spec_conf >= CAST(0.9 AS DOUBLE))",
    "leaked": "NOT is_anomaly AND p_rare >= CAST(0.05 AS DOUBLE) AND spec_label = 2 AND spec_conf >= CAST(0.9 AS DOUBLE)",
}


@query(
    "contaminant_flow",
    with_parts(
        SQL_SCORED,
        " UNION ALL ".join(
            f"SELECT '{step}' AS step, count(*) FILTER ({test}) AS rows, {sql_rounded(f'count(*) FILTER ({test}) / CAST(count(*) AS DOUBLE)')} AS share FROM scored"
            for step, test in FLOW_STEPS.items()
        ),
    ),
)
def contaminant_flow_query(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(contaminant_flow(scored_lines(spark, folder)), ["share"])


@query(
    "first_rare_row",
    with_parts(SQL_SCORED, "SELECT id, code FROM scored WHERE code = 2 ORDER BY id LIMIT 1"),
)
def first_rare_row(spark: SparkSession, folder: str) -> DataFrame:
    """The demonstration row: the first one of a rare class."""
    return scored_lines(spark, folder).filter(F.col("code").isin(*RARE_CODES)).orderBy("id").select("id", "code").limit(1)
