"""Routing of given scores, cell by cell and against a plain restatement of the rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from raresift.operators.cascade import route, verdict_message, verdicts
from raresift.operators.diagnosis import contaminant_flow, gate_diagnostics, generalist_diagnostics, specialist_diagnostics
from raresift.operators.encoding import LabelCodes
from raresift.schema import VERDICT_SCHEMA, MissingColumns

CUT = 4.709302350773351e-05
LABELS = LabelCodes(("RRab", "RRc", "RRd", "x", "y"))
SCHEMA = "id string, filter_score double, p_rare double, spec_label int, spec_conf double, gen_label int, gen_conf double"

# id, filter score, p_rare, specialist, its confidence, generalist, its confidence -> status, label, confidence, stage
CELLS = [
    ("documented-1", 3.9e-05, 0.0, 99, 1.0, 0, 1.0, "OK", "RRab", 1.0, "Direct_Generalist"),
    ("documented-2", 0.014739, 0.9, 2, 1.0, 0, 1.0, "ANOMALY", "None", 0.0, "Filter"),
    ("documented-3", 1.4e-05, 0.3, 99, 0.9, 1, 1.0, "OK", "RRc", 1.0, "Rejected_by_Spec"),
    ("documented-4", 3.8e-05, 0.6, 2, 0.948, 0, 0.7, "OK", "RRd", 0.948, "Confirmed_Rare"),
    ("at-cut", CUT, 0.0, 2, 1.0, 1, 0.6, "OK", "RRc", 0.6, "Direct_Generalist"),
    ("above-cut", 4.7093024e-05, 0.0, 2, 1.0, 1, 0.6, "ANOMALY", "None", 0.0, "Filter"),
    ("at-gate", 0.0, 0.05, 2, 0.99, 1, 0.6, "OK", "RRd", 0.99, "Confirmed_Rare"),
    ("below-gate", 0.0, 0.0499999, 2, 0.99, 1, 0.6, "OK", "RRc", 0.6, "Direct_Generalist"),
    ("at-specialist", 0.0, 0.5, 2, 0.90, 1, 0.6, "OK", "RRd", 0.9, "Confirmed_Rare"),
    ("below-specialist", 0.0, 0.5, 2, 0.8999999, 1, 0.6, "OK", "RRc", 0.6, "Rejected_by_Spec"),
    ("sure-alarm", 0.0, 0.5, 99, 0.99, 0, 0.6, "OK", "RRab", 0.6, "Rejected_by_Spec"),
    ("half", 0.0, 0.0, 99, 0.99, 0, 0.5, "OK", "RRab", 0.5, "Direct_Generalist"),
    ("below-half", 0.0, 0.0, 99, 0.99, 0, 0.49, "UNCERTAIN", "RRab", 0.49, "Direct_Generalist"),
    ("unsure-retry", 0.0, 0.5, 99, 0.99, 1, 0.2, "UNCERTAIN", "RRc", 0.2, "Rejected_by_Spec"),
]


@pytest.fixture(scope="module")
def cells(spark):
    rows = spark.createDataFrame([cell[:7] for cell in CELLS], SCHEMA)
    return rows.withColumn("is_anomaly", F.col("filter_score") > CUT)


def test_every_cell(cells):
    made = verdicts(route(cells), "id", LABELS)
    assert made.schema.names == VERDICT_SCHEMA.names
    assert [field.dataType for field in made.schema] == [field.dataType for field in VERDICT_SCHEMA]
    found = {row.id: (row.status, row.pred_label, row.confidence, row.stage) for row in made.collect()}
    assert found == {cell[0]: cell[7:] for cell in CELLS}


def test_scores_are_rounded_only_in_the_verdict(cells):
    assert verdicts(route(cells), "id").filter("id = 'documented-1'").first().filter_score == 3.9e-05
    assert route(cells).filter("id = 'at-cut'").first().filter_score == CUT


def test_without_labels_the_code_is_shown(cells):
    found = {row.id: row.pred_label for row in verdicts(route(cells), "id").collect()}
    assert found["documented-4"] == "2" and found["documented-2"] == "None"


def test_messages(cells):
    found = {row.id: row.m for row in route(cells).select("id", verdict_message(LABELS).alias("m")).collect()}
    assert found["documented-1"] == "Classe RRab (Conf: 1.00)"
    assert found["documented-2"] == "SCONOSCIUTO (Filtro)"
    assert found["documented-3"] == "⚠️ SOSPETTO (Scartato da Specialist): Classe RRc (Conf: 1.00)"
    assert found["documented-4"] == "💎 RARA CONFERMATA: Classe RRd (Conf: 0.95)"


def test_other_thresholds_and_code(cells):
    found = {row.id: (row.pred_code, row.stage) for row in route(cells, gate=0.7, threshold=0.5).collect()}
    assert found["documented-4"] == (0, "Direct_Generalist")
    assert route(cells, rare_code=99).filter("id = 'sure-alarm'").first().pred_code == 99


def test_route_needs_scores(cells):
    with pytest.raises(MissingColumns):
        route(cells.drop("p_rare"))


def _restated(row):
    if row.is_anomaly:
        return None, 0.0, "Filter"
    if row.p_rare < 0.05:
        return row.gen_label, row.gen_conf, "Direct_Generalist"
    if row.spec_label == 2 and row.spec_conf >= 0.9:
        return 2, row.spec_conf, "Confirmed_Rare"
    return row.gen_label, row.gen_conf, "Rejected_by_Spec"


@pytest.fixture(scope="module")
def drawn(spark):
    draw = random.Random(5)
    rows = [
        (str(i), draw.random(), draw.random() / 8, draw.choice([2, 99]), 0.5 + draw.random() / 2, draw.choice([0, 1]), draw.random(), draw.choice([0, 1, 2, 3]))
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, f"{SCHEMA}, code int").withColumn("is_anomaly", F.col("filter_score") > 0.9).cache()


def test_random_scores(drawn):
    for row in route(drawn).collect():
        assert (row.pred_code, row.confidence, row.stage) == _restated(row)


def test_flow_adds_up(drawn):
    steps = {row.step: row["rows"] for row in contaminant_flow(drawn).collect()}
    assert steps["blocked"] + steps["passed"] == 3000
    assert steps["to_generalist"] + steps["to_specialist"] == steps["passed"]
    assert steps["false_alarm"] + steps["leaked"] == steps["to_specialist"]
    assert steps["leaked"] == sum(_restated(row)[2] == "Confirmed_Rare" for row in drawn.collect())


def test_flow_when_all_are_blocked(drawn):
    blocked = {row.step: (row["rows"], row.share) for row in contaminant_flow(drawn.withColumn("is_anomaly", F.lit(True))).collect()}
    assert blocked["blocked"] == (3000, 1.0) and blocked["leaked"] == (0, 0.0)
    assert {row.share for row in contaminant_flow(drawn.filter("false")).collect()} == {0.0}


def test_diagnostics(drawn):
    rows = drawn.collect()
    _, gate = gate_diagnostics(drawn, "code")
    counts = gate.first()
    assert counts.tp == sum(row.code >= 2 and row.p_rare >= 0.05 for row in rows)
    assert counts.tn + counts.fp + counts.fn + counts.tp == 3000
    report, specialist = specialist_diagnostics(drawn, "code")
    counts = specialist.first()
    assert counts.analysed == sum(row.p_rare >= 0.05 for row in rows) == counts.tn + counts.fp + counts.fn + counts.tp
    assert counts.truly_rare == counts.fn + counts.tp
    assert report.filter("label = 'true'").first().support == counts.truly_rare
    accuracy = generalist_diagnostics(drawn, "code").filter("label = 'accuracy'").first().f1
    common = [row for row in rows if row.code < 2]
    assert accuracy == pytest.approx(sum(row.code == row.gen_label for row in common) / len(common))


def test_diagnostics_when_nothing_passes_the_gate(drawn):
    shut = drawn.withColumn("p_rare", F.lit(0.0))
    assert tuple(specialist_diagnostics(shut, "code")[1].first()) == (0, 0, 0, 0, 0, 0)
