"""The license scan against SQL, against each of its rules, and on odd texts."""

from __future__ import annotations

import random
import re
import re._constants as sre
import re._parser

import duckdb
from comparing import database, differences

from raresift.llm import licenses
from raresift.llm.license_rules import BASE, GATE, RULES
from raresift.llm.license_sql import license_sql
from raresift.llm.queries import QUERIES

SHOWN = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def sample(parsed, longest: bool) -> str:
    """A text that a pattern matches: first alternatives, or last ones and optional parts."""
    out = ""
    for kind, value in parsed:
        if kind is sre.LITERAL:
            out += chr(value)
        elif kind is sre.IN:
            out += chr(value[-1][1])
        elif kind is sre.SUBPATTERN:
            out += sample(value[-1], longest)
        elif kind is sre.BRANCH:
            out += sample(value[1][-1 if longest else 0], longest)
        elif kind is sre.MAX_REPEAT:
            out += sample(value[2], longest) * (value[1] if longest else value[0])
        else:
            raise AssertionError(kind)
    return out


def test_each_rule_finds_its_words(make):
    texts = [sample(re._parser.parse(rule.pattern), longest).replace("_", "any") for rule in RULES for longest in (False, True)]
    spread = ["Before, " + text.title().replace(" ", ", ") + ". After" for text in texts]
    assert all(re.search(GATE, text) for text in spread)
    rows = licenses.detect(make(spread)).select("doc_id", "labels", "detections").collect()
    assert all(set(text.split()) & set(RULES[place // 2].keywords) for place, text in enumerate(texts))
    assert len(RULES) >= 200
    for row in rows:
        rule = RULES[row.doc_id // 2]
        assert row.detections, spread[row.doc_id]
        # A rule's own words may be a part of what a stronger rule finds there.
        own = [item for item in row.detections if item.label == rule.label]
        stronger = [item for item in row.detections if RULES[item.rule].tier <= rule.tier]
        assert own or stronger, (rule, row)


def against_sql(made, docs) -> str:
    connection = duckdb.connect()
    connection.register("documents", docs.select("doc_id", "text").toArrow())
    return differences(made.select(SHOWN), connection, license_sql())


def test_whole_table_equals_sql(spark, folder):
    larger = folder.replace("sf0.001", "sf0.01")
    assert differences(QUERIES["op13_license_scan"].run(spark, larger), database(larger), QUERIES["op13_license_scan"].sql) == ""


def test_overlaps_equal_sql(make, monkeypatch):
    draw = random.Random(13)
    bits = [sample(re._parser.parse(rule.pattern), draw.random() < 0.5).replace("_", "any") for rule in RULES]
    bits += [phrase for phrase, _ in BASE] * 20 + ["the", "Ümlaut", "licensed under", "version 2", "or later", "2 0"] * 20
    texts = [" ".join(draw.choice(bits) for _ in range(draw.randint(0, 40))) for _ in range(60)]
    for block in (3, 256):
        monkeypatch.setattr(licenses, "BLOCK", block)
        docs = make(texts)
        assert against_sql(licenses.detect(docs), docs) == ""


def test_odd_texts(make, odd_texts):
    texts = [*odd_texts, "MIT LICENSE", "mit license\0mit license", "mit ÜBER license", "Kelvin KMIT License", "mit.license " * 3_000]
    docs = make(texts + texts, ids=[None, *range(2 * len(texts) - 1)])
    made = licenses.detect(docs)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", *licenses.FOUND]
    assert against_sql(made, docs) == ""
    row = made.filter("n_base = 3000").first()
    assert (row.first_word, row.last_word, row.labels) == (0, 5_998, "mit")
    assert licenses.detect(make([])).count() == 0


def test_containment_is_by_tier(make):
    row = licenses.detect(make(["Licensed under the Apache License, Version 2.0. See LICENSE for details."])).first()
    assert [(item.first_word, item.last_word, item.label) for item in row.detections] == [(0, 7, "apache-2.0"), (8, 11, "unknown")]
    assert row.labels == "apache,apache-2.0,unknown" and row.score == 0.95


def test_clean_prose_has_no_label(make):
    texts = ["Das ist mit ihm gut.", "It is a permission of the domain; the commons are public.", "We redistribute food in the city."]
    assert {row.labels for row in licenses.detect(make(texts)).collect()} == {""}


def test_columns_only(spark, folder):
    text = licenses.detect(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Arrow|Pandas|Exchange", text)
