"""The license scan in SQL: every rule on every text, containment by comparing all pairs of a text's detections."""

from __future__ import annotations

from raresift.llm.license_rules import BASE, RULES
from raresift.llm.licenses import LOWER, UPPER, WORD, numbered


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{cell}'" if isinstance(cell, str) else repr(cell) for cell in row) + ")" for row in rows)


def license_sql() -> str:
    rules = [(place, rule.label, rule.tier, rule.confidence, numbered(rule.pattern)) for place, rule in enumerate(RULES)]
    keywords = [(place, word) for place, rule in enumerate(RULES) for word in rule.keywords]
    bases = [(label, numbered(phrase)) for phrase, label in BASE]
    return f"""
WITH rules(rule, label, tier, confidence, pattern) AS (VALUES {_values(rules)}),
keywords(rule, word) AS (VALUES {_values(keywords)}),
bases(label, pattern) AS (VALUES {_values(bases)}),
listed AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
placed AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM listed),
lined AS (
  SELECT row, ' ' || string_agg(word || '#' || place, ' ' ORDER BY place) AS line FROM placed
  WHERE row IN (SELECT row FROM placed WHERE word IN (SELECT word FROM keywords)) GROUP BY row),
tried AS (SELECT DISTINCT row, rule FROM placed JOIN keywords USING (word)),
matched AS (
  SELECT row, rule, label, tier, confidence, unnest(regexp_extract_all(line, pattern)) AS match
  FROM tried JOIN lined USING (row) JOIN rules USING (rule)),
detected AS (
  SELECT row, rule, label, tier, confidence, CAST(regexp_extract(match, '#(\\d+)', 1) AS BIGINT) AS first,
    CAST(regexp_extract(match, '#(\\d+)$', 1) AS BIGINT) AS last FROM matched),
outside AS (
  SELECT * FROM detected d WHERE NOT EXISTS (
    SELECT 1 FROM detected o WHERE o.row = d.row AND o.tier <= d.tier AND o.first <= d.first AND o.last >= d.last
    AND (o.first < d.first OR o.last > d.last OR o.tier < d.tier OR (o.tier = d.tier AND o.rule < d.rule)))),
kept AS (
  SELECT * FROM outside d WHERE NOT EXISTS (
    SELECT 1 FROM outside o WHERE o.row = d.row AND o.tier < d.tier AND o.first >= d.first AND o.last <= d.last)),
base AS (
  SELECT row, label, CAST(regexp_extract(match, '#(\\d+)', 1) AS BIGINT) AS first
  FROM (SELECT row, label, unnest(regexp_extract_all(line, pattern)) AS match FROM lined CROSS JOIN bases)),
by_base AS (
  SELECT row, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY row),
by_all AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT row, label FROM base UNION SELECT row, label FROM kept) GROUP BY row),
scored AS (SELECT row, max(confidence) AS score FROM kept GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM listed LEFT JOIN by_base USING (row) LEFT JOIN by_all USING (row) LEFT JOIN scored USING (row)
"""
