"""Nodes of one template that are too far apart leave no rows in the lists they share."""

import random

import numpy as np
from pyspark.sql import functions as F

from raresift.llm import ngram_join


def _family(count: int, words: int, edits: int) -> list[tuple[int, str]]:
    made = random.Random(7)
    base = [f"w{place}" for place in range(words)]
    rows = []
    for doc in range(count):
        own = list(base)
        for place in made.sample(range(words), edits):
            own[place] = f"x{made.random()}"
        rows.append((doc, " ".join(own)))
    return rows


def test_places_of_prefixes_bound_what_they_share():
    made = np.random.default_rng(5)
    pool = made.integers(0, 1 << 63, 900).astype(np.uint64)
    for size in (1, 40, 300, 800):
        sets = [np.sort(made.choice(pool, size, replace=False)) for _ in range(6)]
        marks = ngram_join.prefix_marks(np.concatenate(sets), np.repeat(np.arange(6), size), 7)
        assert marks["spare"][6] == 0 and not any(marks[name][6] for name in ngram_join.PREFIX)
        for a in range(6):
            for b in range(6):
                both = sum(int(np.bitwise_count(marks[name].view(np.uint64)[[a]] & marks[name].view(np.uint64)[[b]])[0]) for name in ngram_join.PREFIX)
                assert both + min(marks["spare"][a], marks["spare"][b]) >= len(np.intersect1d(sets[a], sets[b]))


def test_far_members_of_a_template_make_no_rows(spark, monkeypatch):
    """Sixty texts of 390 words, alike by some 65 %: each list they share would show its pairs again."""
    seen = []
    real = ngram_join.candidates

    def counting(outside, others, percent):
        met = real(outside, others, percent)
        seen.append((met.count(), outside.alias("a").join(others.alias("b"), "token").filter(F.col("a.label") != F.col("b.label")).count()))
        return met

    monkeypatch.setattr(ngram_join, "candidates", counting)
    docs = spark.createDataFrame(_family(60, 390, 11), "doc_id bigint, text string")
    found = {row.doc_id: row.component_id for row in ngram_join.join(docs, size=4, percent=85).collect()}
    assert found == _linked(docs, 4, 85)
    ((rows, met),) = seen
    assert met > 5_000 and rows * 20 < met


def _linked(docs, size: int, percent: int) -> dict[int, int]:
    """Components by comparing all pairs."""
    sets = {}
    for row in docs.collect():
        words = row.text.lower().split()
        sets[row.doc_id] = {tuple(words[at : at + size]) for at in range(len(words) - size + 1)}
    label = {doc: doc for doc in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {doc: low if own == high else own for doc, own in label.items()}
    return label
