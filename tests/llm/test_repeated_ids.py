"""Rows that share an id, and frequencies counted over ranges."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import brute_join

from raresift.llm import ngram_join


def test_join_finds_all_links_of_an_id_with_two_texts(make):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    rows, expected = [], {}
    for number in range(20):
        for side in (0, 1):
            words = [word() for _ in range(50)]
            near = 100 + 2 * number + side
            rows += [(number, " ".join(words)), (near, " ".join([*words[:-1], word()]))]
            expected[number] = expected[near] = number
    rows.append((3, rows[0][1]))  # a text of document 0 under an id with texts of its own
    for doc_id in (3, 106, 107):
        expected[doc_id] = 0
    rows += [(None, rows[0][1]), (500, None), (500, "")]
    expected[500] = 500
    ids, texts = zip(*rows, strict=True)
    found = ngram_join.join(make(list(texts), list(ids)), 5, 80).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id) for r in found} == {*expected.items(), (None, None)}


def test_frequencies_are_exact(make):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcdefghij") for _ in range(draw.randint(0, 30))) for _ in range(300)]
    docs = make(texts).repartition(7).withColumnRenamed("id", "doc_id")
    bits = 5
    chunks = ngram_join.chunked(docs.select("doc_id", "text"), 2, bits).cache()
    answers = {(r.chunk, r.part): np.frombuffer(r.levels, np.uint8) for r in ngram_join.levels(chunks).collect()}
    counts, found = Counter(), {}
    for row in chunks.filter("part IS NOT NULL").collect():
        for code, times, level in zip(
            np.frombuffer(row.codes, np.uint32), np.frombuffer(row.counts, np.uint32), answers[row.chunk, row.part], strict=True
        ):
            counts[row.part, code] += int(times)
            found.setdefault((row.part, code), set()).add(int(level))
    assert found == {key: {int(8 * np.log2(count))} for key, count in counts.items()}
    pairs = Counter()
    for text in texts:
        words = text.split()
        pairs.update(set(zip(words, words[1:], strict=False)) or ({tuple(words)} if words else set()))
    assert Counter(counts.values()) == Counter(pairs.values())
    assert chunks.filter("part IS NULL").agg(F.count("*")).first()[0] == len(texts)


def test_join_over_many_ranges_and_chunks(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(ngram_join, "RANGE_BYTES", 500)
    draw = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    base = [[draw.choice(words) for _ in range(50)] for _ in range(6)]
    texts = []
    for _ in range(150):
        copy = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(50)] = draw.choice(words)
        texts.append(" ".join(copy))
    texts.append(" ".join(draw.choice(words) for _ in range(5_000)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(make(texts), 4, 85).collect()}
    assert found == brute_join(dict(enumerate(texts)), 4, 85)
