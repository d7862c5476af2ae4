"""Ranked search against SQL and against scoring every document, with ties, odd texts, small blocks and item groups."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from comparing import database, differences

from raresift.llm import lexical
from raresift.llm.queries import QUERIES

SQL = QUERIES["op11_lexical_search"].sql


def against_sql(made, docs, items) -> str:
    connection = duckdb.connect()
    connection.register("documents", docs.select("doc_id", "text").toArrow())
    connection.register("benchmark", items.select("item_id", "text").toArrow())
    return differences(made, connection, SQL)


def items_of(spark, texts, ids=None):
    rows = [(ids[place] if ids else place, text, "x") for place, text in enumerate(texts)]
    return spark.createDataFrame(rows, "item_id bigint, text string, score string")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables_equal_sql(spark, folder, sf):
    larger = folder.replace("sf0.001", sf)
    assert differences(QUERIES["op11_lexical_search"].run(spark, larger), database(larger), SQL) == ""


@pytest.mark.parametrize("blocks", [(7, 50, 400_000), (16_384, 1_000_000, 20)])
def test_random_texts_equal_sql(spark, make, monkeypatch, blocks):
    for name, value in zip(("BLOCK_DOCS", "BLOCK_POSTINGS", "GROUP_TERMS"), blocks, strict=True):
        monkeypatch.setattr(lexical, name, value)
    draw = random.Random(11)
    known = [f"w{int(draw.paretovariate(0.6))}" for _ in range(400)]
    texts = [draw.choice([" ", ". ", "\n"]).join(draw.choice(known) for _ in range(draw.randint(0, 60))) for _ in range(300)]
    texts += texts[:40] + [None, "", "...", "W1 w1 É1 é1"]
    docs = make(texts)
    items = items_of(spark, [" ".join(draw.choice(known) for _ in range(12)) for _ in range(15)] + ["", None, "absent", "É1 w1"])
    assert against_sql(lexical.search(docs.repartition(3), items), docs, items) == ""


def test_odd_rows(spark, make, odd_texts):
    docs = make(odd_texts)
    items = items_of(spark, ["word1 other3 a b", "end word1", "one"], [4, 4, 5])
    assert against_sql(lexical.search(docs, items), docs, items) == ""
    nameless = make(["word1", "word1", "word1 other"], ids=[None, 3, 2])
    found = [(row.rank, row.doc_id) for row in lexical.search(nameless, items_of(spark, ["word1"])).orderBy("rank").collect()]
    assert found == [(1, 3), (2, None), (3, 2)]
    for some, asked in ((make([]), items), (docs, items_of(spark, [])), (docs, items_of(spark, ["word1"], [None]))):
        assert lexical.search(some, asked).count() == 0


def test_reading_stops_early():
    """One strong list and long weak ones: the members are settled before the weak lists end."""
    draw = np.random.default_rng(5)
    count, terms = 20_000, 6
    words = draw.integers(20, 400, count)
    doc = np.concatenate([np.arange(0, 60), *[np.flatnonzero(draw.random(count) < 0.8) for _ in range(terms - 1)]])
    term = np.repeat(np.arange(terms), [60, *np.bincount(np.cumsum(np.diff(doc, prepend=0) < 0))[1:]])
    times = np.ones(len(doc), np.int64)
    impact = lexical.impacts(times, words[doc], count, int(words.sum()))
    once = lexical.impacts(np.ones(count, np.int64), words, count, int(words.sum()))
    block = lexical.make_block(terms, doc, term, impact, once)
    weights = np.array([9000, *[150] * (terms - 1)])
    scores = np.bincount(doc, weights=weights[term] * impact, minlength=count).astype(np.int64)
    best = np.lexsort((np.arange(count), -scores))[:10]
    found, exact, read, listed = lexical.search_block(block, np.arange(terms), weights, np.zeros(0, np.int64), 10)
    assert (exact == scores[found]).all() and set(best) <= set(found)
    assert listed == len(doc) and read < 0.9 * listed
    # A bound carried from elsewhere costs no more; one that nothing here reaches saves all.
    bound = int(scores[best[0]])
    assert lexical.search_block(block, np.arange(terms), weights, np.full(10, bound), 10)[2] <= read
    assert lexical.search_block(block, np.arange(terms), weights, np.zeros(0, np.int64), 10, floor=10**12)[2] == 0


def test_counted_reads(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    row = lexical.search(docs, items, with_reads=True).selectExpr("sum(read) read", "sum(listed) listed", "count(*) n").first()
    assert 0 < row.read <= row.listed and row.n == items.count()
