"""Importance resampling against SQL, and longer runs against zlib."""

from __future__ import annotations

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from comparing import database, differences

from raresift.llm import resampling
from raresift.llm.queries import QUERIES
from raresift.llm.text import slices

SQL = QUERIES["op12_target_resampling"].sql
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHOWN = ["doc_id", "n_features", "weight", "score", "rank"]


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def against_sql(docs, target) -> str:
    connection = duckdb.connect()
    connection.register("documents", docs.select("doc_id", "text").toArrow())
    connection.register("benchmark", target.select("text").toArrow())
    return differences(resampling.resample(docs, target).select(SHOWN), connection, SQL)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables_equal_sql(spark, folder, sf):
    larger = folder.replace("sf0.001", sf)
    assert differences(QUERIES["op12_target_resampling"].run(spark, larger), database(larger), SQL) == ""


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("share", [1e-5, 0.02, 2.0])
def test_runs_are_those_of_zlib(make, monkeypatch, longest, share):
    monkeypatch.setattr(resampling, "HEAD_SHARE", share)
    draw = random.Random(12)
    texts = [" ,".join(draw.choice(["the", "OF", "é", "naïve", "x" * 100, f"t{draw.random()}"]) for _ in range(draw.randint(0, 30))) for _ in range(80)]
    head = resampling.learn_head(make(texts).select("text"), longest)
    assert (len(head.words) == 0) == (share > 1)
    found = []
    for part in slices(pa.array(texts), 500):
        for made in resampling.runs(part, longest, head):
            found += zip((made.doc + part.first).tolist(), made.crc.tolist(), strict=True)
    expected = []
    for doc, text in enumerate(texts):
        held = words(text)
        for size in range(1, longest + 1):
            expected += [(doc, zlib.crc32(" ".join(held[i : i + size]).encode())) for i in range(len(held) - size + 1)]
    assert sorted(found) == sorted(expected)


def test_crc_continues():
    data = np.frombuffer(bytes(range(256)) * 2, np.uint8)
    start, end = np.array([0, 5, 300, 7, 9]), np.array([0, 6, 512, 60, 400])
    before = np.array([zlib.crc32(b"seed")] * 5, np.uint32)
    made = resampling.crc_on(before, data, start, end)
    assert made.tolist() == [zlib.crc32(b"seed" + data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def test_odd_rows_equal_sql(spark, make, odd_texts):
    texts = [*odd_texts, *odd_texts, *[f"some words {i} " * 9 for i in range(40)]]
    docs = make(texts, ids=[None, 1, 1, *range(len(texts) - 3)])
    target = make(["some words 3", None, ""])
    assert against_sql(docs, target) == ""
    assert against_sql(docs, make([])) == ""
    assert resampling.resample(make([]), target).count() == 0
    assert resampling.drawn(make([]), target).count() == 0


def test_drawn_documents_keep_their_columns(make):
    texts = [f"some words {i} {i % 7} " * 9 for i in range(60)]
    docs, target = make(texts), make(["words 3 3 3"])
    ranked = {row.doc_id for row in resampling.resample(docs, target, percent=30).filter("rank IS NOT NULL").collect()}
    rows = resampling.drawn(docs, target, percent=30)
    assert rows.columns == docs.columns and {row.doc_id for row in rows.collect()} == ranked and len(ranked) == 18
    assert {(row.text, row.score) for row in rows.collect()} == {(texts[i], "kept") for i in ranked}
    with pytest.raises(ValueError):
        resampling.resample(docs, target, buckets=resampling.MOST_BUCKETS + 1)
