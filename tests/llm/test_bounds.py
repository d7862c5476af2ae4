"""What a step leaves on disk."""

from __future__ import annotations

import glob
import os
import tempfile
import time
from urllib.parse import urlparse

from pyspark.sql import functions as F

from raresift.llm import ngram_join
from raresift.session import CLEAR_SHUFFLES, materialise, release


def test_written_tables_leave_no_shuffle_files(spark):
    place = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())

    def files():
        return set(glob.glob(f"{place}/**/blockmgr-*/*/shuffle_*", recursive=True))

    before = files()
    written = materialise(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert written.count() == 97 and spark.conf.get(CLEAR_SHUFFLES) == "false"


def test_answers_are_written_before_texts_are_shuffled(make, monkeypatch):
    written = []

    def recorded(df, *rest, whole=ngram_join.materialise, **named):
        written.append(df.columns)
        return whole(df, *rest, **named)

    monkeypatch.setattr(ngram_join, "materialise", recorded)
    found = ngram_join.join(make(["one two three four five six seven", "one two three four five six seven", "eight"]), 4, 85)
    assert sorted((row.doc_id, row.component_id) for row in found.collect()) == [(0, 0), (1, 0), (2, 2)]
    assert written.index(["chunk", "part", "levels"]) < written.index(ngram_join.NAMES)


def test_tables_that_nothing_reads_again_go(spark, make, monkeypatch):
    released = []
    monkeypatch.setattr(ngram_join, "release", lambda df: released.append(df.columns) or release(df))
    found = ngram_join.join(make(["one two three four five six seven", None, "one two three four five six seven"]), 4, 85)
    assert released == [ngram_join._names(ngram_join._CHUNKS)]
    assert sorted((row.doc_id, row.component_id) for row in found.collect()) == [(0, 0), (1, 1), (2, 0)]
    kept, gone = materialise(spark.range(5)), materialise(spark.range(7))
    files = gone.inputFiles()
    release(gone)
    assert kept.count() == 5 and files and not any(os.path.exists(urlparse(file).path) for file in files)
    assert ngram_join.join(make([]), 4, 85).count() == 0
