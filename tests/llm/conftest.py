from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, with columns whose names the operators also use."""

    def build(texts, ids=None, sources=None):
        rows = [
            (ids[i] if ids else i, text, "en", sources[i] if sources else "s", None, "kept", "kept")
            for i, text in enumerate(texts)
        ]
        return spark.createDataFrame(rows, DOCS)

    return build


PROSE = [f"word{i % 7} other{i} third{i * 3} fourth{i} fifth{i} sixth{i}" for i in range(60)]
LONG = " ".join(PROSE)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, one word, a very long text, repeated rows, and letters beyond ASCII."""
    return [None, "", " \n\t ", "one", LONG, LONG, LONG + " end", "Ünïcödé 日本語 🙂\nline", "x" * 5000, "a b " * 3000]
