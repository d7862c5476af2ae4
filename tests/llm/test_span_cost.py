"""Spans of words not seen before, which are half of all words in natural text: their values and their cost."""

import sys

import numpy as np

from raresift.llm import attribution
from raresift.llm.encoding import LONGEST_KEPT, load
from raresift.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def test_spans_of_new_words_equal_the_librarys(monkeypatch):
    monkeypatch.setitem(attribution._SPANS, PATH, {})
    find = attribution.spans(PATH)
    long = " " + "q" * 300
    for text in (f"a{long} b{long}", " \x1c x\n\n \ty  z ", "日本 語 　\xa0é", " ".join(f"n{at}" for at in range(1_000))):
        pairs = np.array(load(PATH).encode(text, add_special_tokens=False).offsets).reshape(-1, 2)
        for _ in range(2):  # as new words, and as known ones
            start, end = find(text)
            assert start.tolist() == pairs[:, 0].tolist() and end.tolist() == pairs[:, 1].tolist()
    assert max(map(len, attribution._SPANS[PATH])) <= LONGEST_KEPT


def test_new_words_are_packed_together(monkeypatch):
    monkeypatch.setitem(attribution._SPANS, PATH, {})
    find = attribution.spans(PATH)
    find("warm")
    text = " ".join(f"word{at}" for at in range(4_000))
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(arg) if event == "c_call" else None)
    try:
        find(text)
    finally:
        sys.setprofile(None)
    assert len(calls) < 5 * 4_000
