"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_operators import brute_join, brute_repeats

from raresift.llm import attribution, encoding, ngram_join, pages, records, substrings, toxicity
from raresift.llm.queries import tokenizer_path


# 2, 5
def test_added_tokens_are_encoded_as_by_the_library():
    from tokenizers import Tokenizer

    texts = ["end of <|endoftext|> text", "a<|startoftext|>b  <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> plain", "plain"]
    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    kind = f"<u{encoding.id_width(path)}"
    for text, coded in zip(texts, encoding.word_encoder(path)()([text.encode() for text in texts]), strict=True):
        assert np.frombuffer(coded, kind).tolist() == library.encode(text, add_special_tokens=False).ids
    path = tokenizer_path("byte_bpe_50k.json")
    library, find = Tokenizer.from_file(path), attribution.spans(path)
    for text in texts:
        pairs = library.encode(text, add_special_tokens=False).offsets
        assert list(zip(*(side.tolist() for side in find(text)), strict=True)) == pairs


# 10
@pytest.mark.parametrize(
    "page",
    [
        "<div><p>A</p><aside>Side</aside><p>B</p></div>",
        "<div><p>A</p></div><div class='ad'>Buy</div><div><p>short</p></div><form>Sign up</form><div><p>B</p></div>",
        "<div><p>A</p><ul>L</ul><p>B</p></div><ul>L</ul><div><p>C</p></div>",
        "<div><p>A</p><ul>L</ul><div><p>short</p></div><ul>L</ul><p>B</p></div>",
        "<article><p>A</p><ul>L</ul><p>short</p><ul>L</ul><p>B</p></article><p>C</p>",
        "<main><p>A</p><article><p>B</p></article></main><p>C</p>",
        "<article><p>A</p><p>B</p></article><article><p>C</p></article>",
    ],
)
def test_main_text_is_not_cut(page):
    prose = {name: " ".join([f"Sentence {name} of the text."] * size) for name, size in (("A", 9), ("B", 7), ("C", 5))}
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(4))
    whole = page.replace(">L<", f">{links}<")
    for name, text in prose.items():
        whole = whole.replace(f">{name}<", f">{text}<")
    expected = [prose["A"], *(["short"] if "short" in page else []), prose["B"]]
    lines = pages.main_text(whole).split("\n\n")
    assert [line for line in lines if not line.startswith("Link ")] == expected


def test_records_without_id(make, tmp_path):
    texts, ids = ["one", "two words", None, "three more words", "five"], [7, None, None, -3, 0]
    read = records.encode_to_records(make(texts, ids), tokenizer_path("word_bpe_49k.json"), 1, f"file://{tmp_path}/r")
    rows = sorted(read.collect(), key=lambda row: row.start)
    assert [row.doc_id for row in rows] == [None, None, -3, 0, 7]
    assert [row.n_tokens for row in rows] == [1, 3, 4, 2, 2]
    assert [row.start for row in rows] == [0, 1, 4, 8, 10]
    for row in rows:
        with open(row.shard.removeprefix("file:"), "rb") as file:
            assert records.record_at(file.read(), row.offset, row.length)[0] == row.doc_id


# 1
def test_toxicity_weighs_rare_terms(spark):
    """An insult in few toxic documents is found beside any number of words that more of them hold."""
    rows = []
    for i in range(300):
        common = " ".join("".join(chr(97 + w // 26**place % 26) for place in range(4)) for w in range(i % 2, 22_000, 2))
        toxic = i < 30
        rows.append((i, common + (" wretch" if i < 10 else "") if toxic or i < 40 else "calm words", int(toxic)))
    learnt = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4))
    assert "wretch" in learnt.weights or "wret*" in learnt.weights


# 7
@pytest.mark.parametrize("marked", [True, False])
def test_repeats_spread_hot_anchors(make, monkeypatch, marked):
    """One passage between different neighbours: its border anchors have as many classes as there are documents."""
    draw = random.Random(7)
    noise = lambda: "".join(draw.choice("abcdefgh") for _ in range(40))
    passage = "".join(draw.choice("klmnopqr") for _ in range(120))
    heads, tails = [noise() for _ in range(3)], [noise() for _ in range(3)]
    texts = [draw.choice([*heads, noise()]) + passage + draw.choice([*tails, noise()]) for _ in range(120)]
    ids = draw.sample(range(1000), len(texts))
    largest, spread = [], []
    solve, hot, marks = substrings.class_verdicts, substrings.hot_verdicts, substrings.shared_anchors

    def gathered(classes, length):
        largest.append(classes.groupBy("anchor").count().agg({"count": "max"}).first()[0] or 0)
        return solve(classes, length)

    def scattered(classes, length):
        spread.append(classes.count())
        return hot(classes, length)

    def unmarked(*args):
        shared, mixed = marks(*args)
        return shared, mixed if marked else mixed * 0

    monkeypatch.setattr(substrings, "HOT_CLASSES", 20)
    monkeypatch.setattr(substrings, "HOT_SAMPLE", 1)
    monkeypatch.setattr(substrings, "class_verdicts", gathered)
    monkeypatch.setattr(substrings, "hot_verdicts", scattered)
    monkeypatch.setattr(substrings, "shared_anchors", unmarked)
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = substrings.remove_repeats(make(texts, ids), with_text=False).collect()
    assert {r.doc_id: tuple(r[n] for n in names) for r in found} == brute_repeats(dict(zip(ids, texts, strict=True)), 50)
    assert max(largest) < 20 and max(spread) >= 20


# 8
def test_join_counts_a_pair_under_one_key(make):
    """X and Y link; some of their lists have a hub outside of both, the others one of the two as hub."""
    texts = []
    for case in range(16):
        only = [f"c{case}only{i}" for i in range(4)]
        three = [f"c{case}three{i}" for i in range(88)]
        x = [*only, *three, *(f"c{case}x{i}" for i in range(8))]
        y = [*only, *three, *(f"c{case}y{i}" for i in range(8))]
        z = [*three, *(f"common{i}" for i in range(112))]
        texts += [" ".join(words) for words in (x, y, z)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(make(texts), 1, 85).collect()}
    assert found == brute_join(dict(enumerate(texts)), 1, 85)
    assert all(found[3 * case + 1][1] == 3 * case for case in range(16))
