"""Each operator against brute force, a library or an exact round trip, on odd texts and on the small tables."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from raresift.llm import attribution, mixing, ngram_join, pages, quality, records, sentencepieces, substrings, topk, toxicity
from raresift.llm.lyndon import suffix_array
from raresift.llm.queries import QUERIES, held_out, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return {row.doc_id: row.text or "" for row in rows}


# 1
def test_toxicity_separates_held_out_rows(spark, folder):
    larger = folder.replace("sf0.001", "sf0.01")
    found = QUERIES["op1_toxicity"].run(spark, larger)
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(row.predicted == row.toxic for row in rows) >= 0.9 * len(rows)
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_folds_and_excepts():
    automaton = toxicity.build({"idiot": 3.0, "lowe*": 2.0})
    for text in ("an IDIOT!", "1d10t here", "ｉｄｉｏｔ", "idіot", "id​iot", "lowering"):
        assert toxicity.measure(text, automaton, frozenset())[0] == 1, text
    assert toxicity.measure("idiotic below 1010", automaton, frozenset())[0] == 0
    assert toxicity.measure("the village idiot", automaton, frozenset({"village idiot"}))[0] == 0


def test_toxicity_without_labels(spark, make, odd_texts):
    docs = make(odd_texts)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.learn_lexicon(toxicity.training_rows(docs, none, ~held_out()))
    scores = [row.score for row in toxicity.score(docs, lexicon).collect()]
    assert scores == [0.0] * len(odd_texts)
    assert toxicity.drop_toxic(docs, lexicon).columns == docs.columns


# 2
def test_records_round_trip(spark, make, odd_texts, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    encoder = Tokenizer.from_file(path)
    read = records.encode_to_records(make(odd_texts), path, 1, f"file://{tmp_path}/r")
    start = 0
    for row in read.orderBy("doc_id").collect():
        ids = np.array(encoder.encode(odd_texts[row.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        with open(row.shard.removeprefix("file:") if "shard" in row else "", "rb") as file:
            doc_id, found = records.record_at(file.read(), row.offset, row.length)
        assert doc_id == row.doc_id and found.tolist() == ids.tolist()


def test_records_notice_damage():
    frame = records.frame(records.record(7, 2, b"\1\0\2\0")) + b"\n"
    assert [records.unpack(payload)[1].tolist() for _, payload in records.read_frames(memoryview(frame))] == [[1, 2]]
    for place in range(len(frame)):
        broken = bytearray(frame)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            list(records.read_frames(memoryview(bytes(broken))))
    with pytest.raises(ValueError):
        list(records.read_frames(memoryview(frame[:-4])))
    assert struct.unpack_from("<Q", frame)[0] == 13


# 3
@pytest.mark.parametrize("chunk", [5, 64, 65_536])
def test_pieces_equal_the_library(spark, make, odd_texts, chunk):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    chosen = odd_texts if chunk > 5 else [text and text[:300] for text in odd_texts]
    for row in sentencepieces.encode(make(chosen), path, chunk).collect():
        text = chosen[row.doc_id] or ""
        assert np.frombuffer(row.ids, np.uint32).tolist() == library.encode(text)
        assert row.text_crc32 == zlib.crc32(library.decode(library.encode(text)).encode())


def test_pieces_composition_is_associative():
    draw = random.Random(3)
    a, b, c = ({i: {j: -draw.randint(1, 9) for j in range(3)} for i in range(3)} for _ in range(3))
    compose = sentencepieces.compose
    assert compose(compose(a, b), c) == compose(a, compose(b, c))


# 4
def brute_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {name: place % 3 + 1 for place, name in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_weight = sum(weight[n] for n in names if n not in capped)
        share = {n: left * weight[n] / open_weight for n in names if n not in capped}
        above = {n: 3.0 * sizes[n] for n in share if share[n] > 3 * sizes[n]}
        if not above:
            return capped | share
        capped |= above


def test_mix_meets_budgets(make):
    draw = random.Random(5)
    texts = [" ".join(["w"] * draw.randint(0, 40)) if draw.random() > 0.05 else None for _ in range(400)]
    sources = [draw.choice(["a"] * 9 + ["b", "c", "d", None, "Ü"]) for _ in texts]
    docs = make(texts, sources=sources)
    rows = mixing.mix(docs).collect()
    assert rows and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    sizes, taken = defaultdict(int), defaultdict(int)
    for row in rows:
        assert 0 <= row.taken <= 3 * row["size"] and row["size"] == len(WORD.findall(texts[row.doc_id] or ""))
        sizes[row.source] += row["size"]
        taken[row.source] += row.taken
    for row in rows:
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(brute_targets(sizes)[row.source])
        assert abs(taken[row.source] - row.target) <= 0.5 + 1e-6
    copies = mixing.take(mixing.mix(docs)).select("doc_id", "text").collect()
    assert sum(len(WORD.findall(row.text)) for row in copies) == sum(taken.values())


# 5
@pytest.mark.parametrize("rule", attribution.RULES)
def test_token_counts_add_up(spark, make, odd_texts, rule):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    encoder = Tokenizer.from_file(path)
    texts = [*odd_texts, "a\n\n\n b\n", "x \n y"]
    found = defaultdict(list)
    for row in attribution.attribute_tokens(make(texts), path, rule).collect():
        found[row.doc_id].append(row)
    for doc_id, text in enumerate(texts):
        spans = encoder.encode(text or "", add_special_tokens=False).offsets
        rows = sorted(found[doc_id], key=lambda row: row.section)
        assert sum(row.n_tokens for row in rows) == pytest.approx(len(spans))
        if rule == "start":
            assert [row.n_tokens for row in rows] == [sum(r.start <= a < r.end for a, _ in spans) for r in rows]


# 6
def test_search_blocks_are_exact():
    draw = np.random.default_rng(2)
    for low, high, count in ((-9, 9, 300), (0, 2, 200), (-3, 0, 7), (-(2**29), 2**29, 40)):
        rows, queries = draw.integers(low, high, (count, 6)), draw.integers(low, high, (9, 6))
        ids = np.arange(count) * 3
        asked = np.arange(9) * 3
        for (best, scores), query, own in zip(topk.search_block(queries, asked, rows, ids, 5), queries, asked, strict=True):
            product = rows @ query
            order = [i for i in np.lexsort((ids, -product)) if ids[i] != own][:5]
            assert best.tolist() == ids[order].tolist() and scores.tolist() == product[order].tolist()


def test_search_leaves_out_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 2.0]), (6, [2.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = topk.top_k(vectors, F.col("vec_id") % 5 == 0, 10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 5), (0, 2, 6), (5, 1, 0), (5, 2, 6)]
    assert topk.top_k(vectors.filter("false"), F.lit(True), 10).count() == 0


# 7
def test_suffix_arrays_equal_sorting():
    draw = random.Random(1)
    for _ in range(2000):
        symbols = [draw.randint(0, draw.choice([1, 2, 5])) for _ in range(draw.randint(0, 14))]
        assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def brute_repeats(texts: dict, length: int) -> dict:
    seen: set[bytes] = set()
    result = {}
    for doc_id in sorted(texts):
        content = texts[doc_id].encode()
        windows = [content[i : i + length] for i in range(len(content) - length + 1)]
        gone = np.zeros(len(content), bool)
        for place, window in enumerate(windows):
            if window in seen:
                gone[place : place + length] = True
        seen.update(windows)
        kept = bytes(np.frombuffer(content, np.uint8)[~gone])
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        result[doc_id] = (len(content), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return result


def test_repeats_equal_brute_force(spark, folder, make, odd_texts):
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    docs = make(odd_texts)
    expected = brute_repeats({i: text or "" for i, text in enumerate(odd_texts)}, 50)
    kept = substrings.remove_repeats(docs)
    assert set(docs.columns) <= set(kept.columns)
    assert {r.doc_id: tuple(r[n] for n in names) for r in kept.collect()} == expected
    assert substrings.remove_repeats(docs.filter("false")).count() == 0
    whole = QUERIES["op7_repeated_bytes"].run(spark, folder).collect()
    assert {r.doc_id: tuple(r[n] for n in names) for r in whole} == brute_repeats(texts_of(spark, folder), 50)


def test_repeats_without_second_marks(spark, folder, monkeypatch):
    """Anchors of several classes that lack their mark are found and settled in a second turn."""
    marks, turns = substrings.shared_anchors, []

    def unmarked(*args):
        shared, mixed = marks(*args)
        assert mixed.any()
        return shared, np.zeros_like(mixed)

    def counted(*args):
        turns.append(args)
        return anchor_table(*args)

    anchor_table = substrings.anchor_table
    monkeypatch.setattr(substrings, "shared_anchors", unmarked)
    monkeypatch.setattr(substrings, "anchor_table", counted)
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    whole = QUERIES["op7_repeated_bytes"].run(spark, folder).collect()
    assert len(turns) == 1
    assert {r.doc_id: tuple(r[n] for n in names) for r in whole} == brute_repeats(texts_of(spark, folder), 50)


# 8
def brute_join(texts: dict, size: int, percent: int) -> dict:
    sets = {}
    for doc_id, text in texts.items():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets[doc_id] = grams or ({tuple(words)} if words else set())
    root = {doc_id: doc_id for doc_id in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b]) if a < b else 0
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {doc_id: (len(sets[doc_id]), find(doc_id)) for doc_id in ids}


def test_join_equals_brute_force(spark, folder, make, odd_texts):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    base = [[draw.choice(words) for _ in range(60)] for _ in range(3)]
    texts = list(odd_texts)
    for _ in range(90):
        copy = list(draw.choice(base))
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        texts.append(" ".join(copy))
    for size, percent in ((4, 85), (5, 80)):
        found = ngram_join.join(make(texts), size, percent).collect()
        expected = brute_join({i: text or "" for i, text in enumerate(texts)}, size, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert ngram_join.join(make(texts).filter("false")).count() == 0
    whole = QUERIES["op8_ngram_join"].run(spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in whole} == brute_join(texts_of(spark, folder), 4, 85)


# 9
def brute_quality(text: str) -> tuple:
    words = WORD.findall(text)
    triples = defaultdict(list)
    for i in range(len(words) - 2):
        triples[tuple(words[i : i + 3])].append(i)
    inside = {i + k for places in triples.values() if len(places) > 1 for i in places for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, repeated, len(inside), failed


def test_quality_equals_brute_force(spark, folder, make, odd_texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    texts = [*odd_texts, "same line\nsame line\n\n\nsame line", "# a * b | c\n \n \n"]
    for row in quality.quality(make(texts)).collect():
        assert tuple(row[name] for name in names) == brute_quality(texts[row.doc_id] or "")
    known = texts_of(spark, folder)
    for row in QUERIES["op9_quality_rules"].run(spark, folder).collect():
        assert tuple(row[name] for name in names) == brute_quality(known[row.doc_id])
        assert not (row.base_failed and row.kept)


# 10
def test_main_text_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site name</header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
    <div id="sidebar">Side words here</div><article><h1>Title &amp; more</h1><p>First   <b>paragraph</b>
    with &eacute;.<p>Second<br>one.<script>var t="</p>";</script><div class="ad">Buy this now</div><p>Third.</p>
    <form><input name="q">Search</form></article><section class="comments"><p>A reader says something long here.</p>
    </section><footer>&copy; owner</footer></body></html>"""
    assert pages.main_text(page) == "Title & more\n\nFirst paragraph with é.\n\nSecond one.\n\nThird."
    for empty in (None, "", "<p>", "<nav>x</nav>", "<!-- open", "<script>never closed"):
        assert pages.main_text(empty) == ""
    assert pages.main_text("plain & simple &lt;text") == "plain & simple <text"


def test_main_text_without_article_element():
    body = "".join(f"<p>Sentence number {i} of the text, long enough to count as prose.</p>" for i in range(6))
    page = f"<div class='menu'><a href='#'>One</a></div><div class='content'>{body}</div><div class='footer'>Rights</div>"
    assert pages.main_text(page).count("\n\n") == 5


# pipeline
def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "suffix_array", "mixing", "sentence_pieces"]
    kept = corpus_pipeline.without_near_copies(spark, docs, folder)
    expected = brute_join(texts_of(spark, folder), 5, 80)
    assert {row.doc_id for row in kept.collect()} == {i for i, (_, group) in expected.items() if i == group}
    assert kept.columns == docs.columns
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_every_operator_is_registered():
    names = registered.queries()
    assert {int(name[2:].split("_")[0]) for name in names if name.startswith("op") and name[2].isdigit()} == set(range(1, 14))
    assert "pipeline" in names


def test_search_agrees_with_sql(spark, folder):
    from comparing import database, differences

    query = QUERIES["op6_top_k"]
    assert differences(query.run(spark, folder), database(folder), query.sql) == ""
