"""Toxicity by a weighted lexicon.

The lexicon is learnt from labelled documents: words, and beginnings of words, that are much more frequent in toxic
documents than in clean ones, weighted by log odds. Texts are folded (case, look-alike letters, digits and signs that
stand for letters) and matched by one Aho-Corasick automaton. Matches inside exception phrases (given, or learnt as
phrases that clean documents use) do not count. The sum of weights, as it is and relative to the length, is turned into a
score by a logistic curve fitted on the same labelled rows.

Labelled rows: at most about ``FIT_ROWS`` are used, chosen by a hash of the id; this is the only bound. Weights, counts
and the curve come from these rows, the text alone is scored. Only lexicon and curve reach the driver.

Defined cases: null and empty texts have no match and get the score of a text without matches; without any toxic
or clean training row nothing is learnt and all scores are 0; labels of unknown documents and null labels are left
out; equal rows get equal scores; further columns are not read; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from raresift.llm.text import keeps, prepare, tidy
from raresift.session import materialise

FIT_ROWS = 60_000
LEAST_DOCS = 5
LEAST_WEIGHT = 2.5
#: Log-likelihood ratio of a term's counts, against chance.
LEAST_EVIDENCE = 30.0
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.7

# Letters that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "ı": "i",
}
# Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"}

_WIDE = {code: code - 0xFEE0 for code in range(0xFF01, 0xFF5F)}  # full-width forms
_SOFT = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])  # invisible characters go
_LETTERS = str.maketrans(LOOK_ALIKES) | _WIDE | _SOFT
_SIGNS = str.maketrans(SIGNS)
_PLAIN = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[\w@$!€]+")


def fold(text: str) -> tuple[str, str]:
    """Lower case with plain letters; and the same, as long, with signs read as letters."""
    plain = text.lower().translate(_LETTERS)
    return plain, plain.translate(_SIGNS)


def _words(text: str) -> set[str]:
    """Folded words; a sign is a letter where letters stand around it or a word begins with it."""
    plain, signed = fold(text)
    found = set(_PLAIN.findall(plain))
    for match in _TOKEN.finditer(plain):
        token = match[0].rstrip("@$!€")
        if token and not token.isalpha() and any(map(str.isalpha, token)):
            found.add(signed[match.start() : match.start() + len(token)])
    return found


def terms(text: str) -> set[str]:
    """Words, and beginnings of words written with a star."""
    words = _words(text)
    return words | {f"{word[:size]}*" for word in words for size in STEMS if len(word) > size}


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = ()


def find(automaton, plain: str, signed: str) -> Iterator[tuple[int, int, float]]:
    """Start, end and weight of each match at the border of a word; the longest match at a start counts."""
    size = len(plain)
    best: dict[int, tuple[int, float]] = {}
    for last, (length, whole, weight) in automaton.iter(signed):
        start, end = last + 1 - length, last + 1
        if start and (plain[start - 1].isalnum() or plain[start - 1] == "_"):
            continue
        if whole and end < size and plain[end].isalpha():
            continue
        if start not in best or best[start][0] < end:
            best[start] = (end, weight)
    for start, (end, weight) in best.items():
        yield start, end, weight


def build(weights: dict[str, float]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term, weight in sorted(weights.items()):
        key = term.rstrip("*")
        if key in automaton and not term.endswith("*"):
            continue  # the beginning covers the word
        automaton.add_word(key, (len(key), not term.endswith("*"), weight))
    automaton.make_automaton()
    return automaton


def _neighbours(plain: str, signed: str, start: int, end: int) -> tuple[str, str]:
    """The phrase of a match's word with the word before it, and with the word after it."""
    while end < len(plain) and plain[end].isalnum():
        end += 1
    word = signed[start:end]
    before = _PLAIN.findall(plain[max(0, start - 40) : start])
    after = _PLAIN.search(plain, end, min(len(plain), end + 40))
    return (f"{before[-1]} {word}" if before else "", f"{word} {after[0]}" if after else "")


def measure(text: str, automaton, exceptions: frozenset[str]) -> tuple[int, float]:
    """Matches that count, and the sum of their weights."""
    plain, signed = fold(text)
    count, total = 0, 0.0
    for start, end, weight in find(automaton, plain, signed):
        if exceptions and not exceptions.isdisjoint(_neighbours(plain, signed, start, end)):
            continue
        count += 1
        total += weight
    return count, total


def features(total: float, length: int) -> tuple[float, float]:
    """The sum of weights, and its density over the length."""
    return math.log1p(total), math.log1p(1000.0 * total / max(length, 50))


def _value(curve: Sequence[float], total: float, length: int) -> float:
    if not curve:
        return 0.0
    strength, density = features(total, length)
    return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, curve[0] + curve[1] * strength + curve[2] * density))))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Text and label of the labelled rows to learn from. The chosen labels are bounded, so they are broadcast."""
    known = labels.filter(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = known.count()
    share = min(1.0, fit_rows / count) if count else 1.0
    picked = known.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1_000_000)) < share * 1_000_000)
    chosen = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    joined = chosen.join(F.broadcast(picked), F.col("_id") == F.col("doc_id"))
    return joined.select("doc_id", "text", "toxic")


def _count(rows: DataFrame, keys, only: str) -> DataFrame:
    """Documents that hold each key: counted in the task first, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                found.update((key, toxic.as_py()) for key in keys(text.as_py() or ""))
            if len(found) > 200_000:
                yield _counted(found)
                found.clear()
        if found:
            yield _counted(found)

    counted = rows.filter(only).select("text", "toxic").mapInArrow(tidy("toxicity", run), "key string, toxic int, n bigint")
    return counted.groupBy("key").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("toxic") == 1, F.lit(0)).otherwise(F.col("n"))).alias("clean"),
    )


def _counted(found: Counter) -> pa.RecordBatch:
    keys = list(found)
    arrays = [pa.array([k for k, _ in keys]), pa.array([t for _, t in keys], pa.int32()), pa.array(list(found.values()))]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "toxic", "n"])


def _evidence(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Twice the log-likelihood ratio of 'depends on the label' against 'does not'."""
    total = n_toxic + n_clean
    cells = ((toxic, n_toxic), (clean, n_clean), (n_toxic - toxic, n_toxic), (n_clean - clean, n_clean))
    rows = (toxic + clean, toxic + clean, total - toxic - clean, total - toxic - clean)
    return 2 * sum(seen * math.log(seen * total / (row * size)) for (seen, size), row in zip(cells, rows, strict=True) if seen)


def _passes(n_toxic: int, n_clean: int) -> Column:
    """The rules of ``choose_terms`` on counted rows, a little wider, so that rounding cannot lose a term."""
    toxic, clean, total = F.col("toxic"), F.col("clean"), n_toxic + n_clean
    weight = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
    seen = toxic + clean
    cells = ((toxic, seen, n_toxic), (clean, seen, n_clean), (n_toxic - toxic, total - seen, n_toxic), (n_clean - clean, total - seen, n_clean))
    parts = [F.when(n > 0, n * F.log(n.cast("double") * total / (row * size))).otherwise(0.0) for n, row, size in cells]
    evidence = 2 * (parts[0] + parts[1] + parts[2] + parts[3])
    return (toxic >= LEAST_DOCS) & (weight >= LEAST_WEIGHT - 1e-6) & (evidence >= LEAST_EVIDENCE - 1e-6)


def choose_terms(counts: Sequence[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the terms that mark toxic documents; a beginning replaces what it covers."""
    weights: dict[str, float] = {}
    for term, toxic, clean in counts:
        weight = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        if toxic >= LEAST_DOCS and weight >= LEAST_WEIGHT and _evidence(toxic, clean, n_toxic, n_clean) >= LEAST_EVIDENCE:
            weights[term] = weight
    pure = sorted((t for t in weights if t.endswith("*")), key=len)
    kept: dict[str, float] = {}
    for term in [*pure, *(t for t in weights if not t.endswith("*"))]:
        stem = term.rstrip("*")
        cover = [f"{stem[:size]}*" for size in STEMS if size <= len(stem) and f"{stem[:size]}*" in kept]
        if not any(kept[c] >= weights[term] - 1.0 for c in cover if c != term):
            kept[term] = weights[term]
    return kept


def _curve(rows: np.ndarray) -> tuple[float, ...]:
    """Logistic curve with a slight pull to zero; both classes weigh the same."""
    truth = rows[:, 0]
    ones = truth.sum()
    design = np.column_stack([np.ones(len(rows)), [features(total, int(length)) for total, length in rows[:, 1:]]])
    importance = np.where(truth == 1, 0.5 / ones, 0.5 / (len(truth) - ones)) * len(truth)
    beta = np.zeros(design.shape[1])
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(60):
        chance = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (importance * (truth - chance)) - ridge @ beta
        bend = (design * (importance * chance * (1 - chance))[:, None]).T @ design + ridge
        step = np.linalg.solve(bend, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(value) for value in beta)


def learn_lexicon(rows: DataFrame, exceptions: Sequence[str] = ()) -> Lexicon:
    """Fit lexicon, exception phrases and curve on ``text, toxic`` rows (see ``training_rows``)."""
    prepare(rows.sparkSession)
    rows = materialise(rows)
    sizes = {row.toxic: row.n for row in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(n for label, n in sizes.items() if label != 1)
    given = frozenset(" ".join(phrase.lower().split()) for phrase in exceptions)
    if not n_toxic or not n_clean:
        return Lexicon(exceptions=given)
    common = _count(rows, terms, "true").filter(_passes(n_toxic, n_clean))
    weights = choose_terms([tuple(row) for row in common.orderBy(F.desc("toxic"), "key").collect()], n_toxic, n_clean)
    if not weights:
        return Lexicon(exceptions=given)

    def phrases(text: str) -> set[str]:
        automaton = _automaton(weights)
        plain, signed = fold(text)
        return {p for s, e, _ in find(automaton, plain, signed) for p in _neighbours(plain, signed, s, e) if p}

    harmless = _count(rows, phrases, "true").filter(
        (F.col("clean") >= 3) & (F.col("clean") * n_toxic > 20 * F.col("toxic") * n_clean)
    )
    learnt = harmless.collect()
    lexicon = Lexicon(weights, given | {row.key for row in learnt})
    scored = score(rows, lexicon).join(rows.select("doc_id", "toxic"), "doc_id")
    shaped = scored.select((F.col("toxic") == 1).cast("double"), "total", F.col("length").cast("double")).collect()
    # At most about FIT_ROWS rows of three numbers.
    return Lexicon(weights, lexicon.exceptions, _curve(np.array([tuple(row) for row in sorted(shaped)], float)))


_BUILT: dict[int, object] = {}
keeps("toxicity", _BUILT.clear)


def _automaton(weights: dict[str, float]):
    key = hash(frozenset(weights.items()))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build(weights)
    return _BUILT[key]


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, matches, total, length`` of every document. A scan and nothing else."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(lexicon.weights) if lexicon.weights else None
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                count, total = measure(text, automaton, lexicon.exceptions) if automaton else (0, 0.0)
                rows.append((_value(lexicon.curve, total, len(text)), count, total, len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.float64(), pa.int64(), pa.float64(), pa.int64()]
            arrays = [batch.column(0), *[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "matches", "total", "length"])

    chosen = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(tidy("toxicity", run), "doc_id bigint, score double, matches bigint, total double, length bigint")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """All columns of the documents that score below the threshold. A scan and nothing else."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(lexicon.weights) if lexicon.weights else None
        for batch in batches:
            if automaton:
                texts = [value.as_py() or "" for value in batch.column(text_col)]
                totals = [measure(text, automaton, lexicon.exceptions)[1] for text in texts]
                kept = [_value(lexicon.curve, total, len(text)) < threshold for total, text in zip(totals, texts, strict=True)]
                batch = batch.filter(pa.array(kept, pa.bool_()))
            yield batch

    return docs.mapInArrow(tidy("toxicity", run), docs.schema)
