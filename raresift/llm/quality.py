"""Quality rules with repetition coverage.

Base figures are counts over words and lines. The method's own verdict measures the share of a text's word
characters inside duplicated n-grams, for several lengths of n, and inside duplicated lines. N-grams and lines are
compared by rolling 64-bit hashes in numpy, all documents of a slice at once.

Defined cases: null and empty texts have no words and fail the base rules; equal rows get equal figures; other
columns of the input are not read, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from raresift.llm import text as t

#: Largest share of the word characters that may lie inside duplicated n-grams, by n.
COVERAGE_LIMITS = {5: 0.35, 6: 0.32, 7: 0.30, 8: 0.28, 9: 0.26, 10: 0.25}
#: Largest share of the word characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 0.30
LEAST_WORDS = 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share array<double>"
)


def measure(texts: t.Texts, sizes: Sequence[int]) -> dict[str, np.ndarray]:
    """Figures of each document of a slice."""
    count, data = len(texts), texts.data
    words = t.words(texts)
    starts = t.char_starts(data)
    letters = np.concatenate([[0], np.cumsum(starts)])
    chars = letters[words.end] - letters[words.start]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    where = np.flatnonzero(symbol[data])
    found = {
        "n_words": t.per_doc(words.doc, count),
        "word_chars": t.per_doc(words.doc, count, chars),
        "n_symbols": t.per_doc(np.searchsorted(texts.offsets, where, "right") - 1, count),
    }
    hashed = t.hashes(data, words.start, words.end)

    lines = t.lines(texts)
    has_word = np.searchsorted(words.start, lines.end, "left") > np.searchsorted(words.start, lines.start, "left")
    line_hash = t.hashes(data, lines.start, lines.end) + lines.doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    _, later = t.repeated(line_hash)
    later &= has_word
    found["n_dup_lines"] = t.per_doc(lines.doc[later], count)
    before = np.concatenate([[0], np.cumsum(chars)])
    first = np.searchsorted(words.start, lines.start[later], "left")
    last = np.searchsorted(words.start, lines.end[later], "left")
    found["line_chars"] = t.per_doc(lines.doc[later], count, before[last] - before[first])

    salt = words.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for size in sorted({3, *sizes}):
        value, place = t.ngrams(hashed, words.doc, size)
        many, _ = t.repeated(value ^ salt[place])
        inside = t.covered(place[many], place[many] + size, len(words))
        if size == 3:
            found["n_repeat_words"] = t.per_doc(words.doc[inside], count)
        if size in sizes:
            found[f"chars_{size}"] = t.per_doc(words.doc[inside], count, chars[inside])
    return found


def quality(
    docs: DataFrame,
    limits: dict[int, float] = COVERAGE_LIMITS,
    line_limit: float = LINE_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of figures and verdicts per document. A scan and nothing else: no row is shuffled."""
    sizes = tuple(sorted(limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch.column(1)):
                found = measure(part, sizes)
                n_words, total = found["n_words"], np.maximum(found["word_chars"], 1)
                failed = (n_words < LEAST_WORDS) | (100 * found["n_repeat_words"] > 50 * n_words)
                line_share = found["line_chars"] / total
                shares = np.stack([found[f"chars_{size}"] / total for size in sizes], axis=1)
                good = (line_share <= line_limit) & (shares <= [limits[size] for size in sizes]).all(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)),
                        *[pa.array(found[name]) for name in SCHEMA_COUNTS],
                        pa.array(failed),
                        pa.array(~failed & good),
                        pa.array(line_share),
                        pa.array(list(shares), pa.list_(pa.float64())),
                    ],
                    names=NAMES,
                )

    t.prepare(docs.sparkSession)
    chosen = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)


NAMES = [entry.split()[0] for entry in SCHEMA.split(", ")]
SCHEMA_COUNTS = NAMES[1:6]
