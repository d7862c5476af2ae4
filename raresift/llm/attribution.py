"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once, as a whole. Each token's character span is joined to the document's sections, and a token
that crosses a section border is allocated by a stated rule:

* ``start``: to the section that holds the token's first character;
* ``most``: to the section that holds most of its characters, the earlier one on a tie;
* ``share``: to every section it touches, in proportion to the characters (fractional counts).

By every rule, the counts of a document's sections add up to the count of its tokens.

Defined cases: a null or empty text has one empty section without tokens; equal rows give equal rows; further columns
are not read; an empty table gives no sections.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from raresift.llm.encoding import LONGEST_KEPT, added_strings, load
from raresift.llm.text import prepare

RULES = ("start", "most", "share")
MOST_UNITS = 1_000_000
CALL_UNITS = 400
#: White space as Unicode defines it.
_WHITE = "\t-\r \x85\xa0  -     　"
#: A byte-level tokenizer never merges over these borders: a word with the one space before it, all but the last
#: white space of a run, or a last one that is no space.
_UNIT = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_SPANS: dict[str, dict[str, bytes]] = {}

SCHEMA = "doc_id bigint, section int, start bigint, end bigint, n_tokens double, n_crossing bigint, doc_tokens bigint"


def spans(path: str) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """For a task: the start and end character of every token. Texts with an added token are encoded whole."""
    tokenizer = load(path)
    added = added_strings(path)
    cache = _SPANS.setdefault(path, {})

    def run(text: str) -> tuple[np.ndarray, np.ndarray]:
        if any(string in text for string in added):
            pairs = np.array(tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            return pairs[:, 0], pairs[:, 1]
        units = _UNIT.findall(text)
        if not units:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh = set(units).difference(cache)
        if fresh and len(cache) > MOST_UNITS:
            cache.clear()
            fresh = set(units)
        if fresh:
            _fill(tokenizer, list(fresh), cache)
        packed = list(map(cache.__getitem__, units))
        for unit in fresh:
            if len(unit) > LONGEST_KEPT:
                del cache[unit]
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
        places = np.repeat(np.cumsum(lengths) - lengths, counts)
        pairs = np.frombuffer(b"".join(packed), np.int32).reshape(-1, 2)
        return pairs[:, 0] + places, pairs[:, 1] + places

    return run


def _fill(tokenizer, units: list[str], made: dict[str, bytes]) -> None:
    """Add the packed spans of each unit. Words that begin with their space are encoded end to end, many in a call."""
    spaced: list[str] = []
    odd: list[str] = []
    for unit in units:
        (spaced if unit[0] == " " and len(unit) > 1 and not unit[1:].isspace() else odd).append(unit)
    for unit, code in zip(odd, tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
        made[unit] = np.array(code.offsets, np.int32).tobytes()
    for at in range(0, len(spaced), CALL_UNITS):
        part = spaced[at : at + CALL_UNITS]
        pairs = np.array(tokenizer.encode("".join(part), add_special_tokens=False).offsets, np.int32).reshape(-1, 2)
        starts = np.cumsum([0, *map(len, part)])
        edges = np.searchsorted(pairs[:, 0], starts)
        # Spans of all units from their own starts, packed at once and cut as bytes.
        own = pairs - np.repeat(starts[:-1], np.diff(edges)).astype(np.int32)[:, None]
        packed, cuts = own.tobytes(), (edges * own.itemsize * 2).tolist()
        made.update(zip(part, (packed[low:high] for low, high in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))


def line_sections(text: str) -> list[int]:
    """Start of each line; a line ends after its line feed."""
    starts = [0]
    at = text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def allocate(
    start: np.ndarray, end: np.ndarray, borders: np.ndarray, size: int, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and how many tokens that touch it also touch another one."""
    count = len(borders)
    last = np.maximum(end - 1, start)
    first_in = np.searchsorted(borders, start, "right") - 1
    last_in = np.searchsorted(borders, last, "right") - 1
    crossing = first_in != last_in
    touched = np.zeros(count, np.int64)
    share = np.bincount(first_in[~crossing], minlength=count).astype(float)
    stops = np.append(borders[1:], size)
    for a, b, low, high in zip(start[crossing], end[crossing], first_in[crossing], last_in[crossing], strict=True):
        parts = np.minimum(stops[low : high + 1], b) - np.maximum(borders[low : high + 1], a)
        touched[low : high + 1] += 1
        if rule == "start":
            share[low] += 1
        elif rule == "most":
            share[low + int(np.argmax(parts))] += 1
        else:
            share[low : high + 1] += parts / (b - a)
    return share, touched


def attribute_tokens(
    docs: DataFrame,
    tokenizer: str,
    rule: str = "start",
    sections: Callable[[str], list[int]] = line_sections,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per document and section. ``sections`` gives the ascending start characters, the first of them 0.

    No row is shuffled: spans meet sections where the document is.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = spans(tokenizer)
        for batch in batches:
            made: list[list[np.ndarray]] = []
            rows = 0
            for place in range(batch.num_rows):
                doc_id = batch.column(0)[place].as_py()
                text = batch.column(1)[place].as_py() or ""
                borders = np.array(sections(text), np.int64)
                start, end = find(text)
                share, touched = allocate(start, end, borders, len(text), rule)
                made.append([doc_id, borders, np.append(borders[1:], len(text)), share, touched, len(start)])
                rows += len(borders)
                if rows > 50_000:
                    yield _rows(made)
                    made, rows = [], 0
            if made:
                yield _rows(made)

    chosen = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)


def _rows(made: list) -> pa.RecordBatch:
    counts = [len(entry[1]) for entry in made]
    known = [place for place, entry in enumerate(made) for _ in range(counts[place])]
    ids = pa.array([entry[0] for entry in made], pa.int64()).take(pa.array(known))
    section = np.concatenate([np.arange(count, dtype=np.int32) for count in counts])
    joined = [np.concatenate([entry[part] for entry in made]) for part in (1, 2, 3, 4)]
    total = np.repeat(np.array([entry[5] for entry in made], np.int64), counts)
    arrays = [ids, pa.array(section), *map(pa.array, joined), pa.array(total)]
    return pa.RecordBatch.from_arrays(arrays, names=[entry.split()[0] for entry in SCHEMA.split(", ")])
