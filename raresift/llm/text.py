"""Texts of an Arrow batch as one numpy byte array: words, lines, hashes and n-grams without a Python loop.

A *word* is a longest run without ASCII white space (space, and tab to carriage return). All functions work on
slices of bounded size (``SLICE_BYTES``, or one document if that is longer), so memory does not follow the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from raresift.session import ship_package

SLICE_BYTES = 1_000_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _mix_int(value: int) -> int:
    value = (value ^ (value >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    value = (value ^ (value >> 27)) * 0x94D049BB133111EB & _MASK
    return value ^ (value >> 31)


_BYTE = np.array([_mix_int(0x51ED270B + 0x9E3779B97F4A7C15 * (code + 1) & _MASK) for code in range(256)], dtype=_U)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = values ^ (values >> _U(30))
    values = values * _U(0xBF58476D1CE4E5B9)
    values ^= values >> _U(27)
    values *= _U(0x94D049BB133111EB)
    values ^= values >> _U(31)
    return values


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the largest size so far."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < size:
        grown = 1 << max(16, (size - 1).bit_length())
        made = []
        for base in (_BASE, _INVERSE):
            row = np.full(grown, _U(base))
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        have = _POWERS[0] = (made[0], made[1])
    return have


#: Rows and bytes per Arrow batch. Texts are long: Spark's own defaults would hold tens of megabytes in each task.
BATCH_ROWS = 1_000
BATCH_BYTES = "8m"
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and use small batches unless the session has its own size."""
    ship_package(spark)
    if spark.conf.get(_BATCH_CONF, "10000") == "10000":
        spark.conf.set(_BATCH_CONF, BATCH_ROWS)
    if spark.conf.get(_BYTES_CONF, None) is None:
        spark.conf.set(_BYTES_CONF, BATCH_BYTES)


_KEPT: dict[str, Callable[[], None]] = {}
_Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def keeps(user: str, drop: Callable[[], None]) -> None:
    """``drop`` frees what the tasks of ``user`` keep in a worker process."""
    _KEPT[user] = drop


def _drop_others(user: str) -> None:
    for other, drop in _KEPT.items():
        if other != user:
            drop()


def _give_back() -> None:
    """Freed memory goes back to the system, for the next task in this executor may be another process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(user: str, run: _Task) -> _Task:
    """``run`` as a task of ``user``: what others keep in the worker is dropped first, freed memory is given back last.

    Spark's workers live on from task to task, and with them all caches of earlier operators.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others(user)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


@dataclass
class Texts:
    """Bytes of some documents end to end; document ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray
    first: int  # place of the first document in the batch

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a text column into runs of whole documents. Nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    count = len(column)
    if not count:
        return
    _, places, content = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + count + 1]
    content = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    start = 0
    while start < count:
        end = max(start + 1, int(np.searchsorted(places, places[start] + limit, "right")) - 1)
        end = min(end, count)
        yield Texts(content[places[start] : places[end]], places[start : end + 1] - places[start], start)
        start = end


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index within the slice

    def __len__(self) -> int:
        return len(self.start)


def pieces(texts: Texts, separator: np.ndarray) -> Words:
    """Longest runs of bytes that are no separators, inside documents. ``separator``: one flag per byte."""
    inside = ~separator
    begins = inside.copy()
    begins[1:] &= separator[:-1]
    ends = inside.copy()
    ends[:-1] &= separator[1:]
    edges = texts.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(texts.offsets, start, "right") - 1)


def words(texts: Texts) -> Words:
    return pieces(texts, SPACE[texts.data])


def lines(texts: Texts) -> Words:
    """Non-empty runs between line feeds."""
    return pieces(texts, texts.data == 10)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, equal for equal content wherever it stands."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def ngrams(hashed: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words of one document, and the place of its first word."""
    count = len(hashed) - size + 1
    if count <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[:count] == doc[size - 1 :])
    value = np.full(len(first), _U(size))
    for step in range(size):
        value = value * _U(_BASE) + hashed[first + step]
    return mix(value), first


def char_starts(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def per_doc(doc: np.ndarray, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How many entries, or what sum of whole numbers, each document has."""
    if weights is None:
        return np.bincount(doc, minlength=count).astype(np.int64)
    return np.bincount(doc, weights=weights, minlength=count).astype(np.int64)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its key occurs twice or more, and whether an earlier entry has it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    many = np.zeros(len(keys), bool)
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def covered(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in at least one of the half-open spans."""
    change = np.bincount(start, minlength=size + 1).astype(np.int64)
    change -= np.bincount(end, minlength=size + 1)
    return np.cumsum(change[:size]) > 0
