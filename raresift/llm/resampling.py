"""Importance resampling towards a target distribution, by hashed n-gram features.

A feature is a run of words joined by one space; its bucket is the CRC-32 of its bytes modulo the number of buckets.
Most places of a text hold frequent words, so their CRC states are looked up in a broadcast *head* vocabulary
(and those of frequent pairs likewise). Words of the tail take their CRC directly, longer runs continue the state of the run one
word shorter. The head only saves work: whatever it holds, bucket totals and weights are exact. Its size is bounded
by parameters, and its words are counted over all documents (each task gives those that make up a stated share of its words).

The gain of a bucket compares the target's counts with those of the documents; a document's weight is the mean gain
of its features. Drawing the highest sums of weight and a Gumbel number keyed by the document's id draws without
replacement in proportion to the exponentials of the weights. Ranks come from range-sorted running counts.

Defined cases: null and empty texts have no feature and weight 0; documents below ``least_words`` are weighed but never
drawn; a missing id counts as empty text for its random number and comes last among equals; repeated rows are
rows of their own; an empty target or empty documents are a count of 0 in all buckets; further columns pass through,
those named as a new column are replaced. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from raresift.llm.lexical import BETWEEN
from raresift.llm.spread import running_sums
from raresift.llm.text import LOWER, Texts, hashes, ngrams, per_doc, pieces, prepare, slices, tidy
from raresift.session import materialise

BUCKETS, LEAST_WORDS, SEED = 10_000, 20, "2024"
#: Share of a task's words from which on a word (or pair) is offered for the head, and the most that the head holds.
HEAD_SHARE, HEAD_WORDS, HEAD_PAIRS = 1e-5, 50_000, 50_000
#: Most buckets: their totals and gains are kept on the driver and broadcast.
MOST_BUCKETS = 4_000_000
#: Runs of bytes beyond this length are given to zlib one by one.
LONG_BYTES = 48
ALL = np.uint32(0xFFFFFFFF)
NEW = ("n_features", "weight", "score", "rank")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc_on(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``crc`` is the CRC-32 of, continued by each run of bytes. All runs advance together."""
    state = crc.astype(np.uint32) ^ ALL
    length = end - start
    order = np.argsort(-np.minimum(length, LONG_BYTES), kind="stable")
    ordered, at = state[order], start[order]
    short = np.searchsorted(-length[order], -LONG_BYTES, "left") if len(order) else 0
    # Lengths fall, so the runs that still have a byte are always the first ones.
    falling = -length[order][short:]
    ordered_short, at_short = ordered[short:], at[short:]
    for place in range(int(-falling[0]) if len(falling) else 0):
        active = int(np.searchsorted(falling, -place, "left"))
        now = ordered_short[:active]
        ordered_short[:active] = CRC[(now ^ data[at_short[:active] + place]) & 255] ^ (now >> 8)
    ordered ^= ALL
    for place in range(short):
        run = order[place]
        ordered[place] = zlib.crc32(data[start[run] : end[run]].tobytes(), int(crc[run]))
    made = np.empty_like(ordered)
    made[order] = ordered
    return made


@dataclass(frozen=True)
class Head:
    """Frequent words and pairs: hashes in ascending order, and the CRC of each."""

    words: np.ndarray
    word_crc: np.ndarray
    pairs: np.ndarray
    pair_crc: np.ndarray


EMPTY = (np.zeros(0, np.uint64), np.zeros(0, np.uint32))


def _known(table: np.ndarray, crcs: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRCs from the head, and which runs are in it."""
    if not len(table):
        return np.zeros(len(hashed), np.uint32), np.zeros(len(hashed), bool)
    place = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
    return crcs[place], table[place] == hashed


@dataclass
class Runs:
    """Runs of one length in a slice: CRC, document and place of the first word."""

    crc: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def runs(texts: Texts, longest: int, head: Head) -> Iterator[Runs]:
    """All runs of 1 to ``longest`` words, length by length."""
    data = LOWER[texts.data]
    found = pieces(texts, BETWEEN[texts.data])
    hashed = hashes(data, found.start, found.end)
    crc, known = _known(head.words, head.word_crc, hashed)
    tail = np.flatnonzero(~known)
    crc[tail] = crc_on(np.zeros(len(tail), np.uint32), data, found.start[tail], found.end[tail])
    made = Runs(crc, found.doc, np.arange(len(found)))
    yield made
    space = np.array([0x20], np.uint8)
    for size in range(2, longest + 1):
        grams, first = ngrams(hashed, found.doc, size)
        # Runs of one word less that begin at the same places stand in the same order.
        shorter = made.crc[np.searchsorted(made.first, first)]
        crc, known = _known(head.pairs, head.pair_crc, grams) if size == 2 else _known(*EMPTY, grams)
        tail = np.flatnonzero(~known)
        last = first[tail] + size - 1
        spaced = crc_on(shorter[tail], space, np.zeros(len(tail), np.int64), np.ones(len(tail), np.int64))
        crc[tail] = crc_on(spaced, data, found.start[last], found.end[last])
        made = Runs(crc, found.doc[first], first)
        yield made


class _Counter:
    """Counts of 64-bit keys with a sample of each, merged now and then to hold memory down."""

    MERGE = 200_000

    def __init__(self) -> None:
        self.keys, self.counts, self.samples = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        self.total = 0

    def add(self, hashed: np.ndarray, sample) -> None:
        keys, where, counts = np.unique(hashed, return_index=True, return_counts=True)
        self.total += len(hashed)
        often = counts >= 2  # of so few words a head word makes up more
        samples = np.array([sample(place) for place in where[often]] + [b""], object)[:-1]
        keys = np.concatenate([self.keys, keys[often]])
        counts = np.concatenate([self.counts, counts[often]])
        samples = np.concatenate([self.samples, samples])
        self.keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        self.counts = np.bincount(place, weights=counts, minlength=len(self.keys)).astype(np.int64)
        self.samples = samples[first]
        if len(self.keys) > self.MERGE:
            self.keep(self.total * HEAD_SHARE / 2)

    def keep(self, least: float) -> None:
        chosen = self.counts >= least
        self.keys, self.counts, self.samples = self.keys[chosen], self.counts[chosen], self.samples[chosen]


def learn_head(docs: DataFrame, longest: int = 1) -> Head:
    """Head vocabulary of the column ``text``. Counting may miss a word; that costs time only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = _Counter(), _Counter()
        for batch in batches:
            for texts in slices(batch.column(0)):
                data = LOWER[texts.data]
                found = pieces(texts, BETWEEN[texts.data])
                hashed = hashes(data, found.start, found.end)

                def word(place: int, data=data, found=found) -> bytes:
                    return data[found.start[place] : found.end[place]].tobytes()

                counters[0].add(hashed, word)
                if longest > 1:
                    grams, first = ngrams(hashed, found.doc, 2)
                    counters[1].add(grams, lambda place, first=first, word=word: word(first[place]) + b" " + word(first[place] + 1))
        for size, counter in enumerate(counters, 1):
            counter.keep(max(2.0, counter.total * HEAD_SHARE))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counter.keys), size)),
                    pa.array(counter.keys.view(np.int64)),
                    pa.array(list(counter.samples), pa.binary()),
                    pa.array(counter.counts),
                ],
                ["size", "hash", "run", "n"],
            )

    offered = docs.select("text").mapInArrow(tidy("resampling", run), "size bigint, hash bigint, run binary, n bigint")
    counted = offered.groupBy("size", "hash").agg(F.sum("n").alias("n"), F.first("run").alias("run"))
    made = []
    for size, most in ((1, HEAD_WORDS), (2, HEAD_PAIRS)):
        if size > longest:
            made += [*EMPTY]
            continue
        rows = counted.filter(F.col("size") == size).orderBy(F.desc("n"), "hash").limit(most).select("hash", "run").toArrow()
        keys = rows.column("hash").to_numpy().view(np.uint64)
        crcs = np.array([zlib.crc32(text.as_py()) for text in rows.column("run")], np.uint32)
        order = np.argsort(keys)
        made += [keys[order], crcs[order]]
    return Head(*made)


def bucket_totals(docs: DataFrame, head: Head, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of the column ``text``."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                for made in runs(texts, longest, shared.value):
                    totals += np.bincount(made.crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(tidy("resampling", run), "bucket bigint, n bigint")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket at most
    totals = np.zeros(buckets, np.int64)
    totals[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of how much more of the target than of the documents lies in each bucket."""
    buckets = len(source)
    above = (target + 1.0) * float(source.sum() + buckets)
    below = (source + 1.0) * float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log(share)) for share in above / below], np.int64)


def weigh(docs: DataFrame, head: Head, gain: np.ndarray, longest: int = 1, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Columns of ``docs`` (without the text if not wanted) with ``n_words, n_features, weight``."""
    made = ("n_words", "n_features", "weight")
    kept = [field for field in docs.schema if field.name.lower() not in made and (with_text or field.name != text_col)]
    names = [field.name for field in kept]
    shared = docs.sparkSession.sparkContext.broadcast((head, gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gain = shared.value
        for batch in batches:
            words, features, sums = (np.zeros(batch.num_rows, np.int64) for _ in made)
            for texts in slices(batch.column(batch.num_columns - 1)):
                own = slice(texts.first, texts.first + len(texts))
                for size, found in enumerate(runs(texts, longest, head), 1):
                    held = per_doc(found.doc, len(texts))
                    if size == 1:
                        words[own] = held
                    features[own] += held
                    sums[own] += per_doc(found.doc, len(texts), gain[found.crc % np.uint32(len(gain))])
            weight = sums // np.maximum(features, 1)
            arrays = [*batch.columns[:-1], pa.array(words), pa.array(features), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *made])

    schema = StructType([*kept, *[StructField(name, LongType()) for name in made]])
    asked = docs.select(*[F.col(f"`{name}`") for name in names], F.col(text_col).cast("string").alias("resampled_text"))
    return asked.mapInArrow(tidy("resampling", run), schema)


def gumbel(id_col: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel number keyed by seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((number + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def weighted(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, text_col: str = "text", id_col: str = "doc_id", with_text: bool = True) -> DataFrame:
    """Documents with ``n_words, n_features, weight, score``; counting runs at once, weighing is a scan."""
    if longest < 1:
        raise ValueError("runs have one word at least")
    prepare(docs.sparkSession)
    texts, wanted = (df.select(F.col(text_col).cast("string").alias("text")) for df in (docs, target))
    head = learn_head(texts, longest)
    gain = gains(bucket_totals(texts, head, longest, buckets), bucket_totals(wanted, head, longest, buckets))
    made = weigh(docs, head, gain, longest, text_col, with_text)
    return made.withColumn("score", F.col("weight") + gumbel(F.col(id_col)))


def _ordered(scored: DataFrame, id_col: str, percent: int, least_words: int) -> tuple[DataFrame, int]:
    """Rows that may be drawn with ``drawn_before``, the number of better rows, and how many are to be drawn."""
    able = scored.filter(F.col("n_words") >= least_words).select("*", (-F.col("score")).alias("minus_score"), F.col(id_col).isNull().alias("id_missing"), F.lit(1).alias("one"))
    order = ["minus_score", "id_missing", id_col, "n_features", "weight"]
    return running_sums(able, order, {"drawn_before": "one"}), percent * able.count() // 100


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All documents (without their texts) with ``n_words, n_features, weight, score, rank``; rank is null if not drawn."""
    clash = [name for name in docs.columns if name.lower() in NEW]
    scored = materialise(weighted(docs.drop(*clash), target, longest, buckets, text_col, id_col, with_text=False))
    ordered, size = _ordered(scored, id_col, percent, least_words)
    place = F.col("drawn_before") + 1
    ranked = ordered.select(*scored.columns, F.when(place <= size, place).alias("rank"))
    return ranked.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The drawn documents themselves. Texts stay where they are: only ids and scores are sorted, to find the cut.

    Rows equal to the last one drawn in score and id are all drawn.
    """
    clash = {name: f"resampled_{place}" for place, name in enumerate(docs.columns) if name.lower() in (*NEW, "n_words")}
    scored = weighted(docs.withColumnsRenamed(clash), target, longest, buckets, text_col, id_col)
    narrow = materialise(scored.select(id_col, "n_words", "n_features", "weight", "score"))
    ordered, size = _ordered(narrow, id_col, percent, least_words)
    last = ordered.filter(F.col("drawn_before") == size - 1).select("score", id_col).first()
    if last is None:
        return docs.limit(0)
    equal = F.lit(True) if last[1] is None else F.coalesce(F.col(id_col) <= F.lit(last[1]), F.lit(False))
    within = (F.col("score") > last[0]) | ((F.col("score") == last[0]) & equal)
    return scored.filter((F.col("n_words") >= least_words) & within).select(*[F.col(clash.get(name, name)).alias(name) for name in docs.columns])
