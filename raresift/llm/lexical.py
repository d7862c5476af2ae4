"""Ranked lexical search by sequential reads of impact-sorted lists, without random access.

1. One pass over the documents counts what the weights need: documents, terms, and documents per query term.
2. A second pass cuts each partition into blocks. A block has one list per query term: its documents by falling
   impact. For every item the lists of its terms are read from the top, all down to the same contribution. What has been
   read gives each document a lower score, and with the next entry of each list unread an upper one. Entries carry
   their document's length: a list that has come below what one occurrence is worth in that document does not hold it.
   A document is out when its upper score is below the k-th lower one; reading goes on until the members, and the
   scores of all that can still be members (ties included), are settled. The k-th score is carried from block to
   block of a partition, so that later blocks are given up early where they hold nothing better.
3. Before that, a pass reads only the first part of each block's lists. The k-th best of all lower scores found there
   is a bound for the whole table, with which every block of the pass proper begins.
4. The best k of all partitions are merged: k rows per item and task are shuffled, no postings.

Items are taken in groups of a bounded number of terms (``GROUP_TERMS``); each group reads the documents three times. Terms are
told apart by 64-bit hashes.

Defined cases: null and empty texts hold no term, count for nothing and are never found; items without a term have no
rows; the rows of one item id, repeated or not, are one item; items without id take no part; repeated documents are
documents of their own; a document without id comes last among equals; empty tables give an empty result; further columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from raresift.llm.text import LOWER, hashes, per_doc, pieces, prepare, slices, tidy

#: Bytes that stand between terms: ASCII characters that are no letter or digit.
BETWEEN = np.array([code < 128 and not chr(code).isalnum() for code in range(256)])
GROUP_TERMS = 400_000
BLOCK_DOCS = 16_384
BLOCK_POSTINGS = 1_000_000
#: Each turn reads the lists down to this share of the contribution of the turn before.
STEP = 3
#: Part of the entries that the first pass reads for its bounds.
FIRST = 1 / 16
DOCS, TERMS = -1, -2


def _hashed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Per slice of texts: hash and document of each term, first document, number of documents."""
    for texts in slices(column):
        found = pieces(texts, BETWEEN[texts.data])
        yield hashes(LOWER[texts.data], found.start, found.end), found.doc, texts.first, len(texts)


@dataclass(frozen=True)
class Items:
    """Query terms in ascending order of hash, and each item's places among them."""

    terms: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray
    places: np.ndarray

    def of(self, item: int) -> np.ndarray:
        return self.places[self.bounds[item] : self.bounds[item + 1]]


def _lookup(terms: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash among the query terms, and whether it is one."""
    if not len(terms):
        return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
    place = np.minimum(np.searchsorted(terms, hashed), len(terms) - 1)
    return place, terms[place] == hashed


def _frequencies(terms: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and number of occurrences, for each pair that occurs."""
    pairs, times = np.unique(doc * np.int64(max(1, len(terms))) + place, return_counts=True)
    return pairs // max(1, len(terms)), pairs % max(1, len(terms)), times


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, term``: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for hashed, doc, first, _ in _hashed(batch.column(1)):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + first)), pa.array(hashed.view(np.int64))], ["item_id", "term"])

    chosen = items.select(items[id_col].cast("bigint").alias("item_id"), items[text_col].alias("text")).filter("item_id IS NOT NULL")
    return chosen.mapInArrow(tidy("lexical", run), "item_id bigint, term bigint").distinct()


def _gathered(rows: pa.Table) -> Items:
    """Items of one group, from their rows on the driver."""
    item = rows.column("item_id").to_numpy()
    term = rows.column("term").to_numpy().view(np.uint64)
    order = np.argsort(item, kind="stable")
    terms, places = np.unique(term, return_inverse=True)
    ids, starts = np.unique(item[order], return_index=True)
    return Items(terms, ids, np.append(starts, len(order)), places[order])


def statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and documents per query term. ``docs`` has the column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held, documents, words = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for hashed, doc, _, count in _hashed(batch.column(0)):
                documents += int((per_doc(doc, count) > 0).sum())
                words += len(hashed)
                place, hit = _lookup(known, hashed)
                held += np.bincount(_frequencies(known, doc[hit], place[hit])[1], minlength=len(known))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, [DOCS, TERMS])), pa.array(np.append(held[some], [documents, words]))], ["term", "n"]
        )

    counted = docs.select("text").mapInArrow(tidy("lexical", run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    sums = {row.term: row.n for row in counted.collect()}  # a row per query term at most
    shared.destroy()
    held = np.array([sums.get(place, 0) for place in range(len(terms))], np.int64)
    return sums.get(DOCS, 0), sums.get(TERMS, 0), held


def term_weights(documents: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in held], np.int64)


def impacts(times: np.ndarray, words: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What an occurrence count is worth in a document of so many words, before the term's weight."""
    length = 10 + (90 * words * documents) // max(1, total)
    return (1_000_000_000 * times) // (1000 * times + 8 * length)


@dataclass
class Block:
    """Impact-sorted lists of some documents: list ``t`` is the entries ``bounds[t]:bounds[t + 1]``."""

    bounds: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    fall: np.ndarray  # minus the impact, ascending in each list
    once: np.ndarray  # by document: the impact of one occurrence, the least that a list can hold of it
    count: int


def make_block(terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, once: np.ndarray) -> Block:
    order = np.lexsort((-impact, term))
    term, impact = term[order], impact[order]
    return Block(np.searchsorted(term, np.arange(terms + 1)), doc[order], impact, -impact, once, len(once))


def search_block(
    block: Block, terms: np.ndarray, weights: np.ndarray, carried: np.ndarray, k: int, floor: int = 1, first: float | None = None
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents of the block that may be among the best ``k`` beside the ``carried`` scores, with exact scores.

    No score below ``floor`` matters. Also the numbers of entries read and of entries in the lists. With ``first``
    reading ends after that part of the entries, and the scores are the ``k`` best lower ones.
    """
    nothing = np.zeros(0, np.int64)
    low, high = block.bounds[terms], block.bounds[terms + 1]
    use = (high > low) & (weights > 0)
    low, high, weights = low[use], high[use], weights[use]
    listed = int((high - low).sum())
    at = low.copy()
    last = len(block.impact) - 1

    def next_impact() -> np.ndarray:
        return np.where(at < high, block.impact[np.minimum(at, last)], 0) if listed else nothing

    def kth(scores: np.ndarray) -> int:
        every = np.concatenate([carried, scores[scores > 0]])
        return max(floor, int(np.partition(every, len(every) - k)[len(every) - k])) if len(every) >= k else floor

    impact = next_impact()
    head = weights * impact
    if head.sum() < kth(nothing):
        return nothing, nothing, 0, listed
    lower = np.zeros(block.count, np.int64)
    level = float(head.max())
    open_lists = np.ones(len(low), bool)
    while True:
        level = max(1.0, level / STEP)
        new = at.copy()
        for place in np.flatnonzero(open_lists & (at < high)):
            least = -(-int(level) // int(weights[place]))
            new[place] = at[place] + np.searchsorted(block.fall[at[place] : high[place]], -least, "right")
        read = new > at
        if not read.any() and level > 1:
            continue
        if read.any():
            docs = np.concatenate([block.doc[a:b] for a, b in zip(at[read], new[read], strict=True)])
            worth = np.concatenate([w * block.impact[a:b] for w, a, b in zip(weights[read], at[read], new[read], strict=True)])
            # Sums stay far below 2**53, so adding them as doubles is exact.
            lower += np.bincount(docs, weights=worth, minlength=block.count).astype(np.int64)
            at = new
        impact = next_impact()
        head = weights * impact
        entries = int((at - low).sum())
        if first is not None and entries >= first * listed:
            best = np.argsort(lower)[-k:]
            best = best[lower[best] > 0]
            return best, lower[best], entries, listed
        bound = kth(lower)
        if int(head.sum()) >= bound:
            continue  # a document that no list has shown yet could still be a member
        # Of a document's unread lists only those count that are not yet below its least impact.
        rising = np.argsort(impact)
        left = np.append(np.cumsum(head[rising][::-1])[::-1], 0)[np.searchsorted(impact[rising], block.once)]
        seen_docs = np.concatenate([block.doc[a:b] for a, b in zip(low, at, strict=True)])
        counts = np.repeat(impact, at - low) >= block.once[seen_docs]
        seen = np.bincount(seen_docs, weights=np.repeat(head, at - low) * counts, minlength=block.count).astype(np.int64)
        upper = lower + left - seen
        members = np.flatnonzero((upper >= bound) & (lower > 0))
        unsettled = members[upper[members] > lower[members]]
        if not len(unsettled):
            return members, lower[members], entries, listed
        # A list is read on only while it may still hold an unsettled document that it has not shown.
        wanted = np.zeros(block.count, bool)
        wanted[unsettled] = True
        of_list = np.repeat(np.arange(len(low)), at - low)
        shown = np.bincount(of_list[wanted[seen_docs] & counts], minlength=len(low))
        open_lists = np.searchsorted(np.sort(block.once[unsettled]), impact, "right") > shown


def _blocks(batches: Iterator[pa.RecordBatch], terms: np.ndarray, documents: int, total: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Blocks of a partition, with the ids of their documents and whether they have one."""
    parts: list[tuple[np.ndarray, ...]] = []
    once: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    missing: list[np.ndarray] = []
    count = postings = 0

    def flush() -> tuple[Block, np.ndarray, np.ndarray]:
        doc, term, impact = (np.concatenate(column) for column in zip(*parts, strict=True))
        return make_block(len(terms), doc, term, impact, np.concatenate(once)), np.concatenate(ids), np.concatenate(missing)

    for batch in batches:
        names = batch.column(0)
        for hashed, doc, first, size in _hashed(batch.column(1)):
            words = per_doc(doc, size)
            place, hit = _lookup(terms, hashed)
            held, term, times = _frequencies(terms, doc[hit], place[hit])
            parts.append((held + count, term, impacts(times, words[held], documents, total)))
            once.append(impacts(np.ones(size, np.int64), words, documents, total))
            own = names.slice(first, size)
            ids.append(own.fill_null(0).to_numpy(zero_copy_only=False))
            missing.append(own.is_null().to_numpy(zero_copy_only=False))
            count += size
            postings += len(held)
            if count >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                yield flush()
                parts, once, ids, missing, count, postings = [], [], [], [], 0, 0
    if count:
        yield flush()


def _best_of_parts(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """``item_id, doc_id, score`` of the best ``k`` per item and partition; rows of score 0 carry the entries read and listed."""
    documents, total, held = statistics(docs, items.terms)
    weights = term_weights(documents, held)
    bounds = _partial(docs, items, weights, documents, total, k, None).filter("score > 0")
    kth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score")))
    known = {row.item_id: row.score for row in bounds.withColumn("rank", kth).filter(F.col("rank") == k).collect()}
    floors = np.array([known.get(int(item), 1) for item in items.ids], np.int64)
    return _partial(docs, items, weights, documents, total, k, floors)


def _partial(
    docs: DataFrame, items: Items, weights: np.ndarray, documents: int, total: int, k: int, floors: np.ndarray | None
) -> DataFrame:
    """One pass: the best of each partition above the floors, or without floors lower scores from the first entries."""
    shared = docs.sparkSession.sparkContext.broadcast((items, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, floors = shared.value
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        best = [empty] * len(items.ids)
        reads = np.zeros((len(items.ids), 2), np.int64)
        for block, ids, missing in _blocks(batches, items.terms, documents, total):
            for item in range(len(items.ids)):
                places = items.of(item)
                carried = best[item]
                floor, first = (1, FIRST) if floors is None else (int(floors[item]), None)
                found, scores, read, listed = search_block(block, places, weights[places], carried[0], k, floor, first)
                reads[item] += read, listed
                if len(found):
                    every = [np.concatenate(pair) for pair in zip(carried, (scores, ids[found], missing[found]), strict=True)]
                    order = np.lexsort((every[1], every[2], -every[0]))[:k]
                    best[item] = tuple(column[order] for column in every)
        for item in range(len(items.ids)):
            scores, ids, missing = best[item]
            size = len(scores) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, items.ids[item])),
                    pa.array(np.append(ids, 0), mask=np.append(missing, True)),
                    pa.array(np.append(scores, 0)),
                    pa.array(np.append(np.zeros(size - 1, np.int64), reads[item, 0])),
                    pa.array(np.append(np.zeros(size - 1, np.int64), reads[item, 1])),
                ],
                ["item_id", "doc_id", "score", "read", "listed"],
            )

    return docs.mapInArrow(tidy("lexical", run), "item_id bigint, doc_id bigint, score bigint, read bigint, listed bigint")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    with_reads: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the best ``k`` documents of every item.

    With ``with_reads`` instead ``item_id, read, listed``: entries read and entries in the lists of the item's terms.
    """
    prepare(docs.sparkSession)
    chosen = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    asked = item_terms(items, item_col, item_text)
    groups = max(1, -(-asked.count() // GROUP_TERMS))
    made: DataFrame | None = None
    for group in range(groups):
        mine = asked if groups == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group)
        part = _best_of_parts(chosen, _gathered(mine.toArrow()), k)
        made = part if made is None else made.unionByName(part)
    if with_reads:
        return made.filter("score = 0").groupBy("item_id").agg(F.sum("read").alias("read"), F.sum("listed").alias("listed"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = made.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
