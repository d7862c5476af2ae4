"""Jaccard join of documents on word n-grams, with adaptive multi-match prefixes.

A document is its set of distinct n-grams. All sets are ordered alike, rarer n-grams first. If two sets are similar
enough, their prefixes of ``n - need + l`` n-grams share at least ``l``; where prefixes of different ``l`` meet, the smaller
``l`` counts. Each document lengthens its prefix as long as the estimated cost falls: reading more lists against
verifying fewer candidates.

Frequencies are counted over all documents. Documents are cut into chunks of a few megabytes; each chunk sends its
distinct n-grams to ranges of n-grams, four bytes each, and every range answers each chunk with one byte per n-gram. The
number of ranges follows the size of all texts, so a range stays a task of bounded size. N-grams of one document come
first in a prefix and need no list.

Equal sets are one node. Candidates are linked in two rounds. First every node is verified against the most central
node (the one with the most frequent n-grams) of its lists, which joins most of a large group at linear cost. Then all
candidate pairs of nodes in *different* components so far are verified, so no link that joins components is lost, while a
group of thousands of copies never expands into its pairs. Sets are told apart by 64-bit sums.

A list tells of two nodes only that they share one n-gram. Each node therefore carries two tables of fixed size, parities of
its whole set and the places of its prefix, from which the join bounds what two nodes can share at all. A pair leaves its lists
only if that is enough, so nodes of one template that are too far apart are compared there and make no rows.

Defined cases: null and empty texts have no n-grams and are alone; a text with fewer words than ``n`` has one n-gram,
the whole; rows with equal ids are one document that holds all their texts, so what links to one of them is linked to
all, and each keeps its own row; rows without id are returned without a component; further columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from raresift.llm import text as t
from raresift.session import materialise, release

#: Text bytes per chunk of documents (a longer document is a chunk), and per range of n-grams.
CHUNK_BYTES = 4_000_000
RANGE_BYTES = 8_000_000
#: Copies of a hub's row, over which the nodes that meet it are dealt.
HUB_COPIES = 16
MOST_MATCHES = 4
#: What verifying a candidate costs, in list entries read.
VERIFY_COST = 8.0
_U = np.uint64


def shingles(texts: t.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document of a slice, by document and value; and their documents."""
    data = t.LOWER[texts.data]
    words = t.words(texts)
    hashed = t.hashes(data, words.start, words.end)
    value, first = t.ngrams(hashed, words.doc, size)
    doc = words.doc[first]
    counts = np.bincount(words.doc, minlength=len(texts))
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        begin = np.searchsorted(words.doc, few)
        whole = counts[few].astype(_U)
        for step in range(size - 1):
            has = counts[few] > step
            place = np.where(has, begin + step, begin)
            whole = np.where(has, whole * _U(0x9E3779B97F4A7C15) + hashed[place], whole)
        value, doc = np.concatenate([value, t.mix(whole)]), np.concatenate([doc, few])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], doc[new]


def range_bits(texts: DataFrame) -> int:
    """Leading hash bits that number the ranges of n-grams."""
    held = texts.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    return min(24, max(2, (held // RANGE_BYTES).bit_length()))


def _codes(value: np.ndarray, bits: int) -> np.ndarray:
    """Range number and 32 further bits of each n-gram. N-grams with equal codes are counted as one."""
    return value >> _U(32 - bits)


_CHUNKS = "chunk bigint, doc_id bigint, text string, part int, codes binary, counts binary"


def chunked(texts: DataFrame, size: int, bits: int) -> DataFrame:
    """Rows of texts with the number of their chunk, and a row for each chunk and range that it has n-grams of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = _names(_CHUNKS)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for found in t.slices(batch.column(1), CHUNK_BYTES):
                count = len(found)
                rows = batch.slice(found.first, count)
                empty = [pa.nulls(count, kind) for kind in (pa.int32(), pa.binary(), pa.binary())]
                arrays = [pa.array(np.full(count, chunk)), rows.column(0), rows.column(1), *empty]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                code = [_codes(shingles(texts, size)[0], bits) for texts in t.slices(rows.column(1))]
                code, times = np.unique(np.concatenate(code), return_counts=True)
                part = (code >> _U(32)).astype(np.int32)
                low, times = code.astype(np.uint32), times.astype(np.uint32)
                parts, begin = np.unique(part, return_index=True)
                edges = [*begin.tolist(), len(code)]
                cut = list(zip(edges[:-1], edges[1:], strict=True))
                arrays = [pa.array(np.full(len(parts), chunk)), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.string())]
                arrays += [pa.array(parts)]
                arrays += [pa.array([row[a:b].tobytes() for a, b in cut], pa.binary()) for row in (low, times)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                chunk += 1

    return texts.select("doc_id", "text").mapInArrow(t.tidy("ngram_join", run), _CHUNKS)


def levels(chunks: DataFrame) -> DataFrame:
    """``chunk, part, levels``: eighths of the logarithm of each n-gram's documents, in the order that the chunk sent."""

    def answer(sent: pa.Table) -> pa.Table:
        rows = [np.frombuffer(row.as_buffer(), np.uint32) for row in sent.column("codes")]
        times = np.concatenate([np.frombuffer(row.as_buffer(), np.uint32) for row in sent.column("counts")])
        code, at = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.bincount(at, weights=times, minlength=len(code))
        level = np.minimum(255, np.floor(8 * np.log2(total))).astype(np.uint8)[at]
        edges = np.cumsum([0, *map(len, rows)])
        cut = [level[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"chunk": sent.column("chunk"), "part": sent.column("part"), "levels": pa.array(cut, pa.binary())})

    sent = chunks.filter("part IS NOT NULL").select("chunk", "part", "codes", "counts")
    return sent.groupBy("part").applyInArrow(answer, "chunk bigint, part int, levels binary")


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def need(sizes: np.ndarray, percent: int) -> np.ndarray:
    """N-grams that a set of each size must share with any partner."""
    return -(-sizes * percent // 100)


def sketches(value: np.ndarray, doc: np.ndarray, count: int) -> dict[str, np.ndarray]:
    """256 parities per set. Two sets differ in at least as many n-grams as their sketches do in bits."""
    place, quarter = value & _U(63), (value >> _U(6)) & _U(3)
    filled, begin = np.unique(doc, return_index=True)
    found = {}
    for number, name in enumerate(SKETCH):
        bits = np.where(quarter == number, _U(1) << place, _U(0))
        row = np.zeros(count, _U)
        if len(filled):
            row[filled] = np.bitwise_xor.reduceat(bits, begin)
        found[name] = row.view(np.int64)
    return found


def set_numbers(value: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """A number per set, equal for equal sets; entries are in order of ``doc``."""
    sizes = np.bincount(doc, minlength=count)
    begin = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        spread = np.concatenate([np.zeros(1, _U), np.cumsum(t.mix(value + _U(1)))])
        return t.mix(spread[begin + sizes] - spread[begin] + sizes.astype(_U))


def prefix_marks(token: np.ndarray, doc: np.ndarray, count: int) -> dict[str, np.ndarray]:
    """A bit for the place of each prefix entry, by document, and how many entries have a place that another one of theirs has.

    Two prefixes share at most the bits that both have and the smaller ``spare``.
    """
    place = (token >> _U(20)) % _U(64 * len(PREFIX))
    word, bit = place >> _U(6), _U(1) << (place & _U(63))
    filled, begin = np.unique(doc, return_index=True)
    spare = np.bincount(doc, minlength=count).astype(np.int64)
    found = {}
    for number, name in enumerate(PREFIX):
        row = np.zeros(count, _U)
        if len(filled):
            row[filled] = np.bitwise_or.reduceat(np.where(word == number, bit, _U(0)), begin)
        spare -= np.bitwise_count(row)
        found[name] = row.view(np.int64)
    return found | {"spare": spare}


def prefixes(value: np.ndarray, doc: np.ndarray, count: int, level: np.ndarray, percent: int) -> dict[str, np.ndarray]:
    """Chosen prefixes: figures per document, and the entries of all prefixes that other documents have (``at`` is their
    document). ``level``: of each entry, 0 where no other document has it."""
    sizes = np.bincount(doc, minlength=count).astype(np.int64)
    node = set_numbers(value, doc, count)
    estimate = level.astype(np.int64)
    rank = (estimate << 55) | (value >> _U(9)).astype(np.int64)
    order = np.lexsort((rank, doc))
    value, rank, estimate = value[order], rank[order], estimate[order]
    begin = np.cumsum(sizes) - sizes
    cost = np.concatenate([[0.0], np.cumsum(np.where(estimate > 0, np.exp2(estimate / 8.0), 0.0))])
    has = sizes > 0
    wanted = need(sizes, percent)
    best = np.full(count, np.inf)
    matches = np.ones(count, np.int64)
    for option in range(1, MOST_MATCHES + 1):
        length = np.minimum(sizes - wanted + option, sizes)
        reads = cost[begin + length] - cost[begin]
        total = np.where(option <= np.maximum(wanted, 1), reads * (1 + VERIFY_COST / option**2), np.inf)
        better = total < best
        best, matches = np.where(better, total, best), np.where(better, option, matches)
    length = np.where(has, np.minimum(sizes - wanted + matches, sizes), 0)
    entry = np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)
    summed = np.concatenate([[0], np.cumsum(estimate)])
    middle = (summed[begin + sizes] - summed[begin]) * 15 // np.maximum(sizes, 1)  # 12 bits
    last = np.zeros(count, np.int64)
    last[has] = rank[(begin + length - 1)[has]]
    key = (middle << 51) | (node & _U((1 << 51) - 1)).astype(np.int64)
    at = np.repeat(np.arange(count), length)
    shared = estimate[entry] > 0
    token, at = value[entry][shared], at[shared]
    return {
        "n": sizes, "node": node.view(np.int64), "key": key, "matches": matches, "last": last,
        **sketches(value, doc[order], count), **prefix_marks(token, at, count), "token": token.view(np.int64), "at": at,
    }


SKETCH = ("s0", "s1", "s2", "s3")
PREFIX = tuple(f"p{number}" for number in range(8))
MARKS = (*SKETCH, *PREFIX, "spare")
_FIGURES = ("n", "node", "key", "matches", "last")
NAMES = ["token", "doc_id", *_FIGURES, *MARKS]
ROWS = ", ".join(f"{name} bigint" for name in NAMES)


def node_rows(chunks: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """A row per document without token, and a row per prefix entry without document.

    The answers are written first, so that the n-grams sent for them and the texts are not shuffled at one time.
    """

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        answers = answers.sort_by("part")
        level = np.frombuffer(b"".join(row.as_py() for row in answers.column("levels")), np.uint8)
        ids = rows.column("doc_id").combine_chunks()
        sets = [(texts, *shingles(texts, size)) for texts in t.slices(rows.column("text"))]
        known = np.unique(np.concatenate([_codes(value, bits) for _, value, _ in sets]))
        if len(known) != len(level):
            raise RuntimeError("a chunk's texts and the answers it got do not belong together")
        for texts, value, doc in sets:
            count = len(texts)
            found = prefixes(value, doc, count, level[np.searchsorted(known, _codes(value, bits))], percent)
            arrays = [pa.nulls(count, pa.int64()), ids.slice(texts.first, count), *[pa.array(found[name]) for name in (*_FIGURES, *MARKS)]]
            made.append(pa.Table.from_arrays(arrays, names=NAMES))
            at = found["at"]
            arrays = [pa.array(found["token"]), pa.nulls(len(at), pa.int64())]
            arrays += [pa.array(found[name][at]) for name in _FIGURES]
            arrays += [pa.nulls(len(at), pa.int64()) for _ in MARKS]
            made.append(pa.Table.from_arrays(arrays, names=NAMES))
        return pa.concat_tables(made)

    answered = materialise(levels(chunks), compression="zstd")
    rows = chunks.filter("part IS NULL").select("chunk", "doc_id", "text")
    return rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(run, ROWS)


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id that edges ``a, b`` reach) of all ids with an edge.

    Each round takes the smallest label of the neighbours, then the label's own label, so chains shrink by doubling.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select(
        "id", F.least("id", "low").alias("component")
    )
    labels = materialise(labels)
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("component", "low").alias("component"))
        lower = materialise(lower)
        jump = lower.select(F.col("id").alias("to"), F.col("component").alias("further"))
        after = lower.join(jump, F.col("component") == F.col("to"), "left").select(
            "id", F.least("component", F.coalesce("further", "component")).alias("component")
        )
        after = materialise(after)
        moved = after.join(labels.withColumnRenamed("component", "was"), "id").filter("component <> was").limit(1).count()
        labels = after
        if not moved:
            return labels


def verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the node pairs ``x, y`` that are similar, by their whole sets."""
    wanted = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct()
    ids = heads.join(wanted, "node", "left_semi").select(F.col("head").alias("doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in t.slices(batch.column(0)):
                value, doc = shingles(texts, size)
                edges = np.searchsorted(doc, np.arange(len(texts) + 1))
                rows = [value[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                node = set_numbers(value, doc, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(rows, pa.binary())], names=["node", "held"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                left, right = (np.frombuffer(side.as_buffer(), np.uint64) for side in (a, b))
                shared = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * shared >= percent * (len(left) + len(right) - shared))
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    # One id may hold several texts: sets are found by id, and told apart by their numbers.
    rows = docs.join(ids, "doc_id", "left_semi").withColumn("mark", F.xxhash64("text")).withColumn("other", F.xxhash64(F.lit(1), "text"))
    chosen = rows.dropDuplicates(["doc_id", "mark", "other"]).select("text")
    found = chosen.mapInArrow(t.tidy("ngram_join", sets), "node bigint, held binary")
    held = materialise(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    left = pairs.join(held.select(F.col("node").alias("x"), F.col("held").alias("left")), "x")
    both = left.join(held.select(F.col("node").alias("y"), F.col("held").alias("right")), "y")
    return both.select("x", "y", "left", "right").mapInArrow(t.tidy("ngram_join", check), "x bigint, y bigint")


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    return F.ceil((n + m) * percent / (100 + percent))


def _could_link(a: str, b: str, percent: int) -> Column:
    """What sizes and sketches of two sets allow; columns are named with the prefixes."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    differ = sum(F.bit_count(F.col(f"{a}{name}").bitwiseXOR(F.col(f"{b}{name}"))) for name in SKETCH)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= n + m - 2 * _least_overlap(n, m, percent))


def _possible(side: str, other: str, shared: Column, percent: int) -> Column:
    """N-grams of a prefix that ends first and are not shared are missing from the other set."""
    n = F.col(f"{side}_n")
    length = F.least(n, n + F.col(f"{side}_matches") - F.ceil(n * percent / 100))
    missing = n - _least_overlap(F.col("a_n"), F.col("b_n"), percent)
    return (F.col(f"{side}_last") > F.col(f"{other}_last")) | (length - shared <= missing)


def _enough(shared: Column, percent: int) -> Column:
    """Whether prefixes that share so many n-grams may belong to linked sets."""
    least = F.least("a_matches", "b_matches", "a_n", "b_n")
    return (shared >= least) & _possible("a", "b", shared, percent) & _possible("b", "a", shared, percent)


def candidates(outside: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """A row for each list and pair of nodes of different components that meet there, unless their tables allow no link."""
    names = [name for name in outside.columns if name != "token"]
    a = outside.select("token", *[F.col(name).alias(f"a_{name}") for name in names])
    b = others.select("token", *[F.col(name).alias(f"b_{name}") for name in names])
    both = sum(F.bit_count(F.col(f"a_{name}").bitwiseAND(F.col(f"b_{name}"))) for name in PREFIX)
    meeting = (
        (F.col("a_label") != F.col("b_label"))
        & (~F.col("b_outside") | (F.col("a_node") < F.col("b_node")))
        & _could_link("a_", "b_", percent)
        & _enough(both + F.least("a_spare", "b_spare"), percent)
    )
    return a.join(b, "token").filter(meeting)


def join(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: two documents link when ``100 * shared >= percent * all``."""
    spark = docs.sparkSession
    t.prepare(spark)
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    bits = range_bits(texts)
    chunks = materialise(chunked(texts, size, bits), compression="zstd")
    rows = materialise(node_rows(chunks, size, percent, bits), compression="zstd")
    release(chunks)
    nodes = rows.filter("token IS NULL").select("doc_id", "n", "node", "key", *MARKS)
    usable = nodes.filter("n > 0 AND doc_id IS NOT NULL")
    # Prefixes of equal sets may end at different n-grams; the places of all of them bound each.
    marks = [*[F.bit_or(name).alias(name) for name in PREFIX], F.max("spare").alias("spare")]
    heads = materialise(usable.groupBy("node", "n", "key", *SKETCH).agg(F.min("doc_id").alias("head"), *marks))
    texts = texts.filter("doc_id IS NOT NULL")

    # Lists with at least two different nodes, and the most central node of each.
    entries = rows.filter("token IS NOT NULL").drop("doc_id", *MARKS)
    lists = entries.groupBy("token").agg(F.max("key").alias("hub"), F.min("key").alias("other")).filter("hub <> other")
    listed = materialise(entries.join(lists.select("token", "hub"), "token"))

    # First round: each node against the hub that it shares most prefix n-grams with.
    prefix = F.col("n") + F.col("matches") - F.ceil(F.col("n") * percent / 100)
    met = listed.filter("key <> hub").groupBy("node", "n", "matches", "hub").agg(F.count(F.lit(1)).alias("c"))
    met = met.filter(F.col("c") * 4 >= prefix).groupBy("node", "n").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    known = ("n", *SKETCH)
    ends = heads.select(F.col("node").alias("x"), *[F.col(name).alias(f"a_{name}") for name in known])
    hubs = heads.select(F.col("key").alias("hub"), F.col("node").alias("y"), *[F.col(name).alias(f"b_{name}") for name in known])
    # Many nodes may meet one hub: they are dealt over copies of its row.
    hubs = hubs.join(met.select("hub").distinct(), "hub", "left_semi")
    hubs = hubs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(HUB_COPIES - 1))))
    dealt = met.select(F.col("node").alias("x"), "hub", F.pmod("node", F.lit(HUB_COPIES)).cast("int").alias("copy"))
    star = dealt.join(ends, "x").join(hubs, ["hub", "copy"]).filter("x <> y")
    star = materialise(star.filter(_could_link("a_", "b_", percent)).select("x", "y"))
    first = materialise(verified(star, heads, texts, size, percent))
    edges = materialise(_edges(first, heads).union(_same_id(usable, heads)))
    labels = components(edges)
    group = heads.join(labels, F.col("head") == F.col("id"), "left").select(
        "node", "key", *MARKS, F.coalesce("component", "head").alias("label")
    )
    group = materialise(group)

    # Second round: all candidates in different components.
    known = listed.join(group.select("node", "label"), "node")
    centre = group.select(F.col("key").alias("hub"), F.col("label").alias("hub_label")).dropDuplicates(["hub"])
    columns = ["token", "node", "n", "matches", "last", "label", "outside"]
    placed = known.join(centre, "hub").withColumn("outside", F.col("label") != F.col("hub_label"))
    placed = materialise(placed.select(columns).distinct())
    outside = placed.filter("outside")
    others = placed.join(outside.select("token").distinct(), "token", "left_semi")
    tables = group.select("node", *MARKS)
    met = candidates(outside.join(tables, "node"), others.join(tables, "node"), percent)
    # A list shows the pair in either order; one order brings all its shared entries together.
    swapped = F.col("a_node") > F.col("b_node")
    ordered = [
        F.when(swapped, F.col(f"{other}_{name}")).otherwise(F.col(f"{side}_{name}")).alias(f"{side}_{name}")
        for side, other in ("ab", "ba")
        for name in ("node", "n", "matches", "last")
    ]
    sides = [f"{side}_{name}" for side in "ab" for name in ("n", "matches", "last")]
    counted = met.select(*ordered).groupBy("a_node", "b_node").agg(
        F.count(F.lit(1)).alias("c"), *[F.max(name).alias(name) for name in sides]
    )
    pairs = counted.filter(_enough(F.col("c"), percent))
    pairs = materialise(pairs.select(F.col("a_node").alias("x"), F.col("b_node").alias("y")))
    second = verified(pairs, heads, texts, size, percent)
    final = components(materialise(edges.union(_edges(second, heads))))

    placed_heads = heads.join(final, F.col("head") == F.col("id"), "left").select(
        "node", F.coalesce("component", "head").alias("component")
    )
    result = nodes.join(placed_heads, "node", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return result.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def _edges(links: DataFrame, heads: DataFrame) -> DataFrame:
    """Links between nodes as edges between their smallest documents."""
    a = heads.select(F.col("node").alias("x"), F.col("head").alias("a"))
    b = heads.select(F.col("node").alias("y"), F.col("head").alias("b"))
    return links.join(a, "x").join(b, "y").select("a", "b")


def _same_id(usable: DataFrame, heads: DataFrame) -> DataFrame:
    """Edges from each id with several texts to the smallest documents of those."""
    own = usable.select("doc_id", "node")
    several = own.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    held = own.join(several.select("doc_id"), "doc_id", "left_semi").distinct().join(heads.select("node", "head"), "node")
    return held.filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the smallest document of each component; rows without id stay."""
    joined = join(docs, size, percent)
    gone = joined.filter("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
