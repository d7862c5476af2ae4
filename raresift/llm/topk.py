"""Exact top-k search by inner product, without random access.

For each block of candidates every component is one sorted list. A query reads the lists from the end that is best for
the sign of its weight, all lists to the same depth. What has been read gives each candidate a lower and an upper bound of
its score; reading stops for a query when no outsider can still pass or equal its k-th lower bound. Only then are
the scores of the candidates still possible resolved. Depth grows step by step; all queries of a group are
bounded together by matrix products over the parts of the lists that were read.

Blocks of candidates meet groups of queries in separate tasks of fixed size; the best k per block are merged per query.

Defined cases: vectors that are null or hold null or non-finite components take no part; components missing at the end
count as zero; equal scores go to the smaller id; a candidate with the query's own id is left out; extra columns are not
read; empty tables give empty results. Scores are exact integers (64 bits).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from raresift.llm.text import prepare
from raresift.session import materialise

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
#: Parts of the lists read before bounds are taken.
DEPTHS = (1 / 16, 1 / 4, 1 / 2)


def whole(vector: Column, factor: float = 1024.0) -> Column:
    """``floor(factor * x)`` of each component; null for a vector that takes no part."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & F.coalesce(usable, F.lit(False)), F.transform(numbers, lambda x: F.floor(x * factor)))


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers: by floating point where that is exact, else by integers."""
    width = max(1, left.shape[1])
    if float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * width < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its best ``k`` rows of the block. Rows are sorted by id."""
    count, width = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(count)[:, None], axis=0)  # place in the ascending list
    ascending = np.take_along_axis(rows, order, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(queries)
    open_queries = np.arange(len(queries))
    own = {int(value): place for place, value in enumerate(row_ids)}
    for share in (*DEPTHS, 1.0):
        depth = min(count, max(k + 1, int(np.ceil(share * count))))
        q_up, q_down = up[open_queries], down[open_queries]
        top = rank >= count - depth  # read from the high end, for positive weights
        low = rank < depth  # read from the low end, for negative weights
        seen = _product(np.where(top, rows, 0), q_up) + _product(np.where(low, rows, 0), q_down)
        if depth < count:
            # An unread entry lies between the list's far end and the last entry read.
            most = np.where(top, 0, ascending[count - depth][None, :]), np.where(low, 0, ascending[depth - 1][None, :])
            least = np.where(top, 0, ascending[0][None, :]), np.where(low, 0, ascending[-1][None, :])
            upper = seen + _product(most[0], q_up) + _product(most[1], q_down)
            lower = seen + _product(least[0], q_up) + _product(least[1], q_down)
        else:
            upper = lower = seen
        left = []
        for column, query in enumerate(open_queries):
            bound, ceiling = lower[:, column].copy(), upper[:, column]
            possible = np.ones(count, bool)
            mine = own.get(int(query_ids[query]))
            if mine is not None:
                possible[mine] = False
                bound[mine] = np.iinfo(np.int64).min
            if count - (mine is not None) > k:
                kth = np.partition(bound, count - k)[count - k]
                possible &= ceiling >= kth
            survivors = np.flatnonzero(possible)
            if depth < count and len(survivors) > max(4 * k, count // 8):
                left.append(query)  # too many could still qualify: read on
                continue
            if depth < count:
                scores = _product(rows[survivors], queries[query : query + 1])[:, 0]
            else:
                scores = seen[survivors, column]
            best = np.lexsort((row_ids[survivors], -scores))[:k]
            found[query] = row_ids[survivors[best]], scores[best]
        open_queries = np.array(left, int)
        if not len(open_queries):
            break
    return found  # type: ignore[return-value]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    factor: float = 1024.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the best ``k`` rows for every query."""
    spark = vectors.sparkSession
    prepare(spark)
    chosen = vectors.select(
        vectors[id_col].cast("bigint").alias("vec_id"),
        whole(vectors[vector_col], factor).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    ready = materialise(chosen.filter("v IS NOT NULL AND vec_id IS NOT NULL"))
    sizes = ready.agg(F.count(F.lit(1)), F.sum(F.col("asks").cast("int"))).first()
    blocks = max(1, -(-sizes[0] // BLOCK_ROWS))
    groups = max(1, -(-(sizes[1] or 0) // QUERY_ROWS))

    def spread(name: str, parts: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(parts)).cast("int").alias(name)

    def every(name: str, parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)

    # A stated set of queries against all rows, in blocks: each pair of block and group is one task's work.
    left = ready.select("vec_id", "v", spread("part", blocks), every("team", groups))
    right = ready.filter("asks").select("vec_id", "v", every("part", blocks), spread("team", groups))

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        made: list[pa.Table] = []
        if rows.num_rows and queries.num_rows:
            ids, data = _matrix(rows)
            query_ids, weights = _matrix(queries)
            width = max(data.shape[1], weights.shape[1])
            data, weights = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (data, weights))
            for query_id, (best, scores) in zip(query_ids, search_block(weights, query_ids, data, ids, k), strict=True):
                made.append(pa.table({"query_id": np.full(len(best), query_id), "vec_id": best, "score": scores}))
        return pa.concat_tables(made) if made else EMPTY

    pairs = left.groupBy("part", "team").cogroup(right.groupBy("part", "team"))
    best = pairs.applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


EMPTY = pa.table({name: pa.array([], pa.int64()) for name in ("query_id", "vec_id", "score")})


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order, and the vectors as rows padded with zeros."""
    lists = table.column("v").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ids = table.column("vec_id").to_numpy()
    lengths = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    width = int(lengths.max(initial=0))
    data = np.zeros((len(ids), width), np.int64)
    data[np.arange(width)[None, :] < lengths[:, None]] = flat
    order = np.argsort(ids, kind="stable")
    return ids[order], data[order]
