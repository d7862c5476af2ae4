"""Isolation filter (Liu, Ting and Zhou, 2008): rows that random cuts separate early are strange."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from raresift.functions.keyed import draw_key
from raresift.operators.sampling import cap_rows
from raresift.operators.selection import exact_percentile
from raresift.session import materialise, ship_package

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, cut double, length double"


def average_path(rows: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of that many rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1) + EULER_GAMMA) - 2.0 * (rows - 1) / rows


def _grow(x: np.ndarray, depth: int, seed: int) -> list[tuple[int, int, float, float]]:
    """(node, feature, cut, path length) of one tree. Nodes are numbered like a heap: 2i+1 left, 2i+2 right."""
    draw = np.random.default_rng(seed)
    nodes: list[tuple[int, int, float, float]] = []
    waiting = [(0, 0, x)]
    while waiting:
        node, level, rows = waiting.pop()
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if level < depth and len(rows) > 1 else np.array([])
        if not len(spread):
            nodes.append((node, -1, 0.0, level + average_path(len(rows))))
            continue
        feature = int(draw.choice(spread))
        values = rows[:, feature]
        cut = float(draw.uniform(values.min(), values.max()))
        goes_left = values <= cut
        nodes.append((node, feature, cut, 0.0))
        waiting.append((2 * node + 1, level + 1, rows[goes_left]))
        waiting.append((2 * node + 2, level + 1, rows[~goes_left]))
    return nodes


@dataclass(frozen=True)
class IsolationFilter:
    """Grown trees as flat node tables, the rows per tree and the fitted offset."""

    features: tuple[str, ...]
    sample: int
    depth: int
    offset: float
    nodes: tuple[tuple[int, int, int, float, float], ...]

    def score(self, df: DataFrame, output: str = "filter_score") -> DataFrame:
        """Add the decision score: negative for strange rows, lower is stranger."""
        ship_package(df.sparkSession)
        lengths = self._lengths()
        offset, scale = self.offset, average_path(self.sample) or 1.0

        @F.pandas_udf("double")
        def decision(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(-np.power(2.0, -lengths(batch.to_numpy(dtype=float)) / scale) - offset)

        return df.withColumn(output, decision(F.struct(*self.features)))

    def _lengths(self):
        """Function from a matrix to the mean path length per row.

        Trees become full heaps: below a leaf every node sends all rows left, so that all rows take the same
        number of steps and a whole batch moves down one level at a time.
        """
        trees = 1 + max(tree for tree, *_ in self.nodes)
        slots = 2 ** (self.depth + 1) - 1
        feature = np.zeros((trees, slots), dtype=np.int32)
        cut = np.full((trees, slots), np.inf)
        length = np.zeros((trees, slots))
        for tree, node, which, value, path in self.nodes:
            if which >= 0:
                feature[tree, node], cut[tree, node] = which, value
            else:
                while node < slots:
                    length[tree, node] = path
                    node = 2 * node + 1
        depth = self.depth

        def lengths(x: np.ndarray) -> np.ndarray:
            summed = np.zeros(len(x))
            flat = np.ascontiguousarray(x).ravel()
            start = np.arange(len(x)) * x.shape[1]
            for tree in range(trees):
                which, limit = feature[tree], cut[tree]
                node = 1 + (flat.take(start + which[0]) > limit[0])
                for _ in range(depth - 1):
                    right = flat.take(start + which.take(node)) > limit.take(node)
                    node += node
                    node += 1
                    node += right
                summed += length[tree].take(node)
            return summed / trees

        return lengths

    def describe(self) -> dict:
        return {
            "features": list(self.features),
            "sample": self.sample,
            "depth": self.depth,
            "offset": self.offset,
            "nodes": [list(node) for node in self.nodes],
        }


def isolation_from(description: dict) -> IsolationFilter:
    return IsolationFilter(
        tuple(description["features"]),
        description["sample"],
        description["depth"],
        description["offset"],
        tuple(tuple(node) for node in description["nodes"]),
    )


def tree_samples(
    df: DataFrame, features: Sequence[str], id_col: str, trees: int, sample: int, seed: int
) -> tuple[DataFrame, int]:
    """(``tree`` plus the features, rows per tree): ``sample`` rows for each tree, or all there are.

    A keyed sample of at most ``trees * sample`` rows is drawn once. It is shuffled as often as needed to serve
    every tree, and the trees of one shuffle take consecutive blocks, so no tree sees a row twice.
    """
    # Written once: the sample is counted, then dealt out.
    pool = materialise(cap_rows(df.select(id_col, *features), id_col, trees * sample, seed))
    rows = pool.agg(F.count(F.lit(1)).alias("n")).first().n
    if rows == 0:
        raise ValueError("cannot grow trees on an empty table")
    size = min(sample, rows)
    blocks = rows // size
    shuffles = math.ceil(trees / blocks)
    spread = pool.withColumn("_shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    # The pool is bounded by trees * sample rows, and so is every shuffle of it.
    order = Window.partitionBy("_shuffle").orderBy(draw_key(seed, "tree", F.col("_shuffle"), F.col(id_col)))
    block = F.expr(f"CAST((row_place - 1) DIV {size} AS INT)")
    placed = spread.withColumn("row_place", F.row_number().over(order)).withColumn("_block", block)
    tree = (F.col("_shuffle") * F.lit(blocks) + F.col("_block")).cast("int")
    dealt = placed.filter(F.col("_block") < blocks).withColumn("tree", tree).filter(F.col("tree") < trees)
    return dealt.select("tree", *features), size


def fit_isolation(
    df: DataFrame,
    features: Sequence[str],
    id_col: str,
    trees: int = 500,
    contamination: float = 0.01,
    sample: int = 256,
    seed: int = 42,
) -> IsolationFilter:
    """Grow the trees in parallel and set the offset so that ``contamination`` of the training rows are strange."""
    return fit_score_isolation(df, features, [], id_col, trees, contamination, sample, seed)[0]


def fit_score_isolation(
    df: DataFrame,
    features: Sequence[str],
    kept: Sequence[str],
    id_col: str,
    trees: int = 500,
    contamination: float = 0.01,
    sample: int = 256,
    seed: int = 42,
    output: str = "filter_score",
) -> tuple[IsolationFilter, DataFrame]:
    """(the filter, the ``kept`` columns and score of every training row): the offset needs all scores, so no row walks twice."""
    ship_package(df.sparkSession)
    names = list(features)
    depth = max(1, math.ceil(math.log2(sample)))
    chosen, used = tree_samples(df, names, id_col, trees, sample, seed)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        x = group[names].to_numpy(dtype=float)
        # Rows arrive in no fixed order; sorted, the same tree grows on every run.
        nodes = _grow(x[np.lexsort(x.T)], depth, seed * 1_000_003 + tree)
        found = pd.DataFrame(nodes, columns=["node", "feature", "cut", "length"])
        found.insert(0, "tree", tree)
        return found

    # The sample is small, and merged into one task it would be grown by one core: the number of tasks is given.
    cores = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    # At most 2 * sample nodes per tree.
    nodes = chosen.repartition(cores, "tree").groupBy("tree").applyInPandas(grow, NODE_SCHEMA).collect()
    grown = IsolationFilter(tuple(names), used, depth, 0.0, tuple(tuple(row) for row in sorted(nodes)))
    # Frozen, so that the trees run once and not for every pass of the percentile.
    scores = materialise(grown.score(df.select(*dict.fromkeys([*kept, *names])), "_score").select(*kept, "_score"))
    offset = exact_percentile(scores, "_score", 100.0 * contamination)
    fitted = IsolationFilter(grown.features, grown.sample, grown.depth, offset, grown.nodes)
    return fitted, scores.select(*kept, (F.col("_score") - F.lit(offset)).alias(output))


def strange(score: str = "filter_score") -> Column:
    """The decision score is below zero."""
    return F.col(score) < F.lit(0.0)
