"""Decision trees grown level by level from histograms: softmax boosting, and forests of balanced bags.

Features are cut into bins at exact quantiles, and every row becomes a few bytes. For each level of all trees in work one
pass over these rows adds up histograms per task; the histograms of a node meet in one place and leave as one
best split. What reaches the driver is a row per split node, bounded by the size of the model.

Sums are whole numbers: counts in forests, gradients in fixed-point units in boosting. Whole numbers add up alike
in any order, so the same trees grow however the rows are partitioned. Draws for bags are keyed by row id, so no
row is joined, copied or moved for them, and a retried task draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raresift.constants import SEED
from raresift.operators.sampling import group_counts
from raresift.operators.selection import counts_of, values_at_ranks
from raresift.schema import require_columns
from raresift.session import materialise, ship_package

BINS = 64
FOREST_BINS = 32
#: Histogram cells that a task holds at once.
CELLS = 4_000_000
#: Partial histograms that the driver adds up itself; more are added up and split by tasks.
DIRECT_BYTES = 32 * 1024 * 1024
#: Rounds of boosting between two writings of the rows' margins.
MARGIN_ROUNDS = 8
#: Partial sums of one node that meet in one task.
FAN_IN = 64
LEAF_PENALTY, LEAST_CURVATURE = 1.0, 1.0
NODE_COLUMNS = "tree int, node int, feature int, cut double, value array<double>"
ROW_COLUMNS = "label int, weight double, key bigint, bins binary"
PART_COLUMNS = "tree int, node int, part int, sums binary"
SPLIT_COLUMNS = "tree int, node int, feature int, cut int, left array<double>, right array<double>"


@dataclass(frozen=True)
class TreeEnsemble:
    """Grown trees as flat nodes, numbered like a heap: 2i+1 is left, taken when the value is at most the cut.

    ``margins``: the leaf values of tree ``t`` belong to class ``t % classes`` and are added up before a softmax.
    Otherwise leaves hold class shares, which are averaged over the trees.
    """

    features: tuple[str, ...]
    classes: int
    depth: int
    margins: bool
    nodes: tuple[tuple[int, int, int, float, tuple[float, ...]], ...]

    def probability(self, values: Column) -> Column:
        """Class probabilities from the array of features in order."""
        walk = self.walker()

        @F.pandas_udf("array<double>")
        def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.concatenate(batch.to_list() or [[]]).astype(float).reshape(len(batch), len(self.features))
                yield pd.Series(list(walk(x)))

        return probabilities(values)

    def walker(self) -> Callable[[np.ndarray], np.ndarray]:
        """Function from a matrix of features to class probabilities. A leaf above the last level sends all left."""
        trees = 1 + max(tree for tree, *_ in self.nodes)
        depth, classes, margins = self.depth, self.classes, self.margins
        slots, last = 2 ** (depth + 1) - 1, 2**depth - 1
        feature = np.zeros((trees, slots), np.int32)
        cut = np.full((trees, slots), np.inf)
        value = np.zeros((trees, slots - last, 1 if margins else classes))
        for tree, node, which, at, found in self.nodes:
            if which >= 0:
                feature[tree, node], cut[tree, node] = which, at
                continue
            while node < last:
                node = 2 * node + 1
            value[tree, node - last] = found

        def walk(x: np.ndarray) -> np.ndarray:
            total = np.zeros((len(x), classes))
            flat = np.ascontiguousarray(x).ravel()
            start = np.arange(len(x)) * x.shape[1]
            for tree in range(trees):
                node = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (flat.take(start + feature[tree].take(node)) > cut[tree].take(node))
                if margins:
                    total[:, tree % classes] += value[tree, node - last, 0]
                else:
                    total += value[tree, node - last]
            return softmax(total) if margins else total / trees

        return walk

    def importances(self) -> np.ndarray:
        """Share of the splits that use each feature."""
        used = np.bincount([which for _, _, which, *_ in self.nodes if which >= 0], minlength=len(self.features))
        return used / max(1, used.sum())

    def describe(self) -> dict:
        return {"features": list(self.features), "classes": self.classes, "depth": self.depth, "margins": self.margins}

    def save(self, spark: SparkSession, place: str) -> None:
        rows = [(tree, node, which, at, list(value)) for tree, node, which, at, value in self.nodes]
        spark.createDataFrame(rows, NODE_COLUMNS).coalesce(1).write.mode("overwrite").parquet(place)


def load_ensemble(spark: SparkSession, place: str, description: dict) -> TreeEnsemble:
    # Bounded by the trees and their depth.
    rows = spark.read.parquet(place).orderBy("tree", "node").collect()
    nodes = tuple((row.tree, row.node, row.feature, row.cut, tuple(row.value)) for row in rows)
    return TreeEnsemble(tuple(description["features"]), description["classes"], description["depth"], description["margins"], nodes)


def softmax(margins: np.ndarray) -> np.ndarray:
    odds = np.exp(margins - margins.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


# --- rows as bins ---------------------------------------------------------------------------------


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Per feature the ascending values at which its bins end; a value equal to a cut lies below it."""
    sizes = counts_of(df, features)
    ranks = [sorted({size * place // bins for place in range(1, bins)}) if size else [] for size in sizes]
    return [np.unique(values) for values in values_at_ranks(df, features, ranks)]


def binned(df: DataFrame, features: Sequence[str], cuts: list[np.ndarray], label: Column, weight: Column, key: Column) -> DataFrame:
    """``label, weight, key, bins``: a byte per feature. Missing values lie in the first bin."""
    names = [f"f{place}" for place in range(len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(3 + place).fill_null(-math.inf).to_numpy(zero_copy_only=False) for place in range(len(names))]
            found = [np.searchsorted(cut, np.where(np.isnan(x), -math.inf, x), "left") for cut, x in zip(cuts, columns, strict=True)]
            rows = np.ascontiguousarray(np.array(found, np.uint8).T)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(names)), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["label", "weight", "key", "bins"])

    chosen = df.select(
        label.cast("int").alias("label"),
        weight.cast("double").alias("weight"),
        key.cast("bigint").alias("key"),
        *[F.col(name).cast("double").alias(short) for name, short in zip(features, names, strict=True)],
    )
    return chosen.mapInArrow(run, ROW_COLUMNS)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column whose entries all have the same length."""
    content = b"".join(column.to_pylist())
    return np.frombuffer(content, kind).reshape(len(column), width)


@dataclass
class _Tree:
    """A tree in growth: feature -1 marks nodes that are not split."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: dict[int, tuple[float, ...]] = field(default_factory=dict)
    open: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        slots = 2 ** (self.depth + 1) - 1
        self.feature = np.full(slots, -1, np.int16)
        self.cut = np.zeros(slots, np.uint8)

    def walk(self, bins: np.ndarray, levels: int) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            which = self.feature[node]
            right = bins[rows, np.maximum(which, 0)] > self.cut[node]
            node = np.where(which >= 0, 2 * node + 1 + right, node)
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        """First leaf value of each row."""
        table = np.zeros(len(self.feature))
        for node, value in self.value.items():
            table[node] = value[0]
        return table[self.walk(bins, self.depth)]

    def flat(self, tree: int, cuts: list[np.ndarray]) -> list[tuple[int, int, int, float, tuple[float, ...]]]:
        split = [(tree, int(node), int(self.feature[node]), float(cuts[self.feature[node]][self.cut[node]]), ()) for node in np.flatnonzero(self.feature >= 0)]
        return split + [(tree, node, -1, 0.0, value) for node, value in sorted(self.value.items())]


def _best_splits(parts: DataFrame, width: int, split: Callable[[int, int, np.ndarray], tuple | None], tasks: int) -> DataFrame:
    """One row per node that can be split, from the partial sums of its histogram."""

    def total(group: pa.Table) -> np.ndarray:
        sums = np.zeros(width)
        for entry in group.column("sums"):
            sums += np.frombuffer(entry.as_buffer(), np.float64)
        return sums

    def combine(group: pa.Table) -> pa.Table:
        row = group.slice(0, 1)
        return pa.table(
            {
                "tree": row.column("tree"),
                "node": row.column("node"),
                "part": pa.array([row.column("part")[0].as_py() // FAN_IN], pa.int32()),
                "sums": pa.array([total(group).tobytes()], pa.binary()),
            }
        )

    def best(group: pa.Table) -> pa.Table:
        tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        found = split(tree, node, total(group))
        kinds = [pa.int32()] * 4 + [pa.list_(pa.float64())] * 2
        rows = [] if found is None else [(tree, node, *found)]
        names = [entry.split()[0] for entry in SPLIT_COLUMNS.split(", ")]
        return pa.table({name: pa.array([row[i] for row in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})

    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("part", F.col("part") % tasks).groupBy("tree", "node", "part").applyInArrow(combine, PART_COLUMNS)
    return parts.groupBy("tree", "node").applyInArrow(best, SPLIT_COLUMNS)


def _task_parts(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Non-empty histograms of a task, in batches of bounded size."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = list(sums)
    step = max(1, CELLS // max(1, len(next(iter(sums.values()), b"1"))) // 4)
    for start in range(0, len(names), step):
        own = names[start : start + step]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([tree for tree, _ in own], pa.int32()),
                pa.array([node for _, node in own], pa.int32()),
                pa.array([part] * len(own), pa.int32()),
                pa.array([sums[name].astype(np.float64).tobytes() for name in own], pa.binary()),
            ],
            ["tree", "node", "part", "sums"],
        )


Sides = dict[tuple[int, int], tuple[list[float], list[float]]]


def _grow(trees: dict[int, _Tree], parts: DataFrame, width: int, split: Callable[[int, int, np.ndarray], tuple | None], tasks: int) -> Sides:
    """Put the best splits of all open nodes into the trees; sums of both sides by (tree, node).

    Sums are whole numbers, so it does not matter where they are added.
    """
    nodes = sum(len(tree.open) for tree in trees.values())
    found = []
    if tasks * nodes * width * 8 <= DIRECT_BYTES:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for row in parts.collect():
            own = np.frombuffer(row.sums, np.float64)
            sums[row.tree, row.node] = sums[row.tree, row.node] + own if (row.tree, row.node) in sums else own
        for (tree, node), whole in sums.items():
            best = split(tree, node, whole)
            found += [(tree, node, *best)] if best else []
    else:
        found = _best_splits(parts, width, split, tasks).collect()  # one row per node
    made = {}
    for tree, node, feature, cut, left, right in found:
        trees[tree].feature[node], trees[tree].cut[node] = feature, cut
        made[tree, node] = (left, right)
    return made


# --- softmax boosting -----------------------------------------------------------------------------


@dataclass(frozen=True)
class _Gain:
    """Best split of a boosting node: histogram of gradient and curvature by feature and bin."""

    features: int
    bins: int
    unit: float

    def __call__(self, tree: int, node: int, sums: np.ndarray) -> tuple | None:
        both = sums.reshape(2, self.features, self.bins) / self.unit
        left = np.cumsum(both, axis=2)[:, :, :-1]
        whole = both.sum(axis=2)[:, :1, None]
        right = whole - left

        def score(side: np.ndarray) -> np.ndarray:
            return side[0] ** 2 / (side[1] + LEAF_PENALTY)

        gain = score(left) + score(right) - score(whole)
        gain[(left[1] < LEAST_CURVATURE) | (right[1] < LEAST_CURVATURE)] = -1.0
        place = int(np.argmax(gain))
        if gain.ravel()[place] <= 1e-9:
            return None
        feature, cut = divmod(place, self.bins - 1)
        return feature, cut, left[:, feature, cut].tolist(), right[:, feature, cut].tolist()


def _gradients(label: np.ndarray, weight: np.ndarray, margins: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the weighted multinomial loss by row and class, in whole units."""
    share = softmax(margins)
    truth = np.zeros_like(share)
    truth[np.arange(len(label)), label] = 1.0
    gradient = np.rint((share - truth) * weight[:, None] * unit)
    curvature = np.rint(np.maximum(2.0 * share * (1.0 - share), 1e-16) * weight[:, None] * unit)
    return gradient, curvature


def _add(margins: np.ndarray, bins: np.ndarray, recent: list[list[_Tree]]) -> np.ndarray:
    for round_trees in recent:
        for place, tree in enumerate(round_trees):
            margins[:, place] += tree.values(bins)
    return margins


def fit_boosted(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    classes: int,
    weight: str | None = None,
    rounds: int = 200,
    depth: int = 6,
    rate: float = 0.1,
    bins: int = BINS,
) -> TreeEnsemble:
    """Gradient boosting of the multinomial loss: each round grows one tree per class from the same pass over the rows.

    ``label`` holds 0..classes-1. Leaf values, penalty and least curvature are those of second-order boosting.
    """
    require_columns(df, [label, *features])
    if not 2 <= bins <= 256 or classes < 2:
        raise ValueError("two classes and two bins at least, 256 bins at most")
    spark, names, wide = df.sparkSession, list(features), len(features)
    ship_package(spark)
    cuts = bin_cuts(df, names, bins)
    weighed = F.lit(1.0) if weight is None else F.col(weight)
    start = binned(df, names, cuts, F.col(label), weighed, F.lit(0)).withColumn("margins", F.lit(bytes(8 * classes)))
    rows = materialise(start)
    mass = rows.agg(F.sum("weight")).first()[0]
    if not mass:
        raise ValueError("cannot boost without weight")
    # Sums of up to twice the mass stay below 2**52, so doubles add them exactly.
    unit = 2.0 ** (51 - math.ceil(math.log2(1.001 * mass + 2.0)))
    tasks = rows.rdd.getNumPartitions()
    done: list[list[_Tree]] = []
    recent: list[list[_Tree]] = []
    for _ in range(rounds):
        current = [_Tree(depth) for _ in range(classes)]
        sums: dict[tuple[int, int], tuple[float, float]] = {}
        for level in range(depth):
            if not any(tree.open for tree in current):
                break
            parts = rows.mapInArrow(_boosting_task(current, recent, level, wide, bins, unit), PART_COLUMNS)
            found = _grow(dict(enumerate(current)), parts, 2 * wide * bins, _Gain(wide, bins, unit), tasks)
            for place, tree in enumerate(current):
                for node in tree.open:
                    if (place, node) in found:
                        sums[place, 2 * node + 1], sums[place, 2 * node + 2] = map(tuple, found[place, node])
                    else:
                        gradient, curvature = sums.get((place, node), (0.0, 0.0))
                        tree.value[node] = (-rate * gradient / (curvature + LEAF_PENALTY),)
                tree.open = [child for node in tree.open if (place, node) in found for child in (2 * node + 1, 2 * node + 2)]
        for place, tree in enumerate(current):
            for node in tree.open:
                gradient, curvature = sums[place, node]
                tree.value[node] = (-rate * gradient / (curvature + LEAF_PENALTY),)
            tree.open = []
        if all((tree.feature < 0).all() for tree in current):
            break  # no split gains anything any more
        done.append(current)
        recent.append(current)
        if len(recent) == MARGIN_ROUNDS:
            rows = materialise(rows.mapInArrow(_margin_task(recent, wide, classes), f"{ROW_COLUMNS}, margins binary"))
            recent = []
    nodes = [node for turn, made in enumerate(done) for place, tree in enumerate(made) for node in tree.flat(turn * classes + place, cuts)]
    if not nodes:
        nodes = [(place, 0, -1, 0.0, (0.0,)) for place in range(classes)]
    return TreeEnsemble(tuple(names), classes, depth, True, tuple(nodes))


def _boosting_task(current: list[_Tree], recent: list[list[_Tree]], level: int, wide: int, bins: int, unit: float):
    classes = len(current)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = []
        for tree in current:
            place = np.full(len(tree.feature), -1)
            place[tree.open] = np.arange(len(tree.open))
            places.append(place)
        sums = [np.zeros((2, len(tree.open) * wide * bins)) for tree in current]
        seen = [np.zeros(len(tree.open), bool) for tree in current]
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _matrix(batch.column(3), np.uint8, wide)
            margins = _add(_matrix(batch.column(4), np.float64, classes).copy(), own, recent)
            label, weight = (batch.column(place).to_numpy(zero_copy_only=False) for place in (0, 1))
            gradient, curvature = _gradients(label, weight, margins, unit)
            for place, tree in enumerate(current):
                at = places[place][tree.walk(own, level)]
                here = np.flatnonzero(at >= 0)
                if not len(here):
                    continue
                seen[place][at[here]] = True
                cells = ((at[here, None] * wide + np.arange(wide)) * bins + own[here]).ravel()
                for side, values in enumerate((gradient, curvature)):
                    sums[place][side] += np.bincount(cells, np.repeat(values[here, place], wide), minlength=sums[place].shape[1])
        made = {}
        for place, tree in enumerate(current):
            shaped = sums[place].reshape(2, len(tree.open), wide * bins)
            made |= {(place, node): shaped[:, i].ravel() for i, node in enumerate(tree.open) if seen[place][i]}
        yield from _task_parts(made)

    return run


def _margin_task(recent: list[list[_Tree]], wide: int, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column(3), np.uint8, wide)
            margins = _add(_matrix(batch.column(4), np.float64, classes).copy(), own, recent)
            packed = pa.array([row.tobytes() for row in margins], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], packed], [*batch.schema.names[:4], "margins"])

    return run


# --- forests of balanced bags ---------------------------------------------------------------------


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def poisson_steps(mean: float) -> np.ndarray:
    """Chances of at most 0, 1, 2, ... draws, up to where nothing is left."""
    term, steps = math.exp(-mean), []
    while not steps or steps[-1] < 1.0 - 1e-12:
        steps.append((steps[-1] if steps else 0.0) + term)
        term *= mean / len(steps)
        if len(steps) > 60:
            break
    return np.array(steps)


def bag_counts(key: np.ndarray, label: np.ndarray, tree: int, seed: int, steps: list[np.ndarray]) -> np.ndarray:
    """How often each row is drawn into the bag of a tree: a Poisson number keyed by seed, tree and row.

    A class's mean is the size of the smallest class over its own, so all classes fill a bag alike.
    """
    salt = _mixed(np.array([(seed * 1_000_003 + tree + 1) & (2**64 - 1)], np.uint64))
    chance = (_mixed(key.view(np.uint64) ^ salt) >> np.uint64(11)) * 2.0**-53
    drawn = np.zeros(len(key), np.int64)
    for place, upto in enumerate(steps):
        mine = label == place
        drawn[mine] = np.searchsorted(upto, chance[mine], "right")
    return drawn


def node_features(seed: int, tree: int, node: int, varying: tuple[int, ...], some: int) -> np.ndarray:
    """The features that a node may be split on, of those that vary at all."""
    return np.sort(np.random.default_rng([seed, tree, node]).permutation(varying)[:some])


@dataclass(frozen=True)
class _Purity:
    """Best split of a forest node by Gini impurity: counts by chosen feature, bin and class."""

    seed: int
    varying: tuple[int, ...]
    some: int
    bins: int
    classes: int

    def __call__(self, tree: int, node: int, sums: np.ndarray) -> tuple | None:
        counts = sums.reshape(self.some, self.bins, self.classes)
        left = np.cumsum(counts, axis=1)[:, :-1]
        whole = counts.sum(axis=1)[:1, None]
        right = whole - left

        def purity(side: np.ndarray) -> np.ndarray:
            size = side.sum(axis=2)
            return (side**2).sum(axis=2) / np.maximum(size, 1.0)

        gain = purity(left) + purity(right) - purity(whole)
        gain[(left.sum(axis=2) < 1) | (right.sum(axis=2) < 1)] = -1.0
        place = int(np.argmax(gain))
        chosen = node_features(self.seed, tree, node, self.varying, self.some)
        if gain.ravel()[place] <= 1e-9:
            # Nothing to split; the sums still say what the root holds.
            return -1, 0, whole.ravel().tolist(), []
        which, cut = divmod(place, self.bins - 1)
        return int(chosen[which]), cut, left[which, cut].tolist(), right[which, cut].tolist()


def fit_balanced_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    id_col: str,
    classes: int,
    trees: int = 300,
    depth: int = 10,
    seed: int = SEED,
    bins: int = FOREST_BINS,
) -> TreeEnsemble:
    """A forest in which every tree sees each class as often as the smallest one, drawn with replacement.

    ``label`` holds 0..classes-1. A node is split on the best of a random square root of the features. Copies of an
    id are drawn alike.
    """
    require_columns(df, [label, id_col, *features])
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    spark, names, wide = df.sparkSession, list(features), len(features)
    ship_package(spark)
    sizes = group_counts(df, label)
    if not sizes:
        raise ValueError("cannot grow a forest without rows")
    smallest = min(sizes.values())
    steps = [poisson_steps(smallest / sizes[place]) if place in sizes else np.ones(1) for place in range(classes)]
    cuts = bin_cuts(df, names, bins)
    rows = materialise(binned(df, names, cuts, F.col(label), F.lit(1.0), F.xxhash64(id_col)).drop("weight"))
    spread = df.agg(*[(F.min(name) < F.max(name)).alias(f"v{place}") for place, name in enumerate(names)]).first()
    varying = tuple(place for place in range(wide) if spread[place]) or (0,)
    some = min(len(varying), max(1, int(math.sqrt(wide))))
    cells = some * bins * classes
    tasks = rows.rdd.getNumPartitions()
    grown = {tree: _Tree(depth) for tree in range(trees)}
    shares: dict[tuple[int, int], list[float]] = {}
    for level in range(depth):
        for group in _groups(grown, cells):
            mine = {tree: grown[tree] for tree in group}
            parts = rows.mapInArrow(_forest_task(mine, level, seed, steps, wide, varying, some, bins, classes), PART_COLUMNS)
            found = _grow(mine, parts, cells, _Purity(seed, varying, some, bins, classes), tasks)
            for tree in group:
                own, following = grown[tree], []
                for node in own.open:
                    left, right = found.get((tree, node), ([], []))
                    if not right:
                        own.value[node] = _shares(shares.get((tree, node)) or left, classes)
                        continue
                    for child, counts in ((2 * node + 1, left), (2 * node + 2, right)):
                        shares[tree, child] = counts
                        if level + 1 < depth and sum(counts) > 1 and max(counts) < sum(counts):
                            following.append(child)
                        else:
                            own.value[child] = _shares(counts, classes)
                own.open = following
    nodes = [node for tree, own in grown.items() for node in own.flat(tree, cuts)]
    return TreeEnsemble(tuple(names), classes, depth, False, tuple(nodes))


def _shares(counts: list[float], classes: int) -> tuple[float, ...]:
    whole = sum(counts)
    return tuple(count / whole for count in counts) if whole else (1.0 / classes,) * classes


def _groups(grown: dict[int, _Tree], cells: int) -> Iterator[list[int]]:
    """Trees with open nodes, in groups whose histograms fit a task."""
    group, held = [], 0
    for tree, own in grown.items():
        size = len(own.open) * cells
        if not size:
            continue
        if group and held + size > CELLS:
            yield group
            group, held = [], 0
        group.append(tree)
        held += size
    if group:
        yield group


def _forest_task(
    group: dict[int, _Tree], level: int, seed: int, steps: list[np.ndarray], wide: int, varying: tuple[int, ...], some: int, bins: int, classes: int
):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, chosen, sums = {}, {}, {}
        for tree, own in group.items():
            places[tree] = np.full(len(own.feature), -1)
            places[tree][own.open] = np.arange(len(own.open))
            chosen[tree] = np.array([node_features(seed, tree, node, varying, some) for node in own.open])
            sums[tree] = np.zeros(len(own.open) * some * bins * classes, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            label, key = (batch.column(place).to_numpy(zero_copy_only=False) for place in (0, 1))
            matrix = _matrix(batch.column(2), np.uint8, wide)
            for tree, own in group.items():
                drawn = bag_counts(key, label, tree, seed, steps)
                here = np.flatnonzero(drawn)
                at = places[tree][own.walk(matrix[here], level)]
                here, at = here[at >= 0], at[at >= 0]
                value = np.take_along_axis(matrix[here], chosen[tree][at], axis=1)
                cells = ((at[:, None] * some + np.arange(some)) * bins + value) * classes + label[here, None]
                np.add.at(sums[tree], cells.ravel(), np.repeat(drawn[here], some))
        made = {}
        for tree, own in group.items():
            shaped = sums[tree].reshape(len(own.open), -1)
            held = shaped.any(axis=1)
            made |= {(tree, node): shaped[i] for i, node in enumerate(own.open) if held[i]}
        yield from _task_parts(made)

    return run
