"""Boosted and bagged trees: against one-against-rest, against a plain walk, and under other partitionings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from raresift.operators import trees
from raresift.operators.models import with_vector
from raresift.operators.trees import (
    TreeEnsemble,
    bag_counts,
    bin_cuts,
    fit_balanced_forest,
    fit_boosted,
    load_ensemble,
    poisson_steps,
)

FEATURES = ["a", "b", "c"]


def frame(rows: int, classes: int, seed: int) -> pd.DataFrame:
    """Classes as overlapping clouds, so that probabilities matter."""
    draw = np.random.default_rng(seed)
    label = draw.integers(0, classes, rows)
    middle = np.random.default_rng(99).normal(size=(classes, 3)) * 1.5
    x = middle[label] + draw.normal(size=(rows, 3))
    return pd.DataFrame({"id": np.arange(rows), "label": label, "a": x[:, 0], "b": np.round(x[:, 1], 1), "c": x[:, 2]})


def log_loss(share: np.ndarray, label: np.ndarray) -> float:
    return float(-np.log(np.clip(share[np.arange(len(label)), label], 1e-12, 1)).mean())


def plain_walk(model: TreeEnsemble, x: np.ndarray) -> np.ndarray:
    table = {(tree, node): (which, cut, value) for tree, node, which, cut, value in model.nodes}
    total = np.zeros((len(x), model.classes))
    count = 1 + max(tree for tree, _ in table)
    for row, values in enumerate(x):
        for tree in range(count):
            node = 0
            while table[tree, node][0] >= 0:
                which, cut, _ = table[tree, node]
                node = 2 * node + 1 + (values[which] > cut)
            if model.margins:
                total[row, tree % model.classes] += table[tree, node][2][0]
            else:
                total[row] += table[tree, node][2]
    return trees.softmax(total) if model.margins else total / count


@pytest.mark.parametrize("classes", [2, 5])
def test_boosting_beats_one_against_rest(spark, classes):
    fitted, unseen = frame(1200, classes, 1), frame(1500, classes, 2)
    rows, x = spark.createDataFrame(fitted), unseen[FEATURES].to_numpy()
    model = fit_boosted(rows, FEATURES, "label", classes, rounds=10, depth=3, rate=0.3)
    mine = log_loss(model.walker()(x), unseen["label"].to_numpy())
    table = with_vector(rows.withColumn("_label", F.col("label").cast("double")), FEATURES)
    single = GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.3, featuresCol="_features", labelCol="_label")
    rest = OneVsRest(classifier=single, featuresCol="_features", labelCol="_label").fit(table) if classes > 2 else single.fit(table)
    found = rest.transform(with_vector(spark.createDataFrame(unseen), FEATURES)).select("id", vector_to_array("rawPrediction").alias("raw")).toPandas()
    raw = np.array(found.sort_values("id")["raw"].tolist())
    odds = 1.0 / (1.0 + np.exp(-2.0 * raw))
    other = log_loss(odds / odds.sum(axis=1, keepdims=True), unseen["label"].to_numpy())
    assert mine < other, (mine, other)


def test_boosting_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(trees, "MARGIN_ROUNDS", 2)
    monkeypatch.setattr(trees, "FAN_IN", 2)
    rows = spark.createDataFrame(frame(700, 3, 3)).withColumn("w", F.col("label") * 0.37 + 0.2)
    made = []
    for parts, direct in ((1, trees.DIRECT_BYTES), (7, 0)):
        monkeypatch.setattr(trees, "DIRECT_BYTES", direct)
        made.append(fit_boosted(rows.repartition(parts, "id"), FEATURES, "label", 3, "w", rounds=5, depth=3).nodes)
    assert made[0] == made[1]


def test_boosting_is_exact_on_few_values(spark):
    """One round on one column against the sums worked out by hand."""
    data = pd.DataFrame({"a": [0.0] * 6 + [1.0] * 6, "label": [0] * 5 + [1] + [1] * 6})
    model = fit_boosted(spark.createDataFrame(data), ["a"], "label", 2, rounds=1, depth=1, rate=1.0)
    leaves = {(tree, node): value[0] for tree, node, which, _, value in model.nodes if which < 0}
    # Shares start at 1/2, so a curvature is 2/4 per row; left gradient of class 0 is 5 * -1/2 + 1/2.
    assert leaves[0, 1] == pytest.approx(2.0 / (3.0 + 1.0)) and leaves[0, 2] == pytest.approx(-3.0 / (3.0 + 1.0))
    assert leaves[1, 1] == pytest.approx(-leaves[0, 1]) and leaves[1, 2] == pytest.approx(-leaves[0, 2])


def test_scores_equal_a_plain_walk(spark, tmp_path):
    data = frame(500, 3, 4)
    rows = spark.createDataFrame(data)
    x = frame(60, 3, 5)[FEATURES].to_numpy()
    for model in (
        fit_boosted(rows, FEATURES, "label", 3, rounds=3, depth=4),
        fit_balanced_forest(rows, FEATURES, "label", "id", 3, trees=5, depth=4),
    ):
        assert np.allclose(model.walker()(x), plain_walk(model, x), atol=1e-12)
        model.save(spark, f"file://{tmp_path}/{model.margins}")
        again = load_ensemble(spark, f"file://{tmp_path}/{model.margins}", model.describe())
        assert sorted(again.nodes) == sorted(model.nodes)
        scored = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").select(model.probability(F.col("x")).alias("p"))
        assert np.allclose(np.array([row.p for row in scored.collect()]), model.walker()(x), atol=1e-12)


def test_bags_are_balanced():
    """One row in 10,001 is rare: every bag draws both classes alike, and its own rows."""
    rows = 2_000_200
    label = (np.arange(rows) < 200).astype(np.int64)
    key = trees._mixed(np.arange(rows, dtype=np.uint64)).view(np.int64)
    steps = [poisson_steps(200 / (rows - 200)), poisson_steps(1.0)]
    rare, common, bags = [], [], []
    for tree in range(12):
        drawn = bag_counts(key, label, tree, 42, steps)
        rare.append(drawn[label == 1].sum())
        common.append(drawn[label == 0].sum())
        bags.append(set(np.flatnonzero(drawn[:200])))
    assert abs(np.mean(rare) - 200) < 20 and abs(np.mean(common) - 200) < 20
    assert all(100 < a < 300 and 100 < b < 300 for a, b in zip(rare, common, strict=True))
    assert len({frozenset(bag) for bag in bags}) == 12


def test_forest_finds_the_rare_class(spark, monkeypatch):
    monkeypatch.setattr(trees, "CELLS", 2_000)
    draw = np.random.default_rng(6)
    label = (np.arange(6000) < 60).astype(int)
    data = pd.DataFrame({"id": np.arange(6000), "label": label, "a": draw.normal(size=6000) + 3 * label, "b": draw.normal(size=6000), "c": 5.0})
    rows = spark.createDataFrame(data)
    model = fit_balanced_forest(rows, FEATURES, "label", "id", 2, trees=12, depth=5)
    monkeypatch.setattr(trees, "DIRECT_BYTES", 0)
    assert model.nodes == fit_balanced_forest(rows.repartition(3), FEATURES, "label", "id", 2, trees=12, depth=5).nodes
    share = model.walker()(data[FEATURES].to_numpy())[:, 1]
    assert share[label == 1].mean() > 0.75 and share[label == 0].mean() < 0.3
    assert model.importances()[0] > model.importances()[2] == 0


def test_bins_follow_exact_quantiles(spark):
    data = frame(1000, 2, 7)
    cuts = bin_cuts(spark.createDataFrame(data), FEATURES, 8)
    expected = [np.unique(np.sort(data[name].to_numpy())[[1000 * i // 8 for i in range(1, 8)]]) for name in FEATURES]
    assert all((mine == other).all() for mine, other in zip(cuts, expected, strict=True))


def test_edges(spark):
    one = spark.createDataFrame(pd.DataFrame({"id": [1, 2], "label": [0, 1], "a": [1.0, None]}))
    model = fit_boosted(one, ["a"], "label", 2, rounds=2, depth=2)
    assert np.allclose(model.walker()(np.array([[1.0]])), 0.5)
    assert fit_balanced_forest(one, ["a"], "label", "id", 2, trees=2, depth=1).walker()(np.array([[1.0]])).sum() == pytest.approx(1.0)
    with pytest.raises(ValueError):
        fit_boosted(one.limit(0), ["a"], "label", 2)
    with pytest.raises(ValueError):
        fit_balanced_forest(one.limit(0), ["a"], "label", "id", 2)
