"""Anomaly filters on data with known outliers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.operators.isolation import (
    IsolationFilter,
    average_path,
    fit_isolation,
    isolation_from,
    strange,
    tree_samples,
)
from raresift.operators import reconstruction
from raresift.operators.reconstruction import (
    DenseReconstruction,
    LinearReconstruction,
    _forward,
    _gradient,
    _unpack,
    above,
    fit_dense,
    fit_linear,
    fit_threshold,
    layer_sizes,
    reconstruction_from,
)

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    """Points near a line in four dimensions, and ten far from it."""
    draw = np.random.default_rng(0)
    along = draw.uniform(0.2, 0.8, 1000)
    near = np.column_stack([along, 1 - along, along, 0.5 + 0.2 * along]) + draw.normal(0, 0.01, (1000, 4))
    far = draw.uniform(-0.5, 1.5, (10, 4)) + np.array([1.0, 1.0, -1.0, 1.0])
    table = [(str(i), *map(float, point)) for i, point in enumerate(np.r_[near, far])]
    return spark.createDataFrame(table, "id string, a double, b double, c double, d double").repartition(4, "id").cache()


@pytest.fixture(scope="module")
def normal(rows):
    return rows.filter("CAST(id AS INT) < 1000")


def _far(row):
    return int(row.id) >= 1000


def test_linear_error_equals_spelled_out_reconstruction(rows, normal):
    fitted = fit_linear(normal, FEATURES, 2)
    scored = fitted.score(rows).withColumns({f"r_{name}": column for name, column in zip(FEATURES, fitted.rebuilt())}).collect()
    for row in scored:
        spelled = np.mean([(row[name] - row[f"r_{name}"]) ** 2 for name in FEATURES])
        assert row.filter_score == pytest.approx(spelled, abs=1e-12)
    basis = np.array(fitted.components)
    assert basis @ basis.T == pytest.approx(np.eye(2), abs=1e-9)


def test_linear_filter_finds_outliers(rows, normal):
    fitted = fit_linear(normal, FEATURES, 1)
    cut = fit_threshold(fitted.score(normal))
    flagged = fitted.score(rows).withColumn("odd", above(cut)).collect()
    assert all(row.odd for row in flagged if _far(row))
    assert sum(row.odd for row in flagged if not _far(row)) == 50  # five percent of a thousand
    assert reconstruction_from(fitted.describe()) == fitted


def test_full_width_rebuilds_everything(normal):
    errors = fit_linear(normal, FEATURES, 9).score(normal).agg(F.max("filter_score")).first()[0]
    assert 0.0 <= errors < 1e-12


def test_threshold_is_strict(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,)], "filter_score double")
    assert rows.filter(above(1.0)).count() == 1


def test_gradient_matches_finite_differences():
    draw = np.random.default_rng(1)
    size = sum(rows * columns + columns for rows, columns in layer_sizes(3, 4))
    flat, x = draw.normal(0, 0.5, size), draw.uniform(0, 1, (5, 3))

    def loss(weights):
        return np.mean((_forward(_unpack(weights, 3, 4), x)[-1] - x) ** 2)

    exact = _gradient(flat, x, 4)
    for place in range(0, size, 5):
        step = np.zeros(size)
        step[place] = 1e-6
        assert exact[place] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=2e-5)


def test_dense_weights_do_not_depend_on_partitions(normal, monkeypatch):
    one = fit_dense(normal.repartition(1), FEATURES, width=8, epochs=3)
    monkeypatch.setattr(reconstruction, "FAN_IN", 2)
    seven = fit_dense(normal.repartition(7), FEATURES, width=8, epochs=3)
    assert one.weights == seven.weights and one.history == seven.history
    assert len(one.history) == 3 and all(unseen is not None for _, unseen in one.history)
    assert fit_dense(normal, FEATURES, width=8, epochs=1, validation=0.0).history[0][1] is None


def test_sums_are_exact_and_validation_is_not_fitted():
    draw = np.random.default_rng(2)
    size = sum(rows * columns + columns for rows, columns in layer_sizes(5, 8))
    flat, x = draw.normal(0, 0.7, size), draw.uniform(0, 1, (9000, 5))
    whole = reconstruction._gradient_sums(flat, x, 8)
    parts = [reconstruction._gradient_sums(flat, part, 8) for part in (x[:17], x[17:5000], x[5000:])]
    assert (whole == sum(parts)).all()


def test_dense_network_learns(rows, normal):
    before = fit_dense(normal, FEATURES, width=16, epochs=1)
    after = fit_dense(normal, FEATURES, width=16, epochs=25)
    assert after.history[-1][0] < after.history[0][0] / 3 and after.history[-1][1] < after.history[0][1] / 3
    first, last = (fitted.score(normal).agg(F.avg("filter_score")).first()[0] for fitted in (before, after))
    assert last < first / 3
    cut = fit_threshold(after.score(normal))
    assert all(row.filter_score > cut for row in after.score(rows).collect() if _far(row))
    again = reconstruction_from(after.describe())
    assert isinstance(again, DenseReconstruction) and again == after


def test_isolation_filter(rows, normal):
    fitted = fit_isolation(normal, FEATURES, "id", trees=60)
    scored = fitted.score(rows).withColumn("odd", strange()).collect()
    usual = np.median([row.filter_score for row in scored if not _far(row)])
    assert all(row.odd and row.filter_score < usual for row in scored if _far(row))
    assert sum(row.odd for row in scored if not _far(row)) == 10  # one percent of a thousand
    assert isolation_from(fitted.describe()) == fitted
    again = fit_isolation(normal.repartition(3), FEATURES, "id", trees=60)
    assert again == fitted


def test_isolation_path_lengths_equal_a_walk(normal):
    fitted = fit_isolation(normal, FEATURES, "id", trees=7, sample=64)
    x = np.array([[row[name] for name in FEATURES] for row in normal.limit(50).collect()])
    trees: dict = {}
    for tree, node, feature, cut, length in fitted.nodes:
        trees.setdefault(tree, {})[node] = (feature, cut, length)
    for point, mean in zip(x, fitted._lengths()(x)):
        walked = []
        for nodes in trees.values():
            node = 0
            while nodes[node][0] >= 0:
                feature, cut, _ = nodes[node]
                node = 2 * node + (1 if point[feature] <= cut else 2)
            walked.append(nodes[node][2])
        assert mean == pytest.approx(np.mean(walked))


@pytest.mark.parametrize("trees,sample", [(5, 256), (30, 256), (3, 5000)])
def test_tree_samples(normal, trees, sample):
    dealt, size = tree_samples(normal, FEATURES, "id", trees, sample, 42)
    found = dealt.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*FEATURES).alias("d")).collect()
    assert size == min(sample, 1000)
    assert {row.tree for row in found} == set(range(trees))
    assert {row.n for row in found} == {row.d for row in found} == {size}


def test_average_path():
    assert (average_path(1), average_path(2)) == (0.0, 1.0)
    assert average_path(256) == pytest.approx(10.244, abs=1e-3)


def test_empty_tables_raise(normal):
    nothing = normal.filter("false")
    with pytest.raises(ValueError):
        fit_isolation(nothing, FEATURES, "id", trees=2)
    with pytest.raises(ValueError):
        fit_dense(nothing, FEATURES, epochs=1)
    assert fit_threshold(LinearReconstruction(("a",), (0.0,), ((1.0,),)).score(nothing)) is None
    assert isinstance(isolation_from({"features": ["a"], "sample": 1, "depth": 1, "offset": 0.0, "nodes": []}), IsolationFilter)


def test_python_scorers_run_from_any_folder(tmp_path):
    """The workers get the package from the driver, not from the folder it was started in."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import functions as F\n"
        "from raresift.session import local_session\n"
        "from raresift.operators.isolation import fit_isolation\n"
        "spark = local_session('elsewhere', 2, '2g')\n"
        "rows = spark.range(300).select(F.col('id').cast('string').alias('id'), F.rand(1).alias('a'))\n"
        "print('rows', fit_isolation(rows, ['a'], 'id', trees=3, sample=32).score(rows).count())\n"
    )
    environment = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "rows 300" in done.stdout, done.stderr[-2000:]
