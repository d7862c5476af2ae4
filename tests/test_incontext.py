"""The context classifier against a forest, and as a probability."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from test_trees import FEATURES, frame, log_loss

from raresift.operators import incontext
from raresift.operators.incontext import fit_context, load_context
from raresift.operators.models import forest, with_vector


@pytest.mark.parametrize("classes", [2, 3])
def test_beats_a_forest_of_the_published_size(spark, classes):
    context, unseen = frame(1024, classes, 1), frame(2000, classes, 2)
    rows = spark.createDataFrame(context)
    model = fit_context(rows, FEATURES, "label", classes)
    shares = model.answerer()(unseen[FEATURES].to_numpy())
    mine = log_loss(shares, unseen["label"].to_numpy())
    table = with_vector(rows.withColumn("_label", F.col("label").cast("double")), FEATURES)
    fitted = forest(32, 10).setFeaturesCol("_features").setLabelCol("_label").fit(table)
    scored = fitted.transform(with_vector(spark.createDataFrame(unseen), FEATURES)).select("id", vector_to_array("probability").alias("p"))
    other = log_loss(np.array(scored.toPandas().sort_values("id")["p"].tolist()), unseen["label"].to_numpy())
    assert mine < other, (mine, other)
    # Calibrated: among answers of about p a share of about p is right.
    top, right = shares.max(axis=1), shares.argmax(axis=1) == unseen["label"].to_numpy()
    assert abs(top.mean() - right.mean()) < 0.03


def test_same_model_however_rows_lie_and_after_loading(spark, tmp_path):
    rows = spark.createDataFrame(frame(200, 2, 3))
    model = fit_context(rows, FEATURES, "label", 2)
    assert fit_context(rows.repartition(5), FEATURES, "label", 2) == model
    model.save(spark, f"file://{tmp_path}/c")
    assert load_context(spark, f"file://{tmp_path}/c", model.describe()) == model
    x = frame(50, 2, 4)[FEATURES].to_numpy()
    scored = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").select(model.probability(F.col("x")).alias("p"))
    found = np.array([row.p for row in scored.collect()])
    assert np.allclose(found, model.answerer()(x)) and np.allclose(found.sum(axis=1), 1.0)


def test_edges(spark, monkeypatch):
    one = spark.createDataFrame(pd.DataFrame({"label": [0], "a": [1.0]}))
    assert fit_context(one, ["a"], "label", 2).answerer()(np.array([[3.0]])).sum() == pytest.approx(1.0)
    same = spark.createDataFrame(pd.DataFrame({"label": [0, 1, 1, 1], "a": [2.0] * 4}))
    assert fit_context(same, ["a"], "label", 2).answerer()(np.array([[2.0]]))[0].argmax() == 1
    with pytest.raises(ValueError):
        fit_context(one.limit(0), ["a"], "label", 2)
    monkeypatch.setattr(incontext, "MOST_CONTEXT", 3)
    with pytest.raises(ValueError):
        fit_context(same, ["a"], "label", 2)
