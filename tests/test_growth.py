"""What must not grow with the tables: what the driver sends, and how often a costly table is worked out."""

from __future__ import annotations

from pyspark.sql import functions as F

from raresift.operators import bits, curation, metrics, models, sizing
from raresift.operators.isolation import fit_isolation, fit_score_isolation
from raresift.plans import queries_models


def test_bit_table_stays_small_for_the_driver(spark):
    # Sent once per bit that is looked up, for both branches of the exclusion.
    assert bits.MOST_BITS // 8 * bits.HASHES * 2 <= 32 << 20
    assert sizing.BROADCAST_BYTES <= 32 << 20 and sizing.BROADCAST_ROWS <= 1_000_000
    assert bits.hashes_for(1_000, 12_000) == bits.HASHES and bits.hashes_for(10**9, bits.MOST_BITS) == 1


def test_short_bit_table_sets_fewer_bits(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("id"))
    test = bits.may_be_listed(ids, "id", 20_000, 1 << 15)
    listed, any_id = spark.range(40_000).agg(F.count_if(test(F.col("id")) & (F.col("id") < 20_000)), F.count_if(test(F.col("id")))).first()
    assert listed == 20_000
    assert any_id - listed < 11_000  # four bits per id let about 14,000 of the others through


def test_training_scores_are_those_of_the_filter(spark):
    rows = spark.range(3_000).select(F.col("id").cast("string").alias("id"), *[(F.col("id") * k % 97 / 97.0).alias(f"f{k}") for k in (3, 5, 7)])
    rows = rows.unionByName(rows.limit(10)).unionByName(rows.limit(5).withColumn("id", F.lit(None).cast("string")))
    names = ["f3", "f5", "f7"]
    fitted, scored = fit_score_isolation(rows, names, ["id"], "id", trees=20)
    again = fit_isolation(rows, names, "id", trees=20)
    assert fitted == again
    assert scored.columns == ["id", "filter_score"]
    assert scored.exceptAll(again.score(rows).select("id", "filter_score")).isEmpty() and scored.count() == 3_015


def test_orders_are_joined_once(spark, folder):
    text = queries_models.frozen_orders(spark, folder)._jdf.queryExecution().toString()
    assert "Join" not in text and "lineitem" not in text


def test_observed_scores_are_worked_out_once(spark, monkeypatch):
    frozen = []
    monkeypatch.setattr(metrics, "materialise", lambda df, whole=metrics.materialise: frozen.append(df.columns) or whole(df))
    rows = spark.range(500).select((F.col("id") % 3 == 0).alias("truth"), (F.col("id") % 50 / 50.0).alias("score"))
    swept = metrics.sweep_scores(rows, F.col("truth"), F.col("score") > 0.1, "score")
    assert swept.count() == 44 and ["_truth", "_score"] in frozen


def test_fits_deal_large_tables_into_small_parts(spark, monkeypatch):
    rows = spark.range(0, 4_000, 1, 2).select((F.col("id") % 3).alias("code"), (F.col("id") % 7 / 7.0).alias("x"))
    taken = []
    monkeypatch.setattr(models, "FIT_ROWS", 100)

    class Forest(type(models.forest(2, 2))):
        def fit(self, table):
            taken.append(table.rdd.getNumPartitions())
            return super().fit(table)

    models._fit(Forest(numTrees=2, maxDepth=2, seed=1), rows, "code", ["x"], weighted=True)
    assert taken == [40]
    monkeypatch.setattr(models, "FIT_ROWS", 4_000)
    models._fit(Forest(numTrees=2, maxDepth=2, seed=1), rows, "code", ["x"], weighted=True)
    assert taken == [40, 2]


def test_very_long_list_does_not_pass_through_the_driver(spark, monkeypatch):
    ids = spark.range(6_000_000).select((F.col("id") * 2).cast("string").alias("id"))
    monkeypatch.setattr(curation, "may_be_listed", None)
    rows = spark.range(1_000).select(F.when(F.col("id") != 7, F.col("id")).cast("string").alias("id"), "id")
    rows = rows.toDF("id", "number")
    kept = curation.exclude_known(rows, [(ids, "id")], "id")
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in text and "LeftAnti" in text
    assert sorted(row.number for row in kept.collect()) == list(range(1, 1_000, 2))
    assert bits.worth_it(5_000_000) and not bits.worth_it(6_000_000)
