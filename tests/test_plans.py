"""Plans that hold at scale: one scan per profile, no shuffle of rows, no Python where columns will do."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from raresift.operators.bits import MOST_BITS, may_be_listed, table_bits
from raresift.operators.cascade import route, verdicts
from raresift.operators.cleaning import clean_features
from raresift.operators.curation import exclude_known, row_delta
from raresift.operators.metrics import threshold_sweep, with_balanced_weight
from raresift.operators.profiling import missing_counts, missing_patterns, quality_report
from raresift.operators.sampling import cap_rows, shard_of, stratified_split
from raresift.operators.scaling import fit_minmax
from raresift.plans.inputs import LINE_FEATURES, lines, made_scores, table
from raresift.plans.queries_models import GIVEN


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def shuffles(text: str) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|RoundRobin|Single)", text))


@pytest.fixture(scope="module")
def items(spark, folder):
    return lines(spark, folder).select("id", "flag", *LINE_FEATURES)


def test_scoring_moves_no_row(spark, items):
    known = [(items.filter("discount > 0.09").select("id"), "id")]
    rows = clean_features(exclude_known(items, known, "id"), LINE_FEATURES)
    scored = GIVEN.score(fit_minmax(items, LINE_FEATURES).transform(rows))
    scores = {name: column for name, column in made_scores().items() if name != "filter_score"}
    text = plan(verdicts(route(scored.withColumns(scores).withColumn("is_anomaly", F.col("filter_score") > 0.1)), "id"))
    assert shuffles(text) == 0
    assert "BroadcastHashJoin" in text and "LeftAnti" in text
    assert "Python" not in text and "Arrow" not in text


def test_long_lists_are_not_broadcast(monkeypatch, items):
    from raresift.operators import sizing

    known = [(items.filter("discount > 0.09").select("id"), "id")]
    plain = {tuple(row) for row in exclude_known(items, known, "id").collect()}
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 10)
    split = exclude_known(items, known, "id")
    assert {tuple(row) for row in split.collect()} == plain
    spark = items.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(exclude_known(items, known, "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text and shuffles(text) == 2
    assert "LeftAnti" in text and "Python" not in text


def test_five_million_ids_shuffle_no_clean_row(spark):
    """Rows that are on no list pass through a branch without exchange; what the join gets is the listed rows and few more."""
    listed = spark.range(5_000_000).select((F.col("id") * 3).cast("string").alias("id"))
    rows = spark.range(200_000).select(F.when(F.col("id") % 1000 == 7, None).otherwise((F.col("id") * 3 + F.col("id") % 2).cast("string")).alias("id"))
    made = exclude_known(rows, [(listed, "id")], "id")
    text = plan(made)
    assert shuffles(text) == 2 and text.count("Union") == 1
    clean, joined = re.split(r"\n\s*[+:]- (?=.*Join)", text, maxsplit=1)
    assert "Exchange" not in clean and "LeftAnti" in joined
    kept = rows.filter("id IS NULL OR CAST(id AS bigint) % 3 = 1")
    assert made.count() == kept.count()
    assert made.exceptAll(kept).isEmpty()


def test_bit_table_misses_no_listed_id(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("id"))
    for most in (1 << 28, 1 << 12):
        test = may_be_listed(ids, "id", 20_000, most)
        found = spark.range(40_000).agg(F.count_if(test(F.col("id")) & (F.col("id") < 20_000)), F.count_if(test(F.col("id")))).first()
        assert found[0] == 20_000
        if most == 1 << 28:
            assert found[1] < 20_400  # at most two in a hundred of the others
    assert spark.range(1).select(test(F.lit(None).cast("string"))).first()[0] is False
    assert table_bits(0) == 64 and table_bits(10**12) == MOST_BITS


def test_split_and_samples_move_no_row(items):
    for made in (stratified_split(items, "flag", "id"), cap_rows(items, "id", 50), with_balanced_weight(items, "flag"), shard_of(items, "id", 4)):
        text = plan(made)
        assert shuffles(text) == 0 and "Window" not in text


def test_profiles_scan_once(items):
    for made in (missing_counts(items, LINE_FEATURES), quality_report(items, LINE_FEATURES), missing_patterns(items, LINE_FEATURES)):
        text = plan(made)
        assert text.count("FileScan") == 1
        assert "partial_count" in text


def test_sweep_is_one_pass(items):
    rows = items.withColumns(made_scores())
    text = plan(threshold_sweep(rows, F.col("flag") == "R", lambda value: F.col("p_rare") >= value, [i / 100 for i in range(20)]))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_scan_reads_only_what_is_asked(items):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(missing_counts(items, ["tax"]))).group(1)
    assert schema == "l_tax:double"


def test_filters_reach_the_scan(spark, folder):
    orders = table(spark, folder, "orders").filter("o_totalprice > 1000").select("o_orderkey")
    assert "GreaterThan(o_totalprice,1000.0)" in plan(orders)


def test_delta_is_a_hash_join(items):
    text = plan(row_delta(items.select("flag", "tax"), items.filter("tax > 0.02").select("flag", "tax")))
    assert "NestedLoop" not in text and "Cartesian" not in text and "LeftAnti" in text


def test_no_registered_query_uses_nested_loops(spark, folder):
    import __spark_entry__ as registered

    light = ["exclude_known", "exclude_known_stats", "row_delta", "delete_rows", "deletion_counts", "verdict", "confusion", "factorize", "balanced_bootstrap", "score_catalogue", "cap_sample"]
    for name in light:
        text = plan(registered.queries()[name](spark, folder))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name
