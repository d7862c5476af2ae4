"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by key within their source; distributed running
sums of their word counts tell where each source's budget ends. A budget above the source's size takes whole
epochs first. The document at the cut gives only its first words, so each source meets its budget to the word.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source of its own, last in
order; rows that are equal in every column are separate rows; empty tables give empty results; further columns pass
through unread, whatever their names (internal names start with ``mix_``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from raresift.llm.spread import running_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = 20_261


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``mix_null, mix_source, source_size, target``: one row per source.

    Sources in code point order weigh ``weights`` over and over and share the sum of all sizes. No target passes
    ``most`` times its source's size; what is cut off goes to the others by weight. Filling in ascending
    order of cap per weight gives the same as resharing round by round. The table has a row per source, so one
    sort of it is small.
    """
    sources = sized.groupBy("mix_null", "mix_source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("mix_null", "mix_source")) - 1
    pick = F.element_at(F.array(*[F.lit(float(weight)) for weight in weights]), (place % len(weights) + 1).cast("int"))
    weighted = sources.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "mix_null", "mix_source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = weighted.withColumn("level", left / open_weight).withColumn(
        "capped", F.col("cap") <= F.col("level") * F.col("weight")
    )
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))
    return levelled.select(
        "mix_null", "mix_source", F.col("source_size").cast("bigint").alias("source_size"), target.alias("target")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: int = SEED,
    source_col: str = "source",
    id_col: str = "doc_id",
    size: Column | None = None,
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs`` with ``size, source_size, target, taken`` (words the mix takes)."""
    keys = {name.lower() for name in ("size", "source_size", "target", "taken")}
    clash = {name: f"mix_kept_{place}" for place, name in enumerate(docs.columns) if name.lower() in keys}
    counted = word_count(F.col(text_col)) if size is None else size
    sized = docs.withColumn("mix_size", counted).withColumnsRenamed(clash).withColumnRenamed("mix_size", "size")
    sized = sized.withColumns(
        {
            "mix_null": F.col(source_col).isNull().cast("int"),
            "mix_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
            "mix_key": F.xxhash64(F.lit(seed), F.col(id_col)),
            "mix_id": F.col(id_col),
        }
    )
    summed = running_sums(sized, ["mix_key", "mix_id", "size"], {"mix_before": "size"}, ["mix_null", "mix_source"])
    goal = targets(summed, weights, most)
    goal = F.broadcast(goal) if goal.count() <= 100_000 else goal
    joined = summed.join(goal, ["mix_null", "mix_source"])
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("mix_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    taken = F.least(taken, F.lit(most) * F.col("size")).cast("bigint")
    kept = [F.col(clash.get(name, name)).alias(name) for name in docs.columns if name not in clash]
    return joined.select(*kept, "size", "source_size", "target", taken.alias("taken"))


def take(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: a row per copy of a document; the copy at the cut ends after its last taken word."""
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    chosen = mixed.filter("taken > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), copies)))
    short = F.col("taken") - (F.col("mix_copy") - 1) * F.col("size")
    spaced = F.regexp_extract_all(F.col(text_col), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.slice(spaced, F.lit(1), short.cast("int")), "")
    return chosen.withColumn(text_col, F.when(short >= F.col("size"), F.col(text_col)).otherwise(cut))
