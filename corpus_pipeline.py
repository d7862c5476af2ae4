"""A training corpus from ``documents``: five stages, each on what the one before it kept.

Every stage takes (spark, docs, folder) and returns a DataFrame. All but the last return the columns of documents;
``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from raresift.llm import mixing, ngram_join, sentencepieces, substrings, toxicity
from raresift.llm.queries import held_out, tokenizer_path
from raresift.session import materialise

#: Words whose ids a worker keeps in the last stage: workers hold what earlier stages left in the executor too.
KEPT_WORDS = 300_000
#: The mix has a random order and the last stage a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learnt from the labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn_lexicon(toxicity.training_rows(docs, labels, ~held_out()))
    return toxicity.drop_toxic(docs, lexicon)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links five-word n-grams at a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that an earlier document holds."""
    left = substrings.remove_repeats(docs, length=50)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is two rows, one taken in part is cut."""
    taken = mixing.take(mixing.mix(docs))
    return taken.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    return sentencepieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), most_words=KEPT_WORDS)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_copies),
    ("suffix_array", without_repeats),
    ("mixing", mixed),
    ("sentence_pieces", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
