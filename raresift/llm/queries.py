"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from raresift.llm import attribution, lexical, licenses, mixing, ngram_join, pages, quality, records, resampling, sentencepieces, substrings, topk, toxicity
from raresift.llm.license_sql import license_sql
from raresift.plans.registry import Query, Runner

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Runner) -> Runner:
        QUERIES[name] = Query(run, sql)
        return run

    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    rows = toxicity.training_rows(docs, labels, ~held_out())
    scored = toxicity.score(docs, toxicity.learn_lexicon(rows))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "matches",
    )


@query("op2_token_records")
def op2_token_records(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    read = records.encode_to_records(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op4_mix_sources")
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(sized, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return attribution.attribute_tokens(docs, tokenizer_path("byte_bpe_50k.json"), rule="start")


OP6 = """
WITH listed AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings),
usable AS (
  SELECT vec_id FROM listed GROUP BY vec_id HAVING count(*) = count(CASE WHEN isfinite(x) THEN 1 END)),
parts AS (
  SELECT vec_id, place, CAST(floor(1024 * x) AS BIGINT) AS x FROM listed WHERE vec_id IN (SELECT vec_id FROM usable)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.place = c.place AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op6_top_k", OP6)
def op6_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_table(spark, folder, "documents"))


@query("op10_main_text")
def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(_table(spark, folder, "pages"))


@query("op7_repeated_bytes")
def op7_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, folder, "documents"), with_text=False)


@query("op3_sentence_pieces")
def op3_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    encoded = sentencepieces.encode(_table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return encoded.drop("ids")


@query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(_table(spark, folder, "documents"), size=4, percent=85)


@query("op13_license_scan", license_sql())
def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.detect(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


UPPER, LOWER = licenses.UPPER, licenses.LOWER
OP11 = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS terms
  FROM documents WHERE text IS NOT NULL),
sized AS (SELECT row, doc_id, terms, len(terms) AS n FROM texts WHERE len(terms) > 0),
sums AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sized),
counted AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY ALL),
held AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
  FROM benchmark),
weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, sums),
scored AS (
  SELECT item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weighed USING (term) JOIN sized USING (row), sums GROUP BY item_id, doc_id, row),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op11_lexical_search", OP11)
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=10)


OP12 = f"""
WITH RECURSIVE bits(byte, turn, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT byte, turn + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE turn < 8),
steps AS (SELECT byte, v FROM bits WHERE turn = 8),
sources AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{licenses.WORD}') AS words
  FROM documents),
placed AS (SELECT row, unnest(words) AS word FROM sources),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{licenses.WORD}')) AS word FROM benchmark),
state(word, code, place, s) AS (
  SELECT word, hex(word), 0, CAST(4294967295 AS BIGINT) FROM (SELECT word FROM placed UNION SELECT word FROM wanted)
  UNION ALL
  SELECT word, code, place + 1, xor(s >> 8, v) FROM state
  JOIN steps ON byte = (xor(s, CAST('0x' || substr(code, 2 * place + 1, 2) AS BIGINT)) & 255) WHERE 2 * place < len(code)),
hashed AS (SELECT word, xor(s, 4294967295) % 10000 AS bucket FROM state WHERE 2 * place = len(code)),
mine AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS s FROM placed JOIN hashed USING (word) GROUP BY bucket),
theirs AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM mine) AS all_s, (SELECT coalesce(sum(t), 0) FROM theirs) AS all_t),
gained AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain
  FROM mine LEFT JOIN theirs USING (bucket), totals),
summed AS (
  SELECT row, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM placed JOIN hashed USING (word) JOIN gained USING (bucket) GROUP BY row),
weighed AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM sources LEFT JOIN summed USING (row)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
able AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS able
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= 10 * able // 100 THEN rank END AS BIGINT) AS rank
FROM scored LEFT JOIN able USING (row)
"""


@query("op12_target_resampling", OP12)
def op12_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    made = resampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), percent=10)
    return made.select("doc_id", "n_features", "weight", "score", "rank")
