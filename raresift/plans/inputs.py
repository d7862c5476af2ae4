"""Tables of the test star schema in the roles of a catalogue, a training table and id lists.

Each role comes twice: as a DataFrame, and as a named SQL query over the same tables for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raresift.functions.keyed import uniform
from raresift.session import spread

ORDER_FEATURES = ["total", "day", "customer", "lines", "quantity", "returned", "accepted", "pending"]
LINE_FEATURES = ["quantity", "price", "discount", "tax"]
VECTOR_FEATURES = [f"x{place}" for place in range(1, 65)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """The large catalogue: one row per order line, under a composite id.

    ``heavy`` marks queries with much work per row, for which a scan of few splits is dealt out first.
    """
    scan = table(spark, folder, "lineitem")
    scan = spread(scan, "l_orderkey") if heavy else scan
    cents = (F.col("l_extendedprice") * 100 + 0.5).cast("bigint")
    return scan.select(
        F.concat_ws(
            "-",
            *[F.col(name).cast("string") for name in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            cents.cast("string"),
            F.unix_date(F.col("l_shipdate").cast("date")).cast("string"),
        ).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


LINES = """lines AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),
                   CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR)) AS id,
         l_orderkey AS order_id, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
         l_tax AS tax, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled catalogue: one row per order with counts over its lines.

    Orders without lines, or without lines of one kind, have missing values there.
    """
    quantity = F.col("l_quantity")
    per_order = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).cast("double").alias("lines"),
            F.sum(quantity).alias("quantity"),
            F.sum(F.when(F.col("l_returnflag") == "R", quantity)).alias("returned"),
            F.sum(F.when(F.col("l_returnflag") == "A", quantity)).alias("accepted"),
            F.sum(F.when(F.col("l_returnflag") == "N", quantity)).alias("pending"),
        )
    )
    base = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        "o_orderkey",
        F.col("o_totalprice").alias("total"),
        F.datediff(F.col("o_orderdate"), F.to_date(F.lit("1992-01-01"))).cast("double").alias("day"),
        F.col("o_custkey").cast("double").alias("customer"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_orderstatus").alias("state"),
    )
    return base.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


ORDERS = """per_order AS (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS lines, sum(l_quantity) AS quantity,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS returned,
         sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS accepted,
         sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS pending
  FROM lineitem GROUP BY l_orderkey),
order_rows AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey, o_totalprice AS total,
         CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day,
         CAST(o_custkey AS DOUBLE) AS customer, o_orderpriority AS label, o_orderstatus AS state,
         lines, quantity, returned, accepted, pending
  FROM orders LEFT JOIN per_order ON o_orderkey = l_orderkey)"""


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a number written as text in good and bad ways, and one that may be infinite or not a number."""
    key = F.regexp_extract("props", r"([0-9]+)", 1)
    number = key.cast("int")
    written = (
        F.when(number < 5, F.lit("?"))
        .when(number < 10, F.concat(key, F.lit("d")))
        .when(number < 15, F.lit("inf"))
        .when(number < 20, F.concat(F.lit(" "), key, F.lit(".5 ")))
        .when(number < 25, F.concat(key, F.lit("_000")))
        .when(number < 30, F.concat(F.lit("-."), key, F.lit("e1")))
        .when(number < 35, F.lit("NaN"))
        .when(number < 40, F.lit("NA"))
        .otherwise(key)
    )
    unstable = (
        F.when(F.col("event_type") == "error", F.lit(float("inf")))
        .when(number < 3, F.lit(float("-inf")))
        .when(number < 9, F.lit(float("nan")))
        .when(number > 97, F.lit(None).cast("double"))
        .otherwise(F.col("value"))
    )
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        "event_id",
        F.col("user_id").cast("double").alias("user"),
        F.col("event_type").alias("kind"),
        "value",
        number.cast("double").alias("number"),
        written.alias("written"),
        unstable.alias("unstable"),
        F.lit(5.0).alias("constant"),
    )


MEASUREMENTS = """keyed AS (
  SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS n FROM events),
measurements AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id, CAST(user_id AS DOUBLE) AS "user", event_type AS kind, value,
         CAST(n AS DOUBLE) AS number,
         CASE WHEN n < 5 THEN '?' WHEN n < 10 THEN k || 'd' WHEN n < 15 THEN 'inf' WHEN n < 20 THEN ' ' || k || '.5 '
              WHEN n < 25 THEN k || '_000' WHEN n < 30 THEN '-.' || k || 'e1' WHEN n < 35 THEN 'NaN'
              WHEN n < 40 THEN 'NA' ELSE k END AS written,
         CASE WHEN event_type = 'error' THEN CAST('inf' AS DOUBLE) WHEN n < 3 THEN CAST('-inf' AS DOUBLE)
              WHEN n < 9 THEN CAST('nan' AS DOUBLE) WHEN n > 97 THEN NULL ELSE value END AS unstable,
         CAST(5.0 AS DOUBLE) AS constant
  FROM keyed)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All 64 numbers of each row, ten classes."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        "vec_id",
        F.col("label").alias("code"),
        *[F.col("embedding")[place - 1].cast("double").alias(name) for place, name in enumerate(VECTOR_FEATURES, 1)],
    )


VECTORS = """vectors AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, label AS code, %s FROM embeddings)""" % ", ".join(
    f"CAST(embedding[{place}] AS DOUBLE) AS {name}" for place, name in enumerate(VECTOR_FEATURES, 1)
)


def known_orders(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str]]:
    """Two overlapping id lists: orders with a returned line, and orders with a fully discounted line."""
    items = table(spark, folder, "lineitem")
    training = items.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).select(
        F.col("l_orderkey").alias("sourceid")
    )
    contaminants = items.filter((F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.07)).select(
        F.col("l_orderkey").alias("sourceid")
    )
    return {"training": (training, "sourceid"), "contaminants": (contaminants, "sourceid")}


KNOWN_ORDERS = """training_ids AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40),
contaminant_ids AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id FROM lineitem
  WHERE l_discount >= CAST(0.1 AS DOUBLE) AND l_tax >= CAST(0.07 AS DOUBLE)),
known_ids AS (SELECT id FROM training_ids UNION SELECT id FROM contaminant_ids)"""


def made_scores(id_col: str = "id") -> dict[str, Column]:
    """Score columns without a model: keyed draws, a different one per column."""
    spec = uniform("spec", F.col(id_col))
    return {
        "filter_score": uniform("filter", F.col(id_col)),
        "p_rare": uniform("gate", F.col(id_col)) / F.lit(8.0),
        "spec_label": F.when(spec < 0.5, F.lit(2)).otherwise(F.lit(99)),
        "spec_conf": F.lit(0.5) + uniform("sure", F.col(id_col)) / F.lit(2.0),
        "gen_label": F.when(uniform("gen", F.col(id_col)) < 0.6, F.lit(0)).otherwise(F.lit(1)),
        "gen_conf": uniform("conf", F.col(id_col)),
    }


def sql_uniform(seed: str, ids: str = "id", word: int = 0) -> str:
    """The keyed draw as SQL text."""
    digest = f"md5('{seed}|' || {ids})"
    return f"(CAST(CAST(('0x' || substr({digest}, {1 + 8 * word}, 8)) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


SQL_SCORES = ",\n         ".join(
    [
        f"{sql_uniform('filter')} AS filter_score",
        f"{sql_uniform('gate')} / CAST(8.0 AS DOUBLE) AS p_rare",
        f"CASE WHEN {sql_uniform('spec')} < 0.5 THEN 2 ELSE 99 END AS spec_label",
        f"CAST(0.5 AS DOUBLE) + {sql_uniform('sure')} / CAST(2.0 AS DOUBLE) AS spec_conf",
        f"CASE WHEN {sql_uniform('gen')} < 0.6 THEN 0 ELSE 1 END AS gen_label",
        f"{sql_uniform('conf')} AS gen_conf",
    ]
)
