"""Queries over sources, cleaning, curation and profiles."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from raresift.constants import RARE_CODES
from raresift.operators.cleaning import (
    clean_features,
    coerce_features,
    drop_columns,
    id_like_columns,
    impute_constant,
    require_target,
    with_valid_flag,
)
from raresift.operators.curation import (
    delete_rows,
    deletion_counts,
    exclude_known,
    known_source_stats,
    row_delta,
    union_ids,
)
from raresift.operators.encoding import factorize, fit_labels, is_rare, label_table, merged_code
from raresift.operators.profiling import (
    class_distribution,
    contaminant_report,
    missing_counts,
    missing_inclusion,
    missing_patterns,
    quality_report,
    row_counts,
    top_labels,
)
from raresift.operators.sampling import stack_rows
from raresift.operators.scaling import fit_minmax, minmax_table
from raresift.operators.sizing import small_table
from raresift.plans.inputs import (
    KNOWN_ORDERS,
    LINES,
    LINE_FEATURES,
    MEASUREMENTS,
    ORDERS,
    ORDER_FEATURES,
    known_orders,
    lines,
    measurements,
    orders,
    table,
)
from raresift.plans.registry import query, round_all, rounded, sql_rounded, with_parts
from raresift.plans.train import prepare_training
from raresift.schema import project_features
from raresift.session import ensure_checkpoint_dir
from raresift.sources.tables import read_catalogue, read_optional_ids, rewrite_without

VERSION_COLUMNS = ["flag", "status", "quantity", "discount"]
MISSING_FEATURES = ["lines", "quantity", "returned", "accepted", "pending"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources -------------------------------------------------------------------------------------


@query("projected_scan", "SELECT CAST(o_orderkey AS VARCHAR) AS sourceid, o_orderpriority AS label, o_totalprice, o_custkey FROM orders")
def projected_scan(spark: SparkSession, folder: str) -> DataFrame:
    table_ = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("sourceid"), F.col("o_orderpriority").alias("label"), "o_totalprice", "o_custkey"
    )
    return project_features(table_, ["o_totalprice", "o_custkey"], extra=["label"])


@query("row_count", "SELECT count(*) AS rows FROM lineitem")
def row_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "csv_catalogue",
    "SELECT CAST(o_orderkey AS VARCHAR) AS sourceid, o_orderpriority AS label, CAST(o_custkey AS DOUBLE) AS customer, "
    "CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day FROM orders",
)
def csv_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Written as CSV with a header, read back by name with ids as text, features coerced from text."""
    path = scratch(spark, "catalogue.csv")
    source = orders(spark, folder).select(
        "label", F.col("day").cast("int").alias("day"), F.col("id").alias("sourceid"), F.col("customer").cast("bigint").alias("customer")
    )
    source.write.option("header", True).csv(path)
    read = read_catalogue(spark, path, ["customer", "day"], label="label", fmt="csv")
    return coerce_features(read, ["customer", "day"])


@query("optional_list", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders")
def optional_list(spark: SparkSession, folder: str) -> DataFrame:
    """A list that is not there adds no ids."""
    present = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    absent = read_optional_ids(spark, f"{ensure_checkpoint_dir(spark)}/no-such-list-{uuid.uuid4().hex}", "id")
    return union_ids([(present, "id"), (absent, "id")])


# --- curation ------------------------------------------------------------------------------------


@query(
    "exclude_known",
    with_parts(
        [KNOWN_ORDERS],
        "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders "
        "WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT id FROM known_ids)",
    ),
)
def exclude_known_query(spark: SparkSession, folder: str) -> DataFrame:
    catalogue = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_totalprice")
    return exclude_known(catalogue, list(known_orders(spark, folder).values()), "id")


@query("union_ids", with_parts([KNOWN_ORDERS], "SELECT id FROM known_ids"))
def union_ids_query(spark: SparkSession, folder: str) -> DataFrame:
    return union_ids(list(known_orders(spark, folder).values()))


@query(
    "exclude_known_stats",
    with_parts(
        [
            KNOWN_ORDERS,
            "flagged AS (SELECT CAST(o_orderkey AS VARCHAR) IN (SELECT id FROM training_ids) AS t, "
            "CAST(o_orderkey AS VARCHAR) IN (SELECT id FROM contaminant_ids) AS c FROM orders)",
        ],
        """SELECT 'training' AS list, (SELECT count(*) FROM training_ids) AS listed_ids, count(*) FILTER (t) AS removed_rows,
          count(*) FILTER (NOT (t OR c)) AS residual_rows FROM flagged
        UNION ALL SELECT 'contaminants', (SELECT count(*) FROM contaminant_ids), count(*) FILTER (c),
          count(*) FILTER (NOT (t OR c)) FROM flagged
        UNION ALL SELECT 'any', NULL, count(*) FILTER (t OR c), count(*) FILTER (NOT (t OR c)) FROM flagged""",
    ),
)
def exclude_known_stats(spark: SparkSession, folder: str) -> DataFrame:
    return known_source_stats(table(spark, folder, "orders"), known_orders(spark, folder), "o_orderkey")


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a list with many copies and missing values."""
    whole = lines(spark, folder).withColumn("discount", F.when(F.col("discount") > 0, F.col("discount")))
    newer = whole.select(*VERSION_COLUMNS)
    older = whole.filter((F.col("status") == "F") & (F.col("quantity") <= 25) & (F.col("price") < 20000)).select(*VERSION_COLUMNS)
    return older, newer


VERSIONS = (
    LINES
    + """, newer AS (SELECT flag, status, quantity, CASE WHEN discount > 0 THEN discount END AS discount FROM lines),
older AS (SELECT flag, status, quantity, CASE WHEN discount > 0 THEN discount END AS discount FROM lines
          WHERE status = 'F' AND quantity <= 25 AND price < 20000)"""
)
SAME_ROW = " AND ".join(f"a.{name} IS NOT DISTINCT FROM b.{name}" for name in VERSION_COLUMNS)
DELTA = f"delta AS (SELECT * FROM newer a WHERE NOT EXISTS (SELECT 1 FROM older b WHERE {SAME_ROW}))"


@query("row_delta", with_parts([VERSIONS, DELTA], "SELECT * FROM delta"))
def row_delta_query(spark: SparkSession, folder: str) -> DataFrame:
    return row_delta(*_versions(spark, folder))


def _deletion(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    older, newer = _versions(spark, folder)
    return lines(spark, folder).select("id", "flag", "status", "quantity"), row_delta(older, newer)


SAME_PART = " AND ".join(f"a.{name} IS NOT DISTINCT FROM b.{name}" for name in VERSION_COLUMNS[:3])


@query(
    "delete_rows",
    with_parts(
        [VERSIONS, DELTA],
        f"SELECT id, flag, status, quantity FROM lines a WHERE NOT EXISTS (SELECT 1 FROM delta b WHERE {SAME_PART})",
    ),
)
def delete_rows_query(spark: SparkSession, folder: str) -> DataFrame:
    """Matched on the columns both tables have."""
    return delete_rows(*_deletion(spark, folder))


DELETION_SQL = with_parts(
    [VERSIONS, DELTA, f"hits AS (SELECT EXISTS (SELECT 1 FROM delta b WHERE {SAME_PART}) AS hit FROM lines a)"],
    "SELECT count(*) AS rows_before, count(*) FILTER (hit) AS rows_removed, count(*) FILTER (NOT hit) AS rows_kept FROM hits",
)


@query("deletion_counts", DELETION_SQL)
def deletion_counts_query(spark: SparkSession, folder: str) -> DataFrame:
    return deletion_counts(*_deletion(spark, folder))


@query("rewrite_table", DELETION_SQL)
def rewrite_table(spark: SparkSession, folder: str) -> DataFrame:
    """The rewritten copy is counted, not the plan that made it."""
    target, listed = _deletion(spark, folder)
    path = scratch(spark, "rewritten.parquet")
    removed = rewrite_without(target, listed, path)
    kept = spark.read.parquet(path) if removed else target
    return kept.agg(F.count(F.lit(1)).alias("rows_kept")).select(
        (F.col("rows_kept") + F.lit(removed)).alias("rows_before"), F.lit(removed).cast("bigint").alias("rows_removed"), "rows_kept"
    )


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def drop_columns_query(spark: SparkSession, folder: str) -> DataFrame:
    return drop_columns(table(spark, folder, "orders"), ["o_orderstatus", "o_orderdate", "not_there"])


@query(
    "stack_rows",
    with_parts(
        [LINES], "SELECT flag AS label, quantity FROM lines UNION ALL SELECT o_orderpriority, o_totalprice FROM orders"
    ),
)
def stack_rows_query(spark: SparkSession, folder: str) -> DataFrame:
    first = lines(spark, folder).select(F.col("flag").alias("label"), "quantity")
    second = table(spark, folder, "orders").select(F.col("o_totalprice").alias("quantity"), F.col("o_orderpriority").alias("label"))
    return stack_rows(first, second)


# --- cleaning ------------------------------------------------------------------------------------

NUMERIC = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([e][+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$"
SQL_NUMBER = f"CASE WHEN regexp_matches(lower(trim(written)), '{NUMERIC}') THEN TRY_CAST(trim(written) AS DOUBLE) END"
CLEANED = (
    MEASUREMENTS
    + f""", coerced AS (SELECT id, kind, {SQL_NUMBER} AS written, unstable, value FROM measurements),
cleaned AS (SELECT * FROM coerced WHERE isfinite(written) AND isfinite(unstable) AND isfinite(value))"""
)


@query(
    "coerce_numbers",
    with_parts(
        [MEASUREMENTS], f"SELECT id, CASE WHEN isnan({SQL_NUMBER}) OR isinf({SQL_NUMBER}) THEN NULL ELSE {SQL_NUMBER} END AS written, isinf({SQL_NUMBER}) AS was_infinite FROM measurements"
    ),
)
def coerce_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Text to number; infinities are read as such and only then turned into missing values."""
    read = coerce_features(measurements(spark, folder).select("id", "written"), ["written"])
    infinite = F.abs("written") == F.lit(float("inf"))
    return read.select("id", F.when(~(F.isnan("written") | infinite), F.col("written")).alias("written"), infinite.alias("was_infinite"))


@query("coerce_clean", with_parts([CLEANED], "SELECT id, kind, written, unstable, value FROM cleaned"))
def coerce_clean(spark: SparkSession, folder: str) -> DataFrame:
    table_ = measurements(spark, folder).select("id", "kind", "written", "unstable", "value")
    return clean_features(table_, ["written", "unstable", "value"])


@query(
    "valid_mask",
    with_parts([MEASUREMENTS], "SELECT id, coalesce(isfinite(value) AND isfinite(unstable), false) AS is_valid FROM measurements"),
)
def valid_mask(spark: SparkSession, folder: str) -> DataFrame:
    return with_valid_flag(measurements(spark, folder), ["value", "unstable"]).select("id", "is_valid")


@query(
    "impute_constant",
    with_parts(
        [MEASUREMENTS],
        "SELECT id, CASE WHEN isfinite(unstable) THEN unstable ELSE CAST(-999 AS DOUBLE) END AS unstable, value FROM measurements",
    ),
)
def impute_constant_query(spark: SparkSession, folder: str) -> DataFrame:
    return impute_constant(measurements(spark, folder).select("id", "unstable", "value"), ["unstable"])


@query(
    "target_filter",
    with_parts([ORDERS], "SELECT id, total, returned FROM order_rows WHERE returned IS NOT NULL"),
)
def target_filter(spark: SparkSession, folder: str) -> DataFrame:
    return require_target(orders(spark, folder), "returned").select("id", "total", "returned")


@query(
    "id_like_columns",
    with_parts(
        [ORDERS],
        """SELECT 'id' AS "column", count(DISTINCT id) > 0.95 * count(*) AS is_id_like FROM order_rows
        UNION ALL SELECT 'label', count(DISTINCT label) > 0.95 * count(*) FROM order_rows
        UNION ALL SELECT 'state', count(DISTINCT state) > 0.95 * count(*) FROM order_rows""",
    ),
)
def id_like_query(spark: SparkSession, folder: str) -> DataFrame:
    names = ["id", "label", "state"]
    found = set(id_like_columns(orders(spark, folder), names))
    return small_table(
        spark, {"column": names, "is_id_like": [name in found for name in names]}, {"column": pa.string(), "is_id_like": pa.bool_()}
    )


# --- profiles ------------------------------------------------------------------------------------


def sql_missing_counts(source: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {place} AS place, '{name}' AS \"column\", count(*) FILTER ({name} IS NULL) AS missing, count(*) AS n FROM {source}"
        for place, name in enumerate(columns)
    )


@query(
    "missing_counts",
    with_parts(
        [ORDERS, f"counted AS ({sql_missing_counts('order_rows', [*ORDER_FEATURES, 'label'])})"],
        f'SELECT "column", missing, {sql_rounded("missing * CAST(100 AS DOUBLE) / n")} AS percent FROM counted WHERE missing > 0',
    ),
)
def missing_counts_query(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(missing_counts(orders(spark, folder), [*ORDER_FEATURES, "label"]), ["percent"])


SQL_INCLUSION = [
    f"counted AS ({sql_missing_counts('order_rows', MISSING_FEATURES)})",
    'major AS (SELECT "column" AS major FROM counted WHERE missing > 0 ORDER BY missing DESC, place LIMIT 1)',
    "flags AS (" + " UNION ALL ".join(f"SELECT id, '{name}' AS minor, {name} IS NULL AS gone FROM order_rows" for name in MISSING_FEATURES) + ")",
    "inclusion AS (SELECT major, a.minor, count(*) AS minor_missing, count(*) FILTER (NOT b.gone) AS mismatch "
    "FROM flags a, major, flags b WHERE a.gone AND a.id = b.id AND b.minor = major AND a.minor <> major GROUP BY 1, 2)",
]


@query(
    "missing_inclusion",
    with_parts([ORDERS, *SQL_INCLUSION], "SELECT major, minor, minor_missing, mismatch, mismatch = 0 AS is_subset FROM inclusion"),
)
def missing_inclusion_query(spark: SparkSession, folder: str) -> DataFrame:
    return missing_inclusion(orders(spark, folder), MISSING_FEATURES)


@query(
    "missing_patterns",
    with_parts(
        [ORDERS],
        "SELECT " + ", ".join(f"{name} IS NULL AS {name}" for name in MISSING_FEATURES) + ", count(*) AS rows FROM order_rows GROUP BY ALL",
    ),
)
def missing_patterns_query(spark: SparkSession, folder: str) -> DataFrame:
    return missing_patterns(orders(spark, folder), MISSING_FEATURES)


@query(
    "row_counts",
    with_parts(
        [ORDERS, "counted AS (SELECT count(*) AS n, count(*) FILTER (returned IS NOT NULL AND accepted IS NOT NULL AND pending IS NOT NULL) AS k FROM order_rows)"],
        f"SELECT n AS rows_before, k AS rows_kept, n - k AS rows_dropped, {sql_rounded('(n - k) * CAST(100 AS DOUBLE) / n')} AS percent_dropped FROM counted",
    ),
)
def row_counts_query(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(row_counts(orders(spark, folder), MISSING_FEATURES), ["percent_dropped"])


@query(
    "quality_report",
    with_parts(
        [
            MEASUREMENTS,
            "valid AS (SELECT count(*) FILTER (isfinite(value) AND isfinite(number) AND isfinite(unstable)) AS valid_rows FROM measurements)",
            "counted AS ("
            + " UNION ALL ".join(
                f"SELECT '{name}' AS feature, count(*) FILTER ({name} IS NULL OR isnan({name})) AS nans, "
                f"count(*) FILTER (isinf({name})) AS infs, count(*) AS n FROM measurements"
                for name in ("value", "number", "unstable")
            )
            + ")",
        ],
        f"""SELECT feature, nans, infs, nans + infs AS total_bad, {sql_rounded('(nans + infs) * CAST(100 AS DOUBLE) / n', 2)} AS percent_bad,
          valid_rows, {sql_rounded('valid_rows * CAST(100 AS DOUBLE) / n')} AS valid_percent FROM counted, valid""",
    ),
)
def quality_report_query(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(quality_report(measurements(spark, folder), ["value", "number", "unstable"]), ["percent_bad", "valid_percent"])


def sql_distribution(source: str, label: str, keep: str = "true") -> str:
    return (
        f"SELECT {label} AS label, count(*) AS rows, {sql_rounded('count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER ()')} AS percent "
        f"FROM {source} WHERE {label} IS NOT NULL AND {keep} GROUP BY 1"
    )


@query("class_distribution", with_parts([LINES], sql_distribution("lines", "flag")))
def class_distribution_query(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(class_distribution(lines(spark, folder), "flag"), ["percent"])


@query(
    "label_guess_top10",
    "SELECT l_suppkey AS label, count(*) AS rows, 'type' AS label_column FROM lineitem GROUP BY 1 ORDER BY rows DESC, label LIMIT 10",
)
def label_guess_top10(spark: SparkSession, folder: str) -> DataFrame:
    return top_labels(table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("type"), "l_tax"))


COMPLETE = " AND ".join(f"{name} IS NOT NULL" for name in MISSING_FEATURES)


@query(
    "contaminant_report",
    with_parts(
        [ORDERS, *SQL_INCLUSION, f"kinds AS ({sql_distribution('order_rows', 'state', COMPLETE)})"],
        f"""SELECT 'missing' AS section, "column" AS name, missing AS rows, {sql_rounded('missing * CAST(100 AS DOUBLE) / n')} AS percent FROM counted WHERE missing > 0
        UNION ALL SELECT 'inclusion', minor, mismatch, NULL FROM inclusion
        UNION ALL SELECT 'kept', 'rows', count(*) FILTER ({COMPLETE}), {sql_rounded(f'count(*) FILTER (NOT ({COMPLETE})) * CAST(100 AS DOUBLE) / count(*)')} FROM order_rows
        UNION ALL SELECT 'kinds', label, rows, percent FROM kinds""",
    ),
)
def contaminant_report_query(spark: SparkSession, folder: str) -> DataFrame:
    report = contaminant_report(orders(spark, folder), MISSING_FEATURES, label="state")
    nothing = F.lit(None).cast("double").alias("percent")
    return (
        report["missing"].select(F.lit("missing").alias("section"), F.col("column").alias("name"), F.col("missing").alias("rows"), rounded("percent").alias("percent"))
        .unionByName(report["inclusion"].select(F.lit("inclusion").alias("section"), F.col("minor").alias("name"), F.col("mismatch").alias("rows"), nothing))
        .unionByName(report["rows"].select(F.lit("kept").alias("section"), F.lit("rows").alias("name"), F.col("rows_kept").alias("rows"), rounded("percent_dropped").alias("percent")))
        .unionByName(report["kinds"].select(F.lit("kinds").alias("section"), F.col("label").alias("name"), "rows", rounded("percent").alias("percent")))
    )


@query(
    "prepare_training",
    with_parts(
        [ORDERS, "codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT label FROM order_rows WHERE " + COMPLETE + "))"],
        "SELECT id, label, code, " + ", ".join(ORDER_FEATURES) + f" FROM order_rows JOIN codes USING (label) WHERE {COMPLETE}",
    ),
)
def prepare_training_query(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_training(orders(spark, folder), ORDER_FEATURES, "label", "id").rows.select("id", "label", "code", *ORDER_FEATURES)


# --- scaling and codes ---------------------------------------------------------------------------


@query(
    "minmax_fit",
    with_parts([LINES], " UNION ALL ".join(f"SELECT '{name}' AS feature, min({name}) AS low, max({name}) AS high FROM lines" for name in LINE_FEATURES)),
)
def minmax_fit(spark: SparkSession, folder: str) -> DataFrame:
    return minmax_table(lines(spark, folder), LINE_FEATURES).withColumns({name: F.col(name) + F.lit(0.0) for name in ("low", "high")})


def sql_scaled(name: str, source: str) -> str:
    low, span = f"(SELECT min({name}) FROM {source})", f"(SELECT max({name}) - min({name}) FROM {source})"
    return f"({name} - {low}) / (CASE WHEN {span} = 0 THEN CAST(1 AS DOUBLE) ELSE {span} END)"


SCALED_MEASURES = ["value", "number", "user", "constant"]


@query(
    "minmax_transform",
    with_parts(
        [MEASUREMENTS],
        "SELECT id, " + ", ".join(f'{sql_rounded(sql_scaled(chr(34) + name + chr(34), "measurements"))} AS "{name}"' for name in SCALED_MEASURES) + " FROM measurements",
    ),
)
def minmax_transform(spark: SparkSession, folder: str) -> DataFrame:
    rows = measurements(spark, folder).select("id", *SCALED_MEASURES)
    return round_all(fit_minmax(rows, SCALED_MEASURES).transform(rows), SCALED_MEASURES)


@query(
    "minmax_inverse",
    with_parts([MEASUREMENTS], "SELECT id, " + ", ".join(f'{sql_rounded(chr(34) + name + chr(34), 4)} AS "{name}"' for name in SCALED_MEASURES) + " FROM measurements"),
)
def minmax_inverse(spark: SparkSession, folder: str) -> DataFrame:
    rows = measurements(spark, folder).select("id", *SCALED_MEASURES)
    scaler = fit_minmax(rows, SCALED_MEASURES)
    return round_all(scaler.inverse(scaler.transform(rows)), SCALED_MEASURES, 4)


@query("label_codes", "SELECT o_orderpriority AS label, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def label_codes(spark: SparkSession, folder: str) -> DataFrame:
    return label_table(table(spark, folder, "orders"), "o_orderpriority")


SQL_CODED = (
    "coded AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS label, "
    "CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders)"
)


def coded_orders(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("label"))
    return fit_labels(rows, "label").encode(rows, "label", "code")


@query("merge_rare", with_parts([SQL_CODED], "SELECT id, code, CASE WHEN code IN (2, 3, 4) THEN 2 ELSE code END AS merged, code IN (2, 3, 4) AS is_rare FROM coded"))
def merge_rare(spark: SparkSession, folder: str) -> DataFrame:
    return coded_orders(spark, folder).select(
        "id", "code", merged_code(F.col("code"), RARE_CODES).alias("merged"), is_rare(F.col("code")).alias("is_rare")
    )


@query(
    "decode_labels",
    with_parts([SQL_CODED], "SELECT id, CASE WHEN code = 4 THEN '99' ELSE label END AS decoded FROM coded"),
)
def decode_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A code that was never fitted is shown as its own text."""
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("label"))
    labels = fit_labels(rows, "label")
    coded = labels.encode(rows, "label", "code").withColumn("code", F.when(F.col("code") == 4, F.lit(99)).otherwise(F.col("code")))
    return coded.select("id", labels.decoded(F.col("code")).alias("decoded"))


@query(
    "factorize",
    with_parts(
        [
            MEASUREMENTS,
            "valued AS (SELECT event_id, CASE WHEN kind = 'error' THEN NULL ELSE \"user\" END AS member FROM measurements)",
            "firsts AS (SELECT member, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM valued WHERE member IS NOT NULL GROUP BY member)",
        ],
        "SELECT event_id, valued.member, coalesce(code, -1) AS code FROM valued LEFT JOIN firsts ON valued.member = firsts.member",
    ),
)
def factorize_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = measurements(spark, folder).select("event_id", F.when(F.col("kind") != "error", F.col("user")).alias("member"))
    return factorize(rows, "member", "event_id")
