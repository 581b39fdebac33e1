"""Registered queries over the business tables: quality, splits, preparation."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators import check_states, quality, ranking, sampling
from tallyfern.sources.readers import missing_tokens_to_null, normalise_columns, read_table
from tallyfern.sources.readers import filter_nonempty_text, rename_project
from tallyfern.sources.session import shared_folder

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
SEED = 42

# Keys of the tables whose queries are heavy enough to spread a small file.
KEYS = {
    "documents": "doc_id",
    "embeddings": "vec_id",
    "events": "event_id",
    "lineitem": "l_orderkey",
    "orders": "o_orderkey",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", KEYS.get(name))


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing and malformed cells, as raw files have them."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", None)
        .otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("n/a"))
        .otherwise((F.col("o_custkey") - 200).cast("string"))
        .alias("amount"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.date_format("o_orderdate", "yyyy-M-d"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("placed_on"),
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        "o_custkey",
    )


_GAPS_SQL = """
gaps AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a'
              ELSE CAST(o_custkey - 200 AS VARCHAR) END AS amount,
         CASE WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%Y-%-m-%-d')
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS placed_on,
         nullif(o_orderstatus, 'P') AS o_orderstatus, o_custkey
  FROM orders
)"""


def _flat(records: DataFrame) -> DataFrame:
    return records.select("dataset", "check", "passed", "failures", F.to_json("details").alias("details"))


def quality_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        quality.required_columns(["o_orderkey", "o_orderpriority", "channel"]),
        quality.no_duplicate_ids("o_custkey"),
        quality.no_duplicate_ids("o_orderstatus"),
        quality.numeric_range("amount", 0, 1000, "amount_range"),
        quality.allowed_values("o_orderpriority", PRIORITIES, "priority_values"),
        quality.nonnegative("amount", "amount_sign"),
        quality.parseable_date("placed_on", check="placed_on_dates"),
        quality.nonempty_text("comment", "comment_text"),
    ]
    return _flat(quality.run_checks(with_gaps(spark, sf_dir), "orders", rules)).drop("details")


def quality_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of orders, checked as they were appended, period by period."""
    rules = [
        quality.required_columns(["o_orderkey", "o_orderpriority", "channel"]),
        quality.no_duplicate_ids("o_custkey"),
        replace(quality.no_duplicate_ids("o_orderstatus"), check="status_ids"),
        quality.numeric_range("amount", 0, 1000, "amount_range"),
        quality.allowed_values("o_orderpriority", PRIORITIES, "priority_values"),
        quality.nonnegative("amount", "amount_sign"),
        quality.parseable_date("placed_on", check="placed_on_dates"),
        quality.nonempty_text("comment", "comment_text"),
    ]
    base = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    rows, year = with_gaps(spark, sf_dir), F.substring("placed_on", 1, 4)
    periods = {
        "early": year < "1994",
        "middle": (year >= "1994") & (year < "1997"),
        "late": year.isNull() | (year >= "1997"),
    }
    for name, period in periods.items():
        check_states.append_state(rows.where(period), rules, base, name)
    records = check_states.state_records(check_states.stored_states(spark, base), "orders", rules)
    return records.select(
        "dataset", "check", "passed", "failures", F.col("details")["unexpected_distinct"].alias("unexpected")
    )


def quality_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [quality.allowed_values("o_orderpriority", PRIORITIES, "priority_values")]
    records = quality.run_checks(with_gaps(spark, sf_dir), "orders", rules)
    return records.select(
        "check",
        F.col("details")["null_count"].alias("null_count"),
        F.col("details")["invalid_value_count"].alias("invalid_value_count"),
        F.col("details")["unexpected_distinct"].alias("unexpected_distinct"),
    )


def unexpected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unexpected_values(with_gaps(spark, sf_dir), "o_orderpriority", PRIORITIES)


def quality_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        quality.required_columns(["doc_id", "text", "lang", "source"]),
        quality.no_duplicate_ids("doc_id"),
        quality.no_duplicate_ids("text"),
        quality.nonempty_text("text", "nonempty_text"),
        quality.allowed_values("lang", ("en", "fr", "de"), "lang_values"),
    ]
    records = quality.run_checks(table(spark, sf_dir, "documents"), "documents", rules)
    return _flat(records).drop("details")


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = quality_orders(spark, sf_dir).unionByName(quality_documents(spark, sf_dir))
    return quality.summary(records)


def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.nullif("l_quantity", F.lit(10.0)).alias("l_quantity"),
        "l_discount",
    )
    errors = quality.record_errors(
        ["l_quantity", "l_discount"], {"l_quantity": (5, 45), "l_discount": (0.02, None)}
    )
    return lines.groupBy(F.to_json(errors).alias("errors")).agg(F.count(F.lit(1)).alias("n_rows"))


def question_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("turn").alias("top_k")
    )
    return asked.select(
        "conv_id", "turn", F.to_json(quality.question_errors()).alias("errors")
    )


def nonempty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = {"doc_id": "complaint_id", "lang": "product", "text": "complaint_narrative"}
    docs = table(spark, sf_dir, "documents")
    blank = docs.where("doc_id % 5 = 0").withColumn("text", F.lit(" \t\n"))
    docs = docs.unionByName(blank)
    kept = filter_nonempty_text(rename_project(docs, mapping), "complaint_narrative")
    return kept.groupBy("product").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.length("complaint_narrative")).alias("n_chars"),
    )


def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(" Part.Key"),
        F.nullif("p_type", F.lit("ECONOMY")).alias("Part Type "),
        F.when(F.col("p_size") == 1, F.lit("N/A")).otherwise(F.col("p_name")).alias("P.Name"),
    )
    return missing_tokens_to_null(normalise_columns(raw))


def sample_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sampling.sample_n(orders, 5_000, SEED, ["o_orderkey"])


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    marked = sampling.mark_test_rows(orders, "o_orderpriority", ["o_orderkey"], 0.2, SEED)
    return marked.select(
        "o_orderkey",
        "o_orderpriority",
        F.when(F.col("is_test"), "test").otherwise("train").alias("part"),
    )


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag")
    return sampling.class_weights(lines, "l_returnflag").select(
        "l_returnflag", "n_rows", F.round("weight", 6).alias("weight")
    )


def reference_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_gaps(spark, sf_dir).select("o_orderkey", "o_orderpriority", "amount")
    return sampling.first_n(rows, 2_000, ["o_orderpriority"], ["o_orderkey"])


def exact_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.nullif("l_quantity", F.lit(10.0)).alias("l_quantity"), "l_extendedprice", "l_discount"
    )
    return ranking.exact_medians(lines, lines.columns)


_QUALITY_SQL = f"""WITH {_GAPS_SQL},
numbers AS (SELECT *, TRY_CAST(amount AS DOUBLE) AS x FROM gaps)
SELECT 'orders' AS dataset, "check", failures = 0 AS passed, failures FROM (
  SELECT 'required_columns' AS "check", CAST(1 AS BIGINT) AS failures
  UNION ALL SELECT 'comment_text', 1
  UNION ALL SELECT 'no_duplicate_ids', CAST(sum(n - 1) AS BIGINT)
    FROM (SELECT count(*) AS n FROM gaps GROUP BY o_custkey)
  UNION ALL SELECT 'no_duplicate_ids', CAST(sum(n - 1) AS BIGINT)
    FROM (SELECT count(*) AS n FROM gaps GROUP BY o_orderstatus)
  UNION ALL SELECT 'amount_range', count(*) FROM numbers WHERE x IS NULL OR x < 0 OR x > 1000
  UNION ALL SELECT 'amount_sign', count(*) FROM numbers WHERE x IS NULL OR x < 0
  UNION ALL SELECT 'priority_values', count(*) FROM gaps
    WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN {PRIORITIES}
  UNION ALL SELECT 'placed_on_dates', count(*) FROM gaps
    WHERE NOT regexp_full_match(placed_on, '\\d{{4}}-\\d{{2}}-\\d{{2}}')
)"""
_QUALITY_DOCUMENTS_SQL = """
SELECT 'documents' AS dataset, "check", failures = 0 AS passed, failures FROM (
  SELECT 'required_columns' AS "check", CAST(0 AS BIGINT) AS failures
  UNION ALL SELECT 'no_duplicate_ids', count(*) - count(DISTINCT doc_id) FROM documents
  UNION ALL SELECT 'no_duplicate_ids', count(*) - count(DISTINCT text) FROM documents
  UNION ALL SELECT 'nonempty_text', count(*) FROM documents WHERE trim(text) = ''
  UNION ALL SELECT 'lang_values', count(*) FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
)"""

QUERIES = {
    "quality_orders": quality_orders,
    "quality_appended": quality_appended,
    "quality_details": quality_details,
    "unexpected_values": unexpected_values,
    "quality_documents": quality_documents,
    "quality_summary": quality_summary,
    "record_errors": record_errors,
    "question_errors": question_errors,
    "nonempty_documents": nonempty_documents,
    "normalised_names": normalised_names,
    "sample_md5": sample_md5,
    "stratified_split": stratified_split,
    "class_weights": class_weights,
    "reference_window": reference_window,
    "exact_medians": exact_medians,
}

ORACLES = {
    "quality_orders": _QUALITY_SQL,
    "quality_appended": f"""WITH {_GAPS_SQL}, whole AS ({_QUALITY_SQL}),
ids AS (SELECT CAST(sum(n - 1) AS BIGINT) AS extra FROM (SELECT count(*) AS n FROM gaps GROUP BY o_custkey)),
states AS (SELECT CAST(sum(n - 1) AS BIGINT) AS extra FROM (SELECT count(*) AS n FROM gaps GROUP BY o_orderstatus)),
records AS (
  SELECT * FROM whole WHERE "check" <> 'no_duplicate_ids'
  UNION ALL SELECT 'orders', 'no_duplicate_ids', extra = 0, extra FROM ids
  UNION ALL SELECT 'orders', 'status_ids', extra = 0, extra FROM states)
SELECT *, CASE WHEN "check" = 'priority_values' THEN
    (SELECT CAST(count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority NOT IN {PRIORITIES}) AS VARCHAR)
     FROM gaps) END AS unexpected FROM records""",
    "quality_documents": _QUALITY_DOCUMENTS_SQL,
    "quality_summary": f"""
SELECT dataset, bool_and(passed) AS passed, count(*) AS n_checks,
       count(*) FILTER (WHERE NOT passed) AS n_failed
FROM (SELECT * FROM ({_QUALITY_SQL}) UNION ALL SELECT * FROM ({_QUALITY_DOCUMENTS_SQL}))
GROUP BY dataset""",
    "quality_details": f"""WITH {_GAPS_SQL}
SELECT 'priority_values' AS "check",
       CAST(count(*) FILTER (WHERE o_orderpriority IS NULL) AS VARCHAR) AS null_count,
       CAST(count(*) FILTER (WHERE o_orderpriority NOT IN {PRIORITIES}) AS VARCHAR)
         AS invalid_value_count,
       CAST(count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority NOT IN {PRIORITIES})
            AS VARCHAR) AS unexpected_distinct
FROM gaps""",
    "unexpected_values": f"""WITH {_GAPS_SQL}
SELECT o_orderpriority AS value, count(*) AS n_rows FROM gaps
WHERE o_orderpriority NOT IN {PRIORITIES} GROUP BY 1""",
    "record_errors": """
SELECT errors, count(*) AS n_rows FROM (
  SELECT '[' || concat_ws(',',
    CASE WHEN q IS NULL THEN '"l_quantity is missing"' END,
    CASE WHEN q < 5 THEN '"l_quantity is below 5"' END,
    CASE WHEN q > 45 THEN '"l_quantity is above 45"' END,
    CASE WHEN d < 0.02::DOUBLE THEN '"l_discount is below 0.02"' END) || ']' AS errors
  FROM (SELECT nullif(l_quantity, 10.0) AS q, l_discount AS d FROM lineitem)
) GROUP BY errors""",
    "question_errors": """
SELECT conv_id, turn, '[' || concat_ws(',',
    CASE WHEN length(text) < 3 THEN '"question length is below 3"' END,
    CASE WHEN length(text) > 1000 THEN '"question length is above 1000"' END,
    CASE WHEN turn < 1 THEN '"top_k is below 1"' END,
    CASE WHEN turn > 20 THEN '"top_k is above 20"' END) || ']' AS errors
FROM conversations""",
    "nonempty_documents": """
SELECT lang AS product, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents WHERE trim(text) <> '' GROUP BY lang""",
    "normalised_names": """
SELECT p_partkey AS part_key, nullif(p_type, 'ECONOMY') AS part_type,
       CASE WHEN p_size = 1 THEN NULL ELSE p_name END AS p_name FROM part""",
    "sample_md5": f"""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey LIMIT 5000""",
    "stratified_split": f"""
SELECT o_orderkey, o_orderpriority,
       CASE WHEN r <= floor(0.2::DOUBLE * n + 0.5) THEN 'test' ELSE 'train' END AS part
FROM (SELECT o_orderkey, o_orderpriority,
             row_number() OVER (PARTITION BY o_orderpriority
                                ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey) AS r,
             count(*) OVER (PARTITION BY o_orderpriority) AS n
      FROM orders)""",
    "class_weights": """
SELECT l_returnflag, n_rows,
       round(sum(n_rows) OVER () / (count(*) OVER () * n_rows), 6)::DOUBLE AS weight
FROM (SELECT l_returnflag, count(*) AS n_rows FROM lineitem GROUP BY 1)""",
    "reference_window": f"""WITH {_GAPS_SQL}
SELECT o_orderkey, o_orderpriority, amount FROM gaps
WHERE o_orderpriority IS NOT NULL ORDER BY o_orderkey LIMIT 2000""",
    "exact_medians": """
SELECT 'l_quantity' AS "column", median(nullif(l_quantity, 10.0)) AS median FROM lineitem
UNION ALL SELECT 'l_extendedprice', median(l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_discount', median(l_discount) FROM lineitem""",
}
