"""Registered queries for suites, logs and jobs whose results are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators import encoding, gate, quality, retrieval, telemetry
from tallyfern.operators.chunking import chunk_table, chunks_per_group
from tallyfern.plans import ask_queries, monitor_queries, pipelines, stream_queries
from tallyfern.plans.table_queries import table
from tallyfern.plans.text_queries import CHUNKS_SQL, DOCUMENT_COLUMNS
from tallyfern.sources.session import shared_folder
from tallyfern.sources.tables import read_index
from tallyfern.streaming import streams

BANK_STAND_INS = {
    "age": "CAST(l_quantity AS INT) + 10",
    "duration": "l_extendedprice - 10000",
    "y": "CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'no' ELSE l_linestatus END",
}


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def bank_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items under the bank table's column names."""
    others = [c for c in quality.BANK_COLUMNS if c not in BANK_STAND_INS]
    return table(spark, sf_dir, "lineitem").select(
        *[F.expr(e).alias(c) for c, e in BANK_STAND_INS.items()],
        *[F.lit("x").alias(c) for c in others],
    )


def complaint_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under the complaint table's column names; every fourth date is none."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("complaint_id"),
        F.col("lang").alias("product"),
        F.col("source").alias("issue"),
        F.col("source").alias("company"),
        F.when(F.col("doc_id") % 4 == 0, "2023-02-30").otherwise("2023-02-28").alias("date_received"),
        F.col("text").alias("complaint_narrative"),
    )


def quality_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = pipelines.check_quality(
        bank_stand_in(spark, sf_dir), complaint_stand_in(spark, sf_dir)
    )
    return records.select("dataset", "check", "passed", "failures")


def suite_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(
        quality.run_quality(bank_stand_in(spark, sf_dir), complaint_stand_in(spark, sf_dir))
    )


def gate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's decision logged for two runs, and the log read back."""
    place = _place(spark, "gate")
    measured = monitor_queries.metrics_labels(spark, sf_dir)
    for run in ("first", "second"):
        gate.gate_and_log(measured, "steps", "length", place, {"run": run})
    return spark.read.parquet(place).select(
        F.col("run_metadata")["run"].alias("run"), "promoted", "pr_auc_delta", "f1_delta"
    )


def drift_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift job's column log, read back."""
    place = _place(spark, "drift")
    reference, current = monitor_queries.sides(spark, sf_dir)
    pipelines.run_drift(
        reference, current, monitor_queries.NUMERIC, monitor_queries.CATEGORICAL, place
    )
    return spark.read.parquet(f"{place}/columns").select(
        "column", "stattest", "drift_score", "drift_detected"
    )


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = monitor_queries.prediction_log(spark, sf_dir)
    logged = telemetry.prediction_events(predictions, F.col("timestamp"))
    return logged.unionByName(
        telemetry.rag_events(monitor_queries.query_log(spark, sf_dir), F.col("timestamp"))
    )


def event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.event_count(_event_log(spark, sf_dir))


def event_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and means of a snapshot, read back from its folder."""
    place = _place(spark, "snapshot")
    telemetry.snapshot(_event_log(spark, sf_dir), place)
    wanted = ("count", "avg_probability", "positive_rate", "refusal_rate", "empty_retrieval_count")
    summary = spark.read.parquet(f"{place}/summary")
    kept = (F.col("section") == "events") | F.col("metric").isin(*wanted)
    return summary.where(kept).select("section", "metric", "value")


def built_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index job run twice over the same documents, and the index read back."""
    place = _place(spark, "index")
    docs = table(spark, sf_dir, "documents")
    for _ in range(2):
        pipelines.build_index(docs, f"{place}/index", f"{place}/model", "text", DOCUMENT_COLUMNS)
    return chunks_per_group(read_index(spark, f"{place}/index"), "product")


def stream_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to an index that a stream has chunked and encoded."""
    place = _place(spark, "stream")
    docs = table(spark, sf_dir, "documents")
    encoder, _ = encoding.fit_and_encode(chunk_table(docs, "text", DOCUMENT_COLUMNS))
    arriving = stream_queries.stream_of(spark, sf_dir, "documents")
    streams.index_stream(
        arriving, f"{place}/index", f"{place}/log", "text", DOCUMENT_COLUMNS, encoder
    ).awaitTermination()
    asked = ask_queries.questions(spark, sf_dir).withColumnRenamed("question", "text")
    encoded = encoding.encode(asked, encoder).withColumnRenamed("text", "question")
    found = retrieval.retrieve(read_index(spark, f"{place}/index"), encoded)
    return found.select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


QUERIES = {
    "quality_suites": quality_suites,
    "suite_verdicts": suite_verdicts,
    "gate_log": gate_log,
    "drift_log": drift_log,
    "event_count": event_count,
    "event_snapshot": event_snapshot,
    "built_index": built_index,
    "stream_ask": stream_ask,
}

_SUITES_SQL = f"""
bank AS (SELECT {", ".join(f"{e} AS {c}" for c, e in BANK_STAND_INS.items())} FROM lineitem),
counts AS (
  SELECT 'bank_marketing' AS dataset, 'required_columns' AS "check", 0 AS failures
  UNION ALL SELECT 'bank_marketing', 'age_range', count(*) FILTER (WHERE age < 18 OR age > 100) FROM bank
  UNION ALL SELECT 'bank_marketing', 'target_column', count(*) FILTER (WHERE y NOT IN ('yes', 'no')) FROM bank
  UNION ALL SELECT 'bank_marketing', 'duration_values', count(*) FILTER (WHERE duration < 0) FROM bank
  UNION ALL SELECT '{quality.COMPLAINT_DATASET}', 'required_columns', 0
  UNION ALL SELECT '{quality.COMPLAINT_DATASET}', 'no_duplicate_ids', count(*) - count(DISTINCT doc_id) FROM documents
  UNION ALL SELECT '{quality.COMPLAINT_DATASET}', 'nonempty_complaints', count(*) FILTER (WHERE trim(text) = '')
    FROM documents
  UNION ALL SELECT '{quality.COMPLAINT_DATASET}', 'complaint_dates', count(*) FILTER (WHERE doc_id % 4 = 0)
    FROM documents
)"""

ORACLES = {
    "quality_suites": f"""WITH {_SUITES_SQL}
SELECT dataset, "check", failures = 0 AS passed, failures FROM counts""",
    "suite_verdicts": f"""WITH {_SUITES_SQL}
SELECT dataset, bool_and(failures = 0) AS passed, count(*) AS n_checks,
       count(*) FILTER (WHERE failures > 0) AS n_failed FROM counts GROUP BY dataset""",
    "gate_log": f"""SELECT run, promoted, pr_auc_delta, f1_delta
FROM ({monitor_queries.ORACLES["promotion_gate"]}), (VALUES ('first'), ('second')) AS runs(run)""",
    "drift_log": monitor_queries.ORACLES["drift_columns"],
    "event_count": """
SELECT count(*) AS total_events FROM events WHERE event_type IN ('purchase', 'signup', 'view', 'click')""",
    "event_snapshot": f"""WITH {monitor_queries.EVENTS_SQL}
SELECT 'events' AS section, '{telemetry.PREDICTION}' AS metric, count(*)::DOUBLE AS value FROM predictions
UNION ALL SELECT 'events', '{telemetry.RAG_QUERY}', count(*) FROM queries
UNION ALL SELECT '{telemetry.PREDICTION}', 'count', count(*) FROM predictions
UNION ALL SELECT '{telemetry.PREDICTION}', 'avg_probability', round(avg(probability), 4) FROM predictions
UNION ALL SELECT '{telemetry.PREDICTION}', 'positive_rate', round(avg(prediction), 4) FROM predictions
UNION ALL SELECT '{telemetry.RAG_QUERY}', 'count', count(*) FROM queries
UNION ALL SELECT '{telemetry.RAG_QUERY}', 'refusal_rate',
                 round(count(*) FILTER (WHERE refused) / count(*)::DOUBLE, 4) FROM queries
UNION ALL SELECT '{telemetry.RAG_QUERY}', 'empty_retrieval_count',
                 count(*) FILTER (WHERE n_results = 0) FROM queries""",
    "built_index": f"""WITH {CHUNKS_SQL}
SELECT product, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM chunks GROUP BY product""",
    "stream_ask": f"""WITH {ask_queries.found_sql(retrieval.REFUSAL_DISTANCE)}
SELECT query_id, rank, chunk_id, round(distance, 6) AS distance FROM found""",
}
