"""Registered queries that run as streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators.chunking import chunk_table, chunks_per_group
from tallyfern.plans.table_queries import table
from tallyfern.plans.text_queries import CHUNKS_SQL, DOCUMENT_COLUMNS
from tallyfern.sources.paths import is_folder
from tallyfern.sources.session import shared_folder
from tallyfern.sources.tables import read_index, upsert_version
from tallyfern.streaming import streams


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, stored as one file or as a folder of files of any name."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if is_folder(spark, path):
        return streams.read_stream(spark, path, schema, "*")
    return streams.read_stream(spark, sf_dir, schema, f"{name}.parquet")


def _workplace(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_of(spark, sf_dir, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _workplace(spark)
    counts = streams.running_event_counts(_events(spark, sf_dir))
    streams.to_table(counts, f"{place}/out", f"{place}/log", "complete").awaitTermination()
    return read_index(spark, f"{place}/out", None)


def stream_request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _workplace(spark)
    requests = _events(spark, sf_dir).select(
        F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("error")
    )
    totals = streams.running_request_metrics(requests)
    streams.to_table(totals, f"{place}/out", f"{place}/log", "complete").awaitTermination()
    return read_index(spark, f"{place}/out", None)


def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _workplace(spark)
    counts = streams.hourly_event_counts(_events(spark, sf_dir))
    streams.to_table(counts, f"{place}/out", f"{place}/log").awaitTermination()
    return spark.read.parquet(f"{place}/out").withColumn(
        "hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss")
    )


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _workplace(spark)
    arriving = stream_of(spark, sf_dir, "documents")
    streams.index_stream(
        arriving, f"{place}/index", f"{place}/log", "text", DOCUMENT_COLUMNS
    ).awaitTermination()
    return chunks_per_group(read_index(spark, f"{place}/index"), "product")


def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index built in batch, edited by an upsert and fed by a stream."""
    place = _workplace(spark)
    base, documents = f"{place}/index", table(spark, sf_dir, "documents")
    upsert_version(chunk_table(documents.where("doc_id % 3 = 0"), "text", DOCUMENT_COLUMNS), base)
    edited = documents.where("doc_id % 6 = 0").withColumn("lang", F.lit("edited"))
    upsert_version(chunk_table(edited, "text", DOCUMENT_COLUMNS), base)
    arriving = stream_of(spark, sf_dir, "documents").where("doc_id % 3 > 0")
    streams.index_stream(arriving, base, f"{place}/log", "text", DOCUMENT_COLUMNS).awaitTermination()
    return chunks_per_group(read_index(spark, base), "product")


QUERIES = {
    "index_versions": index_versions,
    "stream_event_counts": stream_event_counts,
    "stream_request_metrics": stream_request_metrics,
    "stream_hourly_counts": stream_hourly_counts,
    "stream_index": stream_index,
}

ORACLES = {
    "stream_event_counts": "SELECT event_type, count(*) AS n_events FROM events GROUP BY 1",
    "stream_request_metrics": """
SELECT count(*) AS total_requests, count(*) FILTER (WHERE event_type = 'error') AS error_count,
       round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate,
       round(avg(value), 3) AS avg_latency_ms FROM events""",
    # Hours the watermark (ten minutes behind the newest event) has closed.
    "stream_hourly_counts": """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type,
       count(*) AS n_events FROM events GROUP BY date_trunc('hour', ts), event_type
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR
       <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
    "index_versions": f"""WITH {CHUNKS_SQL}
SELECT CASE WHEN CAST(complaint_id AS BIGINT) % 6 = 0 THEN 'edited' ELSE product END AS product,
       count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM chunks GROUP BY 1""",
    "stream_index": f"""WITH {CHUNKS_SQL}
SELECT product, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM chunks GROUP BY product""",
}
