"""Usage and service monitoring over an event table.

An event row is ``timestamp, event_type, payload`` with the payload as JSON.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.sources.paths import child_names

# Event types, their payload fields and the preview length.
PREDICTION = "ml_prediction"
RAG_QUERY = "rag_query"
QUERY_PREVIEW = 60
PREDICTION_FIELDS = {"probability": "double", "prediction": "int", "latency_ms": "double"}
RAG_FIELDS = {
    "query": "string",
    "query_preview": "string",
    "n_results": "int",
    "refused": "boolean",
    "avg_similarity": "double",
    "latency_ms": "double",
    "prompt_tokens": "int",
    "completion_tokens": "int",
    "total_tokens": "int",
}


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def to_events(
    rows: DataFrame, event_type: str, fields: Sequence[str], timestamp: Column | None = None
) -> DataFrame:
    """Rows as events whose payload holds ``fields``, stamped now by default."""
    return rows.select(
        (F.current_timestamp() if timestamp is None else timestamp).alias("timestamp"),
        F.lit(event_type).alias("event_type"),
        F.to_json(F.struct(*fields)).alias("payload"),
    )


def prediction_events(scored: DataFrame, timestamp: Column | None = None) -> DataFrame:
    return to_events(scored, PREDICTION, list(PREDICTION_FIELDS), timestamp)


def event_features(events: DataFrame) -> DataFrame:
    """Query rows with the mean of their similarities (0 for none) and an
    empty-retrieval flag."""
    found = F.size("similarities")
    total = F.aggregate("similarities", F.lit(0.0), lambda s, x: s + x)
    return events.withColumn(
        "avg_similarity", F.when(found > 0, total / found).otherwise(F.lit(0.0))
    ).withColumn("empty_retrieval", F.col("n_results") == 0)


def rag_events(queries: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Query rows (``query, n_results, refused, similarities, latency_ms,
    token_usage``) as events; missing token counts are 0."""
    tokens = {
        t: F.coalesce(F.col(f"token_usage.{t}"), F.lit(0))
        for t in ("prompt_tokens", "completion_tokens", "total_tokens")
    }
    preview = F.substring("query", 1, QUERY_PREVIEW)
    flat = event_features(queries).withColumns({"query_preview": preview, **tokens})
    return to_events(flat, RAG_QUERY, list(RAG_FIELDS), timestamp)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def parsed(events: DataFrame, event_type: str, fields: dict[str, str]) -> DataFrame:
    """Events of one type with typed payload columns."""
    schema = ", ".join(f"{name} {kind}" for name, kind in fields.items())
    return (
        events.where(F.col("event_type") == event_type)
        .withColumn("_payload", F.from_json("payload", schema))
        .select("timestamp", *[F.col(f"_payload.{name}").alias(name) for name in fields])
    )


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


def event_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total_events"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("probability"), 4).alias("avg_probability"),
        F.round(F.avg("prediction"), 4).alias("positive_rate"),
        F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"),
    )


def _refusal_columns() -> dict[str, Column]:
    refused = F.count_if(F.coalesce(F.col("refused"), F.lit(False)))
    n = F.count(F.lit(1))
    return {
        "hit_rate": F.round(_ratio(n - refused, n), 4),
        "refusal_rate": F.round(_ratio(refused, n), 4),
        "refused_count": refused,
        "empty_retrieval_count": F.count_if(F.coalesce(F.col("n_results") == 0, F.lit(False))),
    }


def rag_log_summary(queries: DataFrame) -> DataFrame:
    """Log summary; the mean similarity covers events with a positive one."""
    shared = _refusal_columns()
    shared.pop("refused_count")
    positive = F.when(F.col("avg_similarity") > 0, F.col("avg_similarity"))
    return queries.agg(
        F.count(F.lit(1)).alias("count"),
        *[v.alias(k) for k, v in shared.items()],
        F.round(F.coalesce(F.avg(positive), F.lit(0.0)), 4).alias("avg_top_k_similarity"),
        F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"),
        F.round(F.avg(F.coalesce("total_tokens", F.lit(0))), 1).alias("avg_token_usage"),
    )


def rag_monitor_summary(queries: DataFrame) -> DataFrame:
    """Monitor summary over query rows; the mean similarity covers events with
    a non-empty list."""
    tokens = F.coalesce(F.col("token_usage.total_tokens"), F.lit(0))
    listed = F.when(F.size("similarities") > 0, F.col("avg_similarity"))
    return event_features(queries).agg(
        F.count(F.lit(1)).alias("total_queries"),
        *[v.alias(k) for k, v in _refusal_columns().items()],
        F.round(F.coalesce(F.avg(listed), F.lit(0.0)), 4).alias("avg_top_k_similarity"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 3).alias("avg_latency_ms"),
        F.round(F.coalesce(F.avg(tokens), F.lit(0.0)), 1).alias("avg_token_usage"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens_used"),
    )


def request_metrics(requests: DataFrame) -> DataFrame:
    """``latency_ms, error`` rows: volume, errors, error rate, mean latency."""
    n, errors = F.count(F.lit(1)), F.count_if("error")
    return requests.agg(
        n.alias("total_requests"),
        errors.alias("error_count"),
        F.round(_ratio(errors, n), 6).alias("error_rate"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 3).alias("avg_latency_ms"),
    )


def prediction_distribution(predictions: DataFrame) -> DataFrame:
    n, positive = F.count(F.lit(1)), F.count_if(F.col("prediction") == 1)
    return predictions.agg(
        n.alias("total_predictions"),
        positive.alias("positive_predictions"),
        (n - positive).alias("negative_predictions"),
        F.round(_ratio(positive, n), 6).alias("positive_rate"),
    )


def rag_request_stats(queries: DataFrame) -> DataFrame:
    """``refused, n_evidence_ids`` rows: volume, refusals, mean evidence ids."""
    n, refused = F.count(F.lit(1)), F.count_if("refused")
    return queries.agg(
        n.alias("total_queries"),
        refused.alias("refused_queries"),
        F.round(_ratio(refused, n), 6).alias("refusal_rate"),
        F.round(F.coalesce(F.avg("n_evidence_ids"), F.lit(0.0)), 3).alias(
            "avg_evidence_ids_per_query"
        ),
    )


def metric_table(*summaries: DataFrame) -> DataFrame:
    """Two-column ``metric, value`` view of one-row summaries."""
    parts = []
    for summary in summaries:
        cells = F.array(
            *[
                F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                for c in summary.columns
            ]
        )
        parts.append(summary.select(F.inline(cells)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def snapshot_summary(events: DataFrame) -> DataFrame:
    """``section, metric, value`` of all events: counts by type, the summaries of
    predictions and of questions."""
    counts = events_by_type(events).select(
        F.lit("events").alias("section"),
        F.col("event_type").alias("metric"),
        F.col("n_events").cast("double").alias("value"),
    )
    predictions = prediction_summary(parsed(events, PREDICTION, PREDICTION_FIELDS))
    questions = rag_log_summary(parsed(events, RAG_QUERY, RAG_FIELDS))
    for section, summary in ((PREDICTION, predictions), (RAG_QUERY, questions)):
        counts = counts.unionByName(
            metric_table(summary).select(F.lit(section).alias("section"), "metric", "value")
        )
    return counts


def snapshot(events: DataFrame, folder: str, since: datetime | None = None) -> datetime:
    """Append the events later than ``since`` and the summary of all of them, both
    stamped with one time fixed here; returns it, the ``since`` of the next call."""
    now = datetime.now(timezone.utc)
    stamp = F.lit(now.isoformat(sep=" ")).cast("timestamp")
    new = events.where(F.col("timestamp") <= stamp)
    if since is not None:
        new = new.where(F.col("timestamp") > F.lit(since.isoformat(sep=" ")).cast("timestamp"))
    new.withColumn("generated_at", stamp).write.mode("append").parquet(f"{folder}/events")
    summary = snapshot_summary(events).withColumn("generated_at", stamp)
    summary.write.mode("append").parquet(f"{folder}/summary")
    return now


def new_log(spark: SparkSession, base: str) -> str:
    """A fresh, empty log folder below ``base``: the reset of an append-only log, which
    leaves what was written before where it is."""
    number = 1 + max((int(n[4:]) for n in child_names(spark, base) if n[4:].isdigit()), default=-1)
    return f"{base}/log-{number:06d}"
