"""Registered queries for evaluation, promotion, drift and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators import drift, gate, metrics, telemetry
from tallyfern.plans.table_queries import table

DRIFT_DATE = "1997-01-01"
NUMERIC = ("o_totalprice", "month")
CATEGORICAL = ("o_orderpriority", "o_orderstatus")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents under two fixed scores of their length."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    first = F.expr("(n_chars div 7) % 1000 / 1000D")
    second = F.expr("least(n_chars div 4, 1000) / 1000D")
    models = F.array(
        F.struct(F.lit("steps").alias("model"), first.alias("probability")),
        F.struct(F.lit("length").alias("model"), second.alias("probability")),
    )
    return labels.join(docs, "doc_id").select("doc_id", "label", F.inline(models))


_SCORED_SQL = """
scored AS (
  SELECT l.quality AS label, 'steps' AS model, (n_chars // 7) % 1000 / 1000::DOUBLE AS p
  FROM labels l JOIN documents d USING (doc_id)
  UNION ALL
  SELECT l.quality, 'length', least(n_chars // 4, 1000) / 1000::DOUBLE
  FROM labels l JOIN documents d USING (doc_id)
), steps AS (
  SELECT model, p, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY model, p
), running AS (
  SELECT *, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg FROM steps
  WINDOW w AS (PARTITION BY model ORDER BY p DESC)
), totals AS (
  SELECT model, sum(pos) AS np, sum(neg) AS nn,
         sum(neg * (cpos - pos / 2.0::DOUBLE)) AS ordered,
         sum(pos * cpos / (cpos + cneg)::DOUBLE) AS stepsum,
         sum(pos * (p - 1) ** 2 + neg * p ** 2) AS squares,
         CAST(coalesce(sum(neg) FILTER (WHERE p < 0.5), 0) AS BIGINT) AS true_negatives,
         CAST(coalesce(sum(neg) FILTER (WHERE p >= 0.5), 0) AS BIGINT) AS false_positives,
         CAST(coalesce(sum(pos) FILTER (WHERE p < 0.5), 0) AS BIGINT) AS false_negatives,
         CAST(coalesce(sum(pos) FILTER (WHERE p >= 0.5), 0) AS BIGINT) AS true_positives
  FROM running GROUP BY model
), metrics AS (
  SELECT model,
         round(ordered / (np * nn)::DOUBLE, 6) AS roc_auc,
         round(stepsum / np::DOUBLE, 6) AS pr_auc,
         round(2 * true_positives / (2 * true_positives + false_positives + false_negatives)::DOUBLE, 6) AS f1,
         round(true_positives / (true_positives + false_positives)::DOUBLE, 6) AS precision,
         round(true_positives / (true_positives + false_negatives)::DOUBLE, 6) AS recall,
         round(squares / (np + nn)::DOUBLE, 6) AS brier_score,
         true_negatives, false_positives, false_negatives, true_positives
  FROM totals
)"""


def metrics_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_record(scored(spark, sf_dir))


def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compare_metrics(metrics_labels(spark, sf_dir), "steps", "length")


def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = gate.promotion_gate(metrics_labels(spark, sf_dir), "steps", "length")
    return decision.withColumn("rejection_reasons", F.array_join("rejection_reasons", " "))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and from a date; the later side is priced up by a fifth
    and its low priorities are regraded, so that some columns drift."""
    later = F.col("o_orderdate") >= F.lit(DRIFT_DATE).cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate"))
    current = orders.where(later).select(
        (F.col("o_totalprice") * 1.2).alias("o_totalprice"),
        "month",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("3-MEDIUM"))
        .otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
        "o_orderstatus",
    )
    return orders.where(~later).select(*current.columns), current


_SIDES_SQL = f"""
ref AS (SELECT o_totalprice, month(o_orderdate)::DOUBLE AS month, o_orderpriority, o_orderstatus
        FROM orders WHERE o_orderdate < TIMESTAMP '{DRIFT_DATE}'),
cur AS (SELECT o_totalprice * 1.2::DOUBLE AS o_totalprice, month(o_orderdate)::DOUBLE AS month,
               CASE WHEN o_orderpriority = '5-LOW' THEN '3-MEDIUM' ELSE o_orderpriority END
                 AS o_orderpriority, o_orderstatus
        FROM orders WHERE o_orderdate >= TIMESTAMP '{DRIFT_DATE}')"""
_CELLS_SQL = """
numbers AS (
  SELECT 'o_totalprice' AS "column", o_totalprice AS value, 1 AS r, 0 AS c FROM ref
  UNION ALL SELECT 'o_totalprice', o_totalprice, 0, 1 FROM cur
  UNION ALL SELECT 'month', month, 1, 0 FROM ref UNION ALL SELECT 'month', month, 0, 1 FROM cur
), n_counts AS (
  SELECT "column", value, sum(r) AS nr, sum(c) AS nc FROM numbers GROUP BY 1, 2
), n_shares AS (
  SELECT *, nr / (sum(nr) OVER (PARTITION BY "column"))::DOUBLE AS p,
         nc / (sum(nc) OVER (PARTITION BY "column"))::DOUBLE AS q,
         sum(nr) OVER (PARTITION BY "column") AS tr, sum(nc) OVER (PARTITION BY "column") AS tc,
         sum(nr) OVER w AS cr, sum(nc) OVER w AS cc,
         lead(value) OVER w - value AS dx
  FROM n_counts WINDOW w AS (PARTITION BY "column" ORDER BY value)
), spread AS (
  SELECT 'o_totalprice' AS "column", stddev_pop(o_totalprice) AS s FROM ref
  UNION ALL SELECT 'month', stddev_pop(month) FROM ref
), words AS (
  SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, 1 AS r, 0 AS c FROM ref
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, 0, 1 FROM cur
  UNION ALL SELECT 'o_orderstatus', o_orderstatus, 1, 0 FROM ref
  UNION ALL SELECT 'o_orderstatus', o_orderstatus, 0, 1 FROM cur
), w_counts AS (
  SELECT "column", value, sum(r) AS nr, sum(c) AS nc FROM words GROUP BY 1, 2
), w_shares AS (
  SELECT *, nr / (sum(nr) OVER (PARTITION BY "column"))::DOUBLE AS p,
         nc / (sum(nc) OVER (PARTITION BY "column"))::DOUBLE AS q,
         sum(nr) OVER (PARTITION BY "column") AS tr, sum(nc) OVER (PARTITION BY "column") AS tc
  FROM w_counts
), numeric AS (
  SELECT "column", max(abs(cr / tr::DOUBLE - cc / tc::DOUBLE)) AS ks,
         sum(abs(cr / tr::DOUBLE - cc / tc::DOUBLE) * dx) / any_value(s) AS wasserstein
  FROM n_shares JOIN spread USING ("column") GROUP BY 1
), categorical AS (
  SELECT "column",
         sqrt(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
                + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2) AS jensen_shannon,
         sum((nc - p * tc) ** 2 / (p * tc)) AS chi_square,
         max_by(p, value) AS pr, max_by(q, value) AS pc,
         CAST(any_value(tr) AS BIGINT) AS rows_ref, CAST(any_value(tc) AS BIGINT) AS rows_cur
  FROM w_shares GROUP BY 1
)"""


def drift_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = drift.numeric_statistics(*sides(spark, sf_dir), NUMERIC)
    return stats.select(
        "column", F.round("wasserstein", 6).alias("wasserstein"), F.round("ks", 6).alias("ks")
    )


def drift_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = drift.categorical_statistics(*sides(spark, sf_dir), CATEGORICAL)
    return stats.select(
        "column",
        "rows_ref",
        "rows_cur",
        F.round("jensen_shannon", 6).alias("jensen_shannon"),
        F.round("chi_square", 6).alias("chi_square"),
        F.round("z", 6).alias("z"),
    )


def drift_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = drift.drift_by_column(*sides(spark, sf_dir), NUMERIC, CATEGORICAL)
    return columns.select("column", "stattest", "drift_score", "drift_detected")


def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = drift.drift_summary(drift_columns(spark, sf_dir))
    return summary.withColumn("drifted_columns", F.array_join("drifted_columns", ","))


def _accounts(spark: SparkSession, sf_dir: str, name: str, prefix: str) -> DataFrame:
    balance, nation = F.col(f"{prefix}_acctbal"), F.col(f"{prefix}_nationkey")
    return table(spark, sf_dir, name).select(
        balance.alias("balance"),
        nation.cast("string").alias("nation"),
        F.when(balance < 0, "debt").otherwise("credit").alias("side"),
    )


def drift_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test statistics of suppliers as the reference and customers as current."""
    ref, cur = (
        _accounts(spark, sf_dir, "supplier", "s"),
        _accounts(spark, sf_dir, "customer", "c"),
    )
    numbers = drift.numeric_statistics(ref, cur, ["balance"])
    p = drift.kolmogorov_p(F.col("ks"), F.col("rows_ref"), F.col("rows_cur"))
    words = drift.categorical_statistics(ref, cur, ["nation", "side"])
    return numbers.select("column", F.lit("ks").alias("statistic"), F.round("ks", 6).alias("value")).unionByName(
        numbers.select("column", F.lit("ks_p").alias("statistic"), F.round(p, 6).alias("value"))
    ).unionByName(
        words.select(
            "column",
            F.when(F.col("distinct_all") <= 2, "z").otherwise("chi_square").alias("statistic"),
            F.round(F.when(F.col("distinct_all") <= 2, F.col("z")).otherwise(F.col("chi_square")), 6).alias("value"),
        )
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number in their payload as ``k``."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
    )


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and sign-ups logged as predictions, read back from the log."""
    rows = raw_events(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup"))
    fields = rows.select(
        "timestamp",
        (F.col("k") / 100).alias("probability"),
        F.when(F.col("k") >= 50, 1).otherwise(0).alias("prediction"),
        F.col("value").alias("latency_ms"),
    )
    logged = telemetry.prediction_events(fields, F.col("timestamp"))
    return telemetry.parsed(logged, telemetry.PREDICTION, telemetry.PREDICTION_FIELDS)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as retrieval queries with up to four similarities."""
    rows = raw_events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    found = F.expr("int(k div 20)")
    return rows.select(
        "timestamp",
        F.concat_ws(
            " ",
            F.lit("how often does it happen that value"),
            F.col("value").cast("string"),
            F.lit("is seen for k"),
            F.col("k").cast("string"),
        ).alias("query"),
        found.alias("n_results"),
        (F.col("k") < 30).alias("refused"),
        F.transform(
            F.slice(F.array(*[F.lit(i) for i in range(1, 5)]), F.lit(1), found),
            lambda i: (F.col("k") - i) / F.lit(100.0),
        ).alias("similarities"),
        F.col("value").alias("latency_ms"),
        F.struct(
            F.col("k").alias("prompt_tokens"),
            F.lit(7).alias("completion_tokens"),
            (F.col("k") + 7).alias("total_tokens"),
        ).alias("token_usage"),
    )


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.events_by_type(table(spark, sf_dir, "events").select("event_type"))


def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.prediction_summary(prediction_log(spark, sf_dir))


def rag_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = telemetry.rag_events(query_log(spark, sf_dir))
    return telemetry.rag_log_summary(
        telemetry.parsed(logged, telemetry.RAG_QUERY, telemetry.RAG_FIELDS)
    )


def rag_monitor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.rag_monitor_summary(query_log(spark, sf_dir))


def event_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = telemetry.rag_events(query_log(spark, sf_dir), F.col("timestamp"))
    rows = telemetry.parsed(logged, telemetry.RAG_QUERY, telemetry.RAG_FIELDS)
    return rows.groupBy("query_preview", "n_results").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.round(F.max("avg_similarity"), 6).alias("max_similarity"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).select(
        F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("error")
    )


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.request_metrics(requests(spark, sf_dir))


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = query_log(spark, sf_dir).select("refused", F.col("n_results").alias("n_evidence_ids"))
    return telemetry.metric_table(
        request_metrics(spark, sf_dir),
        telemetry.prediction_distribution(prediction_log(spark, sf_dir)),
        telemetry.rag_request_stats(queries),
    )


EVENTS_SQL = """
raw AS (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
predictions AS (
  SELECT k / 100.0::DOUBLE AS probability, CASE WHEN k >= 50 THEN 1 ELSE 0 END AS prediction,
         value AS latency_ms FROM raw WHERE event_type IN ('purchase', 'signup')),
queries AS (
  SELECT 'how often does it happen that value ' || value || ' is seen for k ' || k AS query,
         k // 20 AS n_results, k < 30 AS refused, k + 7 AS total_tokens, value AS latency_ms,
         coalesce(list_avg(list_transform(range(1, k // 20 + 1), lambda i: (k - i) / 100.0::DOUBLE)), 0)
           AS avg_similarity
  FROM raw WHERE event_type IN ('view', 'click'))"""
_RAG_SQL = """
  round(count(*) FILTER (WHERE NOT refused) / count(*)::DOUBLE, 4) AS hit_rate,
  round(count(*) FILTER (WHERE refused) / count(*)::DOUBLE, 4) AS refusal_rate,
  count(*) FILTER (WHERE n_results = 0) AS empty_retrieval_count,
  round(avg(latency_ms), 3) AS avg_latency_ms, round(avg(total_tokens), 1) AS avg_token_usage"""
_REQUESTS_SQL = """
SELECT count(*) AS total_requests, count(*) FILTER (WHERE event_type = 'error') AS error_count,
       round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate,
       round(avg(value), 3) AS avg_latency_ms FROM raw"""

QUERIES = {
    "metrics_labels": metrics_labels,
    "compare_models": compare_models,
    "promotion_gate": promotion_gate,
    "drift_numeric": drift_numeric,
    "drift_categorical": drift_categorical,
    "drift_columns": drift_columns,
    "drift_summary": drift_summary,
    "drift_accounts": drift_accounts,
    "events_by_type": events_by_type,
    "prediction_summary": prediction_summary,
    "rag_log_summary": rag_log_summary,
    "rag_monitor_summary": rag_monitor_summary,
    "event_previews": event_previews,
    "request_metrics": request_metrics,
    "metric_table": metric_table,
}

_DRIFT_SQL = f"""WITH {_SIDES_SQL}, {_CELLS_SQL}
SELECT "column", 'Wasserstein distance (normed)' AS stattest,
       round(wasserstein, 4) AS drift_score, wasserstein >= 0.1 AS drift_detected FROM numeric
UNION ALL
SELECT "column", 'Jensen-Shannon distance', round(jensen_shannon, 4), jensen_shannon >= 0.1
FROM categorical"""
_METRICS = ("roc_auc", "pr_auc", "f1", "precision", "recall", "brier_score")

ORACLES = {
    "metrics_labels": f"WITH {_SCORED_SQL} SELECT * FROM metrics",
    "compare_models": f"WITH {_SCORED_SQL}, long AS (UNPIVOT metrics ON {', '.join(_METRICS)} "
    "INTO NAME metric VALUE value) "
    "SELECT 'delta_' || b.metric AS metric, b.value AS baseline, i.value AS improved, "
    "round(i.value - b.value, 6) AS delta FROM long b JOIN long i USING (metric) "
    "WHERE b.model = 'steps' AND i.model = 'length'",
    "promotion_gate": f"""WITH {_SCORED_SQL}
SELECT g >= 0.03::DOUBLE AND -d <= 0.02::DOUBLE + 1e-9 AS promoted,
       round(g, 6) AS pr_auc_delta, round(d, 6) AS f1_delta,
       g >= 0.03::DOUBLE AS pr_auc_check, -d <= 0.02::DOUBLE + 1e-9 AS f1_check,
       concat_ws(' ',
         CASE WHEN g < 0.03::DOUBLE THEN
           printf('PR-AUC improvement %+.4f is below the required +0.03 threshold.', g) END,
         CASE WHEN -d > 0.02::DOUBLE + 1e-9 THEN
           printf('F1 degradation %.4f exceeds the allowed 0.02 limit.', -d) END)
         AS rejection_reasons,
       0.03::DOUBLE AS pr_auc_min_improvement, 0.02::DOUBLE AS f1_max_degradation,
       baseline_pr_auc, baseline_f1, baseline_roc_auc, improved_pr_auc, improved_f1, improved_roc_auc
FROM (SELECT b.pr_auc AS baseline_pr_auc, b.f1 AS baseline_f1, b.roc_auc AS baseline_roc_auc,
             i.pr_auc AS improved_pr_auc, i.f1 AS improved_f1, i.roc_auc AS improved_roc_auc,
             i.pr_auc - b.pr_auc AS g, i.f1 - b.f1 AS d
      FROM metrics b, metrics i WHERE b.model = 'steps' AND i.model = 'length')""",
    "drift_numeric": f"""WITH {_SIDES_SQL}, {_CELLS_SQL}
SELECT "column", round(wasserstein, 6) AS wasserstein, round(ks, 6) AS ks FROM numeric""",
    "drift_categorical": f"""WITH {_SIDES_SQL}, {_CELLS_SQL},
pooled AS (SELECT *, (pr * rows_ref + pc * rows_cur) / (rows_ref + rows_cur) AS m FROM categorical)
SELECT "column", rows_ref, rows_cur, round(jensen_shannon, 6) AS jensen_shannon,
       round(chi_square, 6) AS chi_square,
       round(abs(pr - pc) / sqrt(m * (1 - m) * (1 / rows_ref::DOUBLE + 1 / rows_cur::DOUBLE)), 6) AS z
FROM pooled""",
    "drift_columns": _DRIFT_SQL,
    "drift_summary": f"""
SELECT avg(drift_detected::INTEGER) >= 0.5 AS dataset_drift_detected,
       count(*) FILTER (WHERE drift_detected) AS n_drifted_columns,
       count(*) FILTER (WHERE NOT drift_detected) AS n_not_drifted_columns,
       string_agg("column", ',' ORDER BY "column") FILTER (WHERE drift_detected) AS drifted_columns
FROM ({_DRIFT_SQL})""",
    "drift_accounts": """WITH cells AS (
  SELECT s_acctbal AS b, CAST(s_nationkey AS VARCHAR) AS nation, 1 AS r, 0 AS c FROM supplier
  UNION ALL SELECT c_acctbal, CAST(c_nationkey AS VARCHAR), 0, 1 FROM customer
), totals AS (SELECT sum(r)::DOUBLE AS n, sum(c)::DOUBLE AS m FROM cells),
values_ AS (SELECT b, sum(r) AS r, sum(c) AS c FROM cells GROUP BY b),
ks AS (
  SELECT max(gap) AS d, any_value(n) AS n, any_value(m) AS m FROM (
    SELECT abs(sum(r) OVER (ORDER BY b) / n - sum(c) OVER (ORDER BY b) / m) AS gap, n, m
    FROM values_, totals)
), nations AS (
  SELECT nation, sum(r) AS r, sum(c) AS c FROM cells GROUP BY nation
), debts AS (
  SELECT sum(r) FILTER (WHERE b < 0) / any_value(n) AS p, sum(c) FILTER (WHERE b < 0) / any_value(m) AS q,
         any_value(n) AS n, any_value(m) AS m FROM cells, totals
)
SELECT 'balance' AS "column", 'ks' AS statistic, round(d, 6) AS value FROM ks
UNION ALL
SELECT 'balance', 'ks_p', round(least(1, greatest(0, list_sum(list_transform(range(1, 101),
  lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * k * k * d * d * n * m / (n + m)))))), 6)
FROM ks
UNION ALL
SELECT 'nation', 'chi_square', round(sum(CASE WHEN r > 0 THEN (c - r * m / n) ** 2 / (r * m / n)
                                              WHEN c > 0 THEN 'Infinity'::DOUBLE END), 6)
FROM nations, totals
UNION ALL
SELECT 'side', 'z', round(abs(p - q) / sqrt((p * n + q * m) / (n + m) * (1 - (p * n + q * m) / (n + m))
                                            * (1 / n + 1 / m)), 6) FROM debts""",
    "events_by_type": "SELECT event_type, count(*) AS n_events FROM events GROUP BY event_type",
    "prediction_summary": f"""WITH {EVENTS_SQL}
SELECT count(*) AS count, round(avg(probability), 4) AS avg_probability,
       round(avg(prediction), 4) AS positive_rate, round(avg(latency_ms), 3) AS avg_latency_ms
FROM predictions""",
    "rag_log_summary": f"""WITH {EVENTS_SQL}
SELECT count(*) AS count, {_RAG_SQL},
       round(coalesce(avg(avg_similarity) FILTER (WHERE avg_similarity > 0), 0), 4)
         AS avg_top_k_similarity FROM queries""",
    "rag_monitor_summary": f"""WITH {EVENTS_SQL}
SELECT count(*) AS total_queries, {_RAG_SQL}, count(*) FILTER (WHERE refused) AS refused_count,
       round(coalesce(avg(avg_similarity) FILTER (WHERE n_results > 0), 0), 4)
         AS avg_top_k_similarity,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens_used FROM queries""",
    "event_previews": f"""WITH {EVENTS_SQL}
SELECT substring(query, 1, 60) AS query_preview, n_results, count(*) AS n_events,
       round(max(avg_similarity), 6) AS max_similarity FROM queries GROUP BY 1, 2""",
    "request_metrics": f"WITH {EVENTS_SQL} {_REQUESTS_SQL}",
    "metric_table": f"""WITH {EVENTS_SQL},
a AS (SELECT * FROM ({_REQUESTS_SQL})),
b AS (SELECT count(*) AS n, sum(prediction) AS p FROM predictions),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE refused) AS r, avg(n_results) AS m FROM queries)
SELECT 'total_requests' AS metric, total_requests::DOUBLE AS value FROM a
UNION ALL SELECT 'error_count', error_count FROM a
UNION ALL SELECT 'error_rate', error_rate FROM a
UNION ALL SELECT 'avg_latency_ms', avg_latency_ms FROM a
UNION ALL SELECT 'total_predictions', n FROM b
UNION ALL SELECT 'positive_predictions', p FROM b
UNION ALL SELECT 'negative_predictions', n - p FROM b
UNION ALL SELECT 'positive_rate', round(p / n::DOUBLE, 6) FROM b
UNION ALL SELECT 'total_queries', n FROM c
UNION ALL SELECT 'refused_queries', r FROM c
UNION ALL SELECT 'refusal_rate', round(r / n::DOUBLE, 6) FROM c
UNION ALL SELECT 'avg_evidence_ids_per_query', round(m, 3) FROM c""",
}
