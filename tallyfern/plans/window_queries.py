"""Registered queries over event-time windows and resettable logs."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators import sketches
from tallyfern.plans.stream_queries import stream_of
from tallyfern.plans.table_queries import table
from tallyfern.sources.session import shared_folder
from tallyfern.streaming import running, streams

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PROBABILITIES = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)


def drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day of events against all days, from one pass that sketches the days."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    base = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    sketches.window_sketches(events, ["value", "user_id"], "at").write.parquet(base)
    days = spark.read.parquet(base)
    found = sketches.sketch_drift(days, days)
    shown = [F.round(c, 6).alias(c) for c in ("ks", "ks_high", "wasserstein", "wasserstein_low", "wasserstein_high")]
    return found.select(
        "column", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rows", *shown, "drift_detected", "sure"
    )


def stream_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the hours that a stream of events has closed, merged by day."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = stream_of(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    hours = streams.window_sketches(events, ["value"], "at", "1 hour")
    streams.to_table(hours, f"{place}/out", f"{place}/log").awaitTermination()
    stored = spark.read.parquet(f"{place}/out")
    by_day = stored.withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
    found = sketches.sketch_quantiles(by_day, PROBABILITIES, ("column", "day"))
    return found.withColumn("value", F.round("value", 6)).withColumn("error", F.round("error", 6))


def stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means by event type since the last reset, kept by a stream in which every
    sign-up of class 7 resets the log."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    k = F.get_json_object("props", "$.k").cast("int")
    events = stream_of(spark, sf_dir, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    reset = (F.col("event_type") == "signup") & (k == 7)
    found = running.running_summaries(events, {"value": F.col("value"), "k": k}, EVENT_TYPES, reset)
    running.run_summaries(found, f"{place}/out", f"{place}/log").awaitTermination()
    totals = running.latest(spark.read.parquet(f"{place}/out"), ["value", "k"])
    return totals.withColumn("avg_value", F.round("avg_value", 6)).withColumn("avg_k", F.round("avg_k", 6))


QUERIES = {
    "drift_windows": drift_windows,
    "stream_quantiles": stream_quantiles,
    "stream_running": stream_running,
}

_STEP = math.log((1 + sketches.ALPHA) / (1 - sketches.ALPHA))
_BASE = -math.floor(sketches.LEAST_LOG / _STEP)
_WORST = sketches.ALPHA / (1 - sketches.ALPHA)


def _bucket_sql(x: str) -> str:
    place = f"CAST(ceil(ln(abs({x})) / {_STEP!r}::DOUBLE) + {_BASE} AS BIGINT)"
    return f"CASE WHEN {x} = 0 THEN 0 WHEN {x} > 0 THEN {place} ELSE -{place} END"


def _middle_sql(b: str) -> str:
    return (
        f"CASE WHEN {b} = 0 THEN 0::DOUBLE ELSE sign({b}) * "
        f"exp((abs({b}) - {_BASE}) * {_STEP!r}::DOUBLE + {math.log1p(-sketches.ALPHA)!r}::DOUBLE) END"
    )


ORACLES = {
    "stream_running": """WITH all_events AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), resets AS (SELECT max(ts) AS since FROM all_events WHERE event_type = 'signup' AND k = 7),
live AS (
  SELECT e.* FROM all_events e, resets
  WHERE (since IS NULL OR ts > since) AND NOT (event_type = 'signup' AND k = 7)
), types AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type)
SELECT t.event_type, count(l.event_id) AS n_events, round(avg(value), 6) AS avg_value, round(avg(k), 6) AS avg_k
FROM types t LEFT JOIN live l ON l.event_type = t.event_type GROUP BY 1""",
    "drift_windows": f"""WITH long AS (
  SELECT 'value' AS "column", value AS x, strftime(ts, '%Y-%m-%d') AS day FROM events
  UNION ALL SELECT 'user_id', user_id::DOUBLE, strftime(ts, '%Y-%m-%d') FROM events
), days AS (
  SELECT "column", day, {_bucket_sql("x")} AS b, count(*) AS c FROM long
  WHERE x IS NOT NULL AND day IS NOT NULL GROUP BY ALL
), ref AS (SELECT "column", b, sum(c) AS r FROM days GROUP BY ALL
), cells AS (
  SELECT k."column", k.day, ref.b, r, coalesce(c, 0) AS c, {_middle_sql("ref.b")} AS x
  FROM (SELECT DISTINCT "column", day FROM days) k JOIN ref ON ref."column" = k."column"
  LEFT JOIN days ON days."column" = k."column" AND days.day = k.day AND days.b = ref.b
), steps AS (
  SELECT *, r / (sum(r) OVER k)::DOUBLE AS p, c / (sum(c) OVER k)::DOUBLE AS q, sum(c) OVER k AS total,
    abs(sum(r) OVER o / (sum(r) OVER k)::DOUBLE - sum(c) OVER o / (sum(c) OVER k)::DOUBLE) AS gap,
    coalesce(lead(x) OVER o - x, 0) AS width
  FROM cells WINDOW k AS (PARTITION BY "column", day), o AS (PARTITION BY "column", day ORDER BY b)
), sums AS (
  SELECT "column", day, CAST(any_value(total) AS BIGINT) AS rows, max(gap) AS ks, max(greatest(p, q)) AS share,
    sum(gap * width) AS area, {_WORST!r}::DOUBLE * sum((p + q) * abs(x)) AS off_,
    sqrt(greatest(sum(p * x * x) - sum(p * x) ** 2, 0)) AS s, {_WORST!r}::DOUBLE * sqrt(sum(p * x * x)) AS soff
  FROM steps GROUP BY 1, 2
), bounds AS (
  SELECT *, area / greatest(0.001, s) AS w, greatest(0, area - off_) / greatest(0.001, s + soff) AS lo,
    (area + off_) / greatest(0.001, s - soff) AS hi FROM sums)
SELECT "column", day, rows, round(ks, 6) AS ks, round(least(1, ks + share), 6) AS ks_high,
  round(w, 6) AS wasserstein, round(lo, 6) AS wasserstein_low, round(hi, 6) AS wasserstein_high,
  w >= 0.1 AS drift_detected, CASE WHEN w >= 0.1 THEN lo >= 0.1 ELSE hi < 0.1 END AS sure FROM bounds""",
    "stream_quantiles": f"""WITH rows_ AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, value AS x FROM events
  WHERE value IS NOT NULL AND date_trunc('hour', ts) + INTERVAL 1 HOUR
        <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
), placed AS (
  SELECT day, {_bucket_sql("x")} AS b, row_number() OVER (PARTITION BY day ORDER BY x) - 1 AS place,
         count(*) OVER (PARTITION BY day) AS n FROM rows_
), asked AS (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in PROBABILITIES)}]) AS probability),
found AS (
  SELECT day, n, probability, {_middle_sql("b")} AS v FROM placed JOIN asked ON place = floor(probability * (n - 1)))
SELECT 'value' AS "column", day, n, probability, round(v, 6) AS value, round(abs(v) * {_WORST!r}::DOUBLE, 6) AS error
FROM found""",
}
