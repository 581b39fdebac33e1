"""The monitoring and indexing operators on streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyfern.operators import encoding, sketches, telemetry
from tallyfern.operators.chunking import chunk_table
from tallyfern.sources.tables import compact, replace_all, versions, write_version

LATENESS = "10 minutes"


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A folder of parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def running_event_counts(events: DataFrame) -> DataFrame:
    """Events per type so far (complete mode)."""
    return telemetry.events_by_type(events)


def running_request_metrics(requests: DataFrame) -> DataFrame:
    """Request totals so far (complete mode)."""
    return telemetry.request_metrics(requests)


def hourly_event_counts(
    events: DataFrame, time_column: str = "timestamp", lateness: str = LATENESS
) -> DataFrame:
    """Events per hour and type; an hour is final once the watermark passes it.

    Late rows beyond the watermark drop.  The time column must be a TIMESTAMP.
    """
    return (
        events.withWatermark(time_column, lateness)
        .groupBy(F.window(time_column, "1 hour").alias("window"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("window.start").alias("hour"), "event_type", "n_events")
    )


def window_sketches(
    rows: DataFrame,
    columns: Sequence[str],
    time: str,
    width: str = "1 day",
    lateness: str = LATENESS,
    alpha: float = sketches.ALPHA,
) -> DataFrame:
    """The sketch of each column and window, once the watermark has passed the window
    (append mode); stored windows merge by ``sketches.merge_sketches``."""
    return sketches.window_sketches(rows.withWatermark(time, lateness), columns, time, width, alpha)


def to_table(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run a stream over all waiting input into a parquet table and return it.

    In complete mode every batch commits the whole table as a version, which
    ``read_index(spark, path, None)`` reads; readers of an earlier one keep theirs.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", path).start()

    def replace(batch: DataFrame, number: int) -> None:
        replace_all(batch, path, _batch_name(batch, number))

    return writer.foreachBatch(replace).start()


def _batch_name(batch: DataFrame, number: int) -> str:
    """A name that no other stream or batch has: Spark keeps the query's id in its
    checkpoint, so a replay has the same name and a new checkpoint another."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query}-{number}"


def _spread(batch: DataFrame, key: str) -> DataFrame:
    """A batch of fewer splits than cores, dealt by ``key``: chunking is the heavy part."""
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return batch if batch.rdd.getNumPartitions() >= cores else batch.repartition(cores, key)


def index_stream(
    documents: DataFrame,
    base: str,
    checkpoint: str,
    text_column: str = "complaint_narrative",
    columns: Mapping[str, str] | None = None,
    encoder: PipelineModel | None = None,
    compact_after: int = 16,
) -> StreamingQuery:
    """Chunk arriving documents into a versioned index, encoded if ``encoder`` is given.

    A batch becomes a version named by the query and its number, beside whatever
    other writers commit.  Chunk ids are content addresses and a replay finds its
    version committed, so the result is exactly-once.  Every ``compact_after``
    versions the index is written as one.
    """

    document = (columns or {}).get("complaint_id", "complaint_id")

    def add(batch: DataFrame, number: int) -> None:
        chunks = chunk_table(_spread(batch, document), text_column, columns)
        if encoder is not None:
            chunks = encoding.encode(chunks, encoder)
        write_version(chunks, base, _batch_name(batch, number))
        if len(versions(batch.sparkSession, base)) % compact_after == 0:
            compact(batch.sparkSession, base)

    return (
        documents.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
