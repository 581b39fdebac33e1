"""Row-preserving Arrow maps: the shape that most operators here share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch: texts of 100,000 characters stay under 60 MB a batch.
BATCH_ROWS = 512
BATCH_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch to at most ``rows`` rows of text."""
    if not 0 < int(spark.conf.get(BATCH_ROWS_KEY)) <= rows:
        spark.conf.set(BATCH_ROWS_KEY, str(rows))


def other_columns(df: DataFrame, fields: Sequence[T.StructField], keep: Sequence[str]) -> list[str]:
    """``keep`` without those that a new field of the same name replaces."""
    taken = {f.name.lower() for f in fields}
    return [c for c in keep if c.lower() not in taken]


def map_rows(
    df: DataFrame,
    inputs: Sequence[Column],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keep`` and new columns computed from ``inputs``, row by row, in Arrow batches.

    ``make`` runs once in each task and returns the function that takes the
    batch's input arrays and returns one array per field.  A kept column with the
    name of a field gives way to it.
    """
    bound_batches(df.sparkSession)
    kept = other_columns(df, fields, keep)
    source = df.select(
        *[F.col(f"`{c}`") for c in kept],
        *[c.alias(f"__input_{i}") for i, c in enumerate(inputs)],
    )
    schema = T.StructType([*source.schema.fields[: len(kept)], *fields])
    names, width = schema.names, len(kept)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for part in parts:
            work = work or make()
            made = work(*part.columns[width:])
            yield pa.RecordBatch.from_arrays([*part.columns[:width], *made], names=names)

    return source.mapInArrow(run, schema)


def utf8(array: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [v or b"" for v in array.cast(pa.binary()).to_pylist()]


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
