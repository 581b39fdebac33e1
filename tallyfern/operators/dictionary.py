"""Category dictionaries as tables, for columns of any number of categories.

The categories of all columns are dealt by range and numbered inside their range; the
ranges' counts, one row each, give every range its first number.  No list of categories
reaches the driver, and encoding is a join that yields only the slots that are set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfern.functions.text import strip
from tallyfern.operators.prep import MISSING
from tallyfern.sources.session import small_side
from tallyfern.sources.tables import cut_lineage


def category(c: Column) -> Column:
    """A cell as its category: stripped, lower-cased, a missing one named."""
    return F.coalesce(F.lower(strip(c.cast("string"))), F.lit(MISSING))


def melted(df: DataFrame, categorical: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell of the categorical columns: ``keep``, ``place`` of the column, ``value``."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("place"), category(F.col(f"`{c}`")).alias("value")) for i, c in enumerate(sorted(categorical))]
    )
    return df.select(*keep, F.inline(cells))


def fit_dictionary(
    df: DataFrame, categorical: Sequence[str], first_slot: int = 0, ranges: int | None = None
) -> DataFrame:
    """``place``, ``value``, ``slot`` and ``feature`` of every category: columns in order of
    their names, values in byte order, slots from ``first_slot`` without gaps.

    Written to the shared folder once.  A null and a category spelt like it are one.
    """
    if not categorical:
        raise ValueError("there is no categorical column")
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = cut_lineage(melted(df, categorical).distinct())
    ordered = known.repartitionByRange(n, "place", "value").sortWithinPartitions("place", "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.num_rows
            columns = [*batch.columns, pa.array([own] * size, pa.int32()), pa.array(range(at, at + size), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "value", "range", "number"])
            at += size

    numbered = cut_lineage(ordered.mapInArrow(number, "place int, value string, range int, number long"))
    counts = numbered.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    names = F.element_at(F.array(*[F.lit(c) for c in sorted(categorical)]), F.col("place") + 1)
    return cut_lineage(
        numbered.join(starts, "range").select(
            "place",
            "value",
            (F.col("start") + F.col("number") + first_slot).alias("slot"),
            F.concat(F.lit("categorical__"), names, F.lit("_"), "value").alias("feature"),
        )
    )


def sparse_features(
    df: DataFrame, dictionary: DataFrame, categorical: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """The set slots of every row: ``key``, ``slot``, ``feature`` and ``value`` 1.

    A category that the dictionary has not gives no row.  A dictionary of up to
    ``BROADCAST_ROWS`` categories is sent to the rows; a larger one meets them in a
    shuffle, where a frequent category's rows are split by the join's skew handling.
    """
    cells = melted(df, categorical, key)
    return cells.join(small_side(dictionary), ["place", "value"]).select(
        *key, "slot", "feature", F.lit(1.0).alias("value")
    )
