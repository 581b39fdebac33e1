"""Running sums over a total order without a single-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfern.sources.tables import cut_lineage

ROWS_PER_BUCKET = 1_000_000
SAMPLED_PER_BUCKET = 2_000
MEDIAN_ACCURACY = 10_000


def _splits(rows: DataFrame, value: str, n_buckets: int | None, rows_per_bucket: int) -> list[float]:
    """Inner range limits at even quantiles of the rows; empty for one range.

    The limits only balance the ranges, so a coarse sketch is good enough.
    """
    number = F.col(value).cast("double")
    fraction = 1.0
    if n_buckets is None:
        n = rows.count()
        n_buckets = math.ceil(n / rows_per_bucket)
        fraction = min(1.0, SAMPLED_PER_BUCKET * n_buckets / max(1, n))
    if n_buckets <= 1:
        return []
    shares = [i / n_buckets for i in range(1, n_buckets)]
    seen = rows if fraction == 1.0 else rows.sample(fraction, seed=0)
    limits = seen.agg(F.percentile_approx(number, shares, max(1_000, 4 * n_buckets))).first()[0]
    return sorted({x for x in limits or [] if math.isfinite(x)})


def ranged_cumsum(
    rows: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    n_buckets: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Running sums of ``sums`` over distinct ``value`` within each ``by`` group.

    Rows collapse to one per distinct value first, so a hot value costs nothing.
    The values are cut into ranges at approximate quantiles; each range
    accumulates on its own and adds the totals of the ranges before it.  A range
    is a function of the value, so a retried task agrees with its first run.

    Returns, per group and value, each sum, ``cum_<sum>`` including the row
    itself, ``total_<sum>`` of the group, and ``next_value`` in the order.
    """
    keys = [*by, "_range"]
    # The input is read once: what follows rereads only its distinct values.
    grouped = cut_lineage(rows.groupBy(*by, value).agg(*[F.sum(s).alias(s) for s in sums]))
    splits = _splits(grouped, value, n_buckets, rows_per_bucket)
    scope = Window.partitionBy(*(by or [F.lit(0)]))

    def ordered(c):
        return F.col(c).desc() if descending else F.col(c).asc()

    if not splits:
        # Few enough values for one range per group: no totals to carry over.
        inside = scope.orderBy(ordered(value))
        running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return grouped.select(
            *by,
            value,
            *sums,
            *[F.sum(s).over(running).alias(f"cum_{s}") for s in sums],
            *[F.sum(s).over(scope).alias(f"total_{s}") for s in sums],
            F.lead(value).over(inside).alias("next_value"),
        )

    cutter = Bucketizer(
        splits=[-math.inf, *splits, math.inf], inputCol="_position", outputCol="_range"
    )
    grouped = cutter.transform(
        grouped.withColumn("_position", F.col(value).cast("double"))
    ).drop("_position")
    inside = Window.partitionBy(*keys).orderBy(ordered(value))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = grouped.select(
        *keys,
        value,
        *sums,
        *[F.sum(s).over(running).alias(f"_run_{s}") for s in sums],
        F.lead(value).over(inside).alias("_next"),
    )

    first = F.max(value) if descending else F.min(value)
    ranges = grouped.groupBy(*keys).agg(
        *[F.sum(s).alias(f"_in_{s}") for s in sums], first.alias("_first")
    )
    across = scope.orderBy(ordered("_range"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        *keys,
        *[F.coalesce(F.sum(f"_in_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_in_{s}").over(scope).alias(f"total_{s}") for s in sums],
        F.lead("_first").over(across).alias("_next_first"),
    )
    return local.join(offsets, keys).select(
        *by,
        value,
        *sums,
        *[(F.col(f"_run_{s}") + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
        *[f"total_{s}" for s in sums],
        F.coalesce("_next", "_next_first").alias("next_value"),
    )


def melt(df: DataFrame, columns: Sequence[str], cast: str, extra: Sequence[str] = ()) -> DataFrame:
    """Long form: one ``(column, value)`` row per cell, ``extra`` columns kept."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(cast).alias("value"))
            for c in columns
        ]
    )
    return df.select(*extra, F.inline(cells))


def exact_medians(
    df: DataFrame, columns: Sequence[str], accuracy: int = MEDIAN_ACCURACY
) -> DataFrame:
    """Exact median per numeric column; nulls and NaN are left out.

    Spark's own exact percentile merges every distinct value of a column in one
    task.  Here a quantile sketch brackets the middle first: its rank error is
    at most ``1 / accuracy``, so only that share of the values is counted one by
    one, and everything below the bracket collapses to a single count.
    """
    numbers = {c: F.col(f"`{c}`").cast("double") for c in columns}
    valid = {c: F.when(~F.isnan(x), x) for c, x in numbers.items()}
    margin = 2.0 / accuracy
    bracket = df.agg(
        *[
            F.percentile_approx(x, [0.5 - margin, 0.5 + margin], accuracy).alias(f"b{i}")
            for i, x in enumerate(valid.values())
        ],
        *[F.count(x).alias(f"n{i}") for i, x in enumerate(valid.values())],
    ).first()
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(x < bracket[f"b{i}"][0], F.lit(-math.inf)).otherwise(x).alias("value"),
            F.lit(bracket[f"n{i}"]).alias("_total"),
            (x <= bracket[f"b{i}"][1]).alias("_kept"),
        )
        for i, (c, x) in enumerate(valid.items())
        if bracket[f"n{i}"]
    ]
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, median double")
    counted = df.select(F.inline(F.array(*cells))).where("_kept").withColumn("n", F.lit(1))
    # The sketch bounds the distinct values left in all brackets together.
    left = sum(bracket[f"n{i}"] for i in range(len(columns))) * 2 * (margin + 1 / accuracy)
    n_buckets = max(1, math.ceil(left / ROWS_PER_BUCKET))
    ranked = ranged_cumsum(counted, "value", ["n"], ["column", "_total"], n_buckets=n_buckets)

    def at(rank):
        inside = (rank <= F.col("cum_n")) & (rank > F.col("cum_n") - F.col("n"))
        return F.sum(F.when(inside, F.col("value")))

    low, high = F.expr("(_total + 1) div 2"), F.expr("(_total + 2) div 2")
    return ranked.groupBy("column").agg(((at(low) + at(high)) / 2).alias("median"))
