"""Quantile sketches of numeric columns over event-time windows (D-2, D-4, D-7 on windows).

A sketch counts values in buckets whose ends grow by a constant factor, so that every value
of a bucket is within ``alpha`` of its middle, relative to the value.  Counts add up:
sketches of windows merge, in any order, to exactly the sketch of all their rows.  A sketch
has at most some ``2 * 1454 / ln((1 + alpha) / (1 - alpha))`` buckets whatever its rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyfern.operators.drift import DISTANCE_LIMIT, MIN_SPREAD

ALPHA = 0.01
#: Natural logarithm below that of the least positive double.
LEAST_LOG = -746.0


def _log_factor(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    return math.log((1 + alpha) / (1 - alpha))


def bucket_of(value: Column, alpha: float = ALPHA) -> Column:
    """The bucket of a finite double, in the values' order: 0 for zero, negative for less."""
    step = _log_factor(alpha)
    place = (F.ceil(F.log(F.abs(value)) / step) - math.floor(LEAST_LOG / step)).cast("int")
    return F.when(value == 0, F.lit(0)).when(value > 0, place).otherwise(-place)


def middle_of(bucket: Column, alpha: float = ALPHA) -> Column:
    """The value that is within ``alpha`` of every value of a bucket."""
    step = _log_factor(alpha)
    size = F.exp((F.abs(bucket) + math.floor(LEAST_LOG / step)) * F.lit(step) + math.log1p(-alpha))
    return F.when(bucket == 0, 0.0).otherwise(F.signum(bucket.cast("double")) * size)


def window_sketches(
    rows: DataFrame,
    columns: Sequence[str],
    time: str,
    width: str = "1 day",
    alpha: float = ALPHA,
) -> DataFrame:
    """``column, window_start, bucket, n, alpha``: the sketch of each column and window.

    One aggregate with map-side counts, on tables and on streams with a watermark.  Nulls,
    NaN, infinities and rows without a time are left out.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    )
    value = F.col("value")
    long = rows.select(F.col(time).alias("__time"), F.inline(cells)).where(
        value.isNotNull() & ~F.isnan(value) & (F.abs(value) < math.inf) & F.col("__time").isNotNull()
    )
    counted = long.groupBy(
        F.window("__time", width).alias("__window"), "column", bucket_of(value, alpha).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "column", F.col("__window.start").alias("window_start"), "bucket", "n", F.lit(alpha).alias("alpha")
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = ("column",)) -> DataFrame:
    """Sketches of all rows with equal ``keys``; sketches of unlike ``alpha`` stay apart."""
    return sketches.groupBy(*keys, "bucket", "alpha").agg(F.sum("n").alias("n"))


def sketch_quantiles(
    sketches: DataFrame, probabilities: Sequence[float], keys: Sequence[str] = ("column",), alpha: float = ALPHA
) -> DataFrame:
    """``keys, n, probability, value, error``: the value at place ``floor(p * (n - 1))`` of the
    sorted values, at most ``error`` (``alpha`` of the true value) away from it."""
    merged = merge_sketches(sketches.where(F.abs(F.col("alpha") - alpha) < 1e-12), keys)
    by = Window.partitionBy(*keys)
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(by))
    found = [
        F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1)), F.col("bucket"))).alias(f"_{i}")
        for i, p in enumerate(probabilities)
    ]
    rows = placed.groupBy(*keys).agg(F.first("total").alias("n"), *found)
    cells = [
        F.struct(F.lit(float(p)).alias("probability"), middle_of(F.col(f"_{i}"), alpha).alias("value"))
        for i, p in enumerate(probabilities)
    ]
    long = rows.select(*keys, "n", F.inline(F.array(*cells)))
    return long.withColumn("error", F.abs("value") * F.lit(alpha / (1 - alpha)))


def sketch_drift(reference: DataFrame, windows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Every window of ``windows`` against the whole of ``reference``, from sketches only.

    ``column, window_start, rows, ks, ks_high, wasserstein, wasserstein_low,
    wasserstein_high, drift_detected, sure``.  The true Kolmogorov-Smirnov statistic lies
    between ``ks`` and ``ks_high``; the true Wasserstein distance over the reference's
    spread lies between its low and high bound, as no value is further than
    ``alpha / (1 - alpha)`` of its middle from it.  ``drift_detected`` compares the
    estimate with the limit, and ``sure`` says that both bounds agree with it.  A column
    that either side lacks has no row.
    """
    ref = merge_sketches(reference.where(F.abs(F.col("alpha") - alpha) < 1e-12))
    cur = merge_sketches(windows.where(F.abs(F.col("alpha") - alpha) < 1e-12), ("column", "window_start"))
    # as many rows as windows have buckets in the reference, whatever was counted
    pairs = cur.select("column", "window_start").distinct()
    zero = F.lit(0).cast("bigint")
    cells = (
        ref.join(pairs, "column")
        .select("column", "window_start", "bucket", F.col("n").alias("r"), zero.alias("c"))
        .unionByName(cur.select("column", "window_start", "bucket", zero.alias("r"), F.col("n").alias("c")))
        .groupBy("column", "window_start", "bucket")
        .agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    )
    by = Window.partitionBy("column", "window_start")
    ordered = by.orderBy("bucket")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def share(n: str, window: WindowSpec | None = None) -> Column:
        """Null where a side has no rows."""
        part = F.col(n) if window is None else F.sum(n).over(window)
        return F.try_divide(part, F.sum(n).over(by))

    steps = (
        cells.withColumn("x", middle_of(F.col("bucket"), alpha))
        .withColumns({"p": share("r"), "q": share("c"), "rows": F.sum("c").over(by)})
        .withColumn("gap", F.abs(share("r", upto) - share("c", upto)))
        .withColumn("width", F.coalesce(F.lead("x").over(ordered) - F.col("x"), F.lit(0.0)))
    )
    worst = F.lit(alpha / (1 - alpha))
    x, p, q = F.col("x"), F.col("p"), F.col("q")
    sums = steps.groupBy("column", "window_start").agg(
        F.first("rows").alias("rows"),
        F.max("gap").alias("ks"),
        F.max(F.greatest(p, q)).alias("_share"),
        F.sum(F.col("gap") * F.col("width")).alias("_area"),
        (worst * F.sum((p + q) * F.abs(x))).alias("_off"),
        F.sqrt(F.greatest(F.sum(p * x * x) - F.pow(F.sum(p * x), 2), F.lit(0.0))).alias("_spread"),
        (worst * F.sqrt(F.sum(p * x * x))).alias("_spread_off"),
    )
    least = F.lit(MIN_SPREAD)
    low = F.greatest(F.lit(0.0), F.col("_area") - F.col("_off")) / F.greatest(least, F.col("_spread") + F.col("_spread_off"))
    high = (F.col("_area") + F.col("_off")) / F.greatest(least, F.col("_spread") - F.col("_spread_off"))
    normed = F.col("_area") / F.greatest(least, F.col("_spread"))
    limit = F.lit(DISTANCE_LIMIT)
    return sums.where(F.col("ks").isNotNull()).select(
        "column",
        "window_start",
        "rows",
        "ks",
        F.least(F.lit(1.0), F.col("ks") + F.col("_share")).alias("ks_high"),
        normed.alias("wasserstein"),
        low.alias("wasserstein_low"),
        high.alias("wasserstein_high"),
        (normed >= limit).alias("drift_detected"),
        F.when(normed >= limit, low >= limit).otherwise(high < limit).alias("sure"),
    )
