"""Distribution drift between a reference and a current table (D-1 to D-9)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tallyfern.operators.ranking import melt, ranged_cumsum

# Limits and test names.
LARGE_REFERENCE = 1_000
FEW_VALUES = 5
MIN_SPREAD = 0.001
DISTANCE_LIMIT = 0.1
P_LIMIT = 0.05
DRIFT_SHARE = 0.5
WASSERSTEIN = "Wasserstein distance (normed)"
JENSEN_SHANNON = "Jensen-Shannon distance"
KOLMOGOROV_SMIRNOV = "K-S p_value"
CHI_SQUARE = "chi-square p_value"
PROPORTION_Z = "Z-test p_value"

#: Rows of either sample up to which its p-value is exact.
EXACT_ROWS = 1_000
KOLMOGOROV_TERMS = 100


def common_columns(columns: Sequence[str], *tables: DataFrame) -> list[str]:
    """The monitored columns that every table has, in the given order."""
    return [c for c in columns if all(c in t.columns for t in tables)]


def _cells(reference: DataFrame, current: DataFrame, columns: Sequence[str], cast: str) -> DataFrame:
    """Long ``column, value, n_ref, n_cur`` rows of both sides without nulls."""
    sides = []
    for table, in_ref in ((reference, 1), (current, 0)):
        sides.append(
            melt(table, columns, cast)
            .withColumn("n_ref", F.lit(in_ref))
            .withColumn("n_cur", F.lit(1 - in_ref))
        )
    cells = sides[0].unionByName(sides[1]).where(F.col("value").isNotNull())
    if cast == "double":
        cells = cells.where(~F.isnan("value") & (F.abs("value") != math.inf))
    return cells


def _frequency_sums(p: Column, q: Column, n_ref: Column, n_cur: Column) -> dict[str, Column]:
    """Aggregates over distinct values that the categorical tests need."""
    mean = (p + q) / 2

    def divergence(share: Column) -> Column:
        return F.when(share > 0, share * F.log(share / mean)).otherwise(0.0)

    total_ref, total_cur = F.col("total_n_ref"), F.col("total_n_cur")
    expected = p * total_cur
    cell = F.when(expected > 0, F.pow(n_cur - expected, 2) / expected).when(
        n_cur > 0, F.lit(math.inf)
    )
    return {
        "rows_ref": F.first(total_ref),
        "rows_cur": F.first(total_cur),
        "distinct_ref": F.count_if(n_ref > 0),
        "distinct_all": F.count(F.lit(1)),
        "jensen_shannon": F.sqrt(
            F.greatest(F.lit(0.0), F.sum(divergence(p) + divergence(q)) / 2)
        ),
        "chi_square": F.sum(cell),
        "_share_ref": F.max_by(p, "value"),
        "_share_cur": F.max_by(q, "value"),
    }


def _with_z(stats: DataFrame) -> DataFrame:
    """|z| of the share of one value under a pooled variance."""
    n, m = F.col("rows_ref"), F.col("rows_cur")
    a, b = F.col("_share_ref"), F.col("_share_cur")
    pooled = (a * n + b * m) / (n + m)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    z = F.when(error > 0, F.abs(a - b) / error).otherwise(F.lit(0.0))
    return stats.withColumn("z", z).drop("_share_ref", "_share_cur")


def numeric_statistics(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], n_buckets: int | None = None
) -> DataFrame:
    """Every statistic of numeric columns from one running sum over values."""
    steps = ranged_cumsum(
        _cells(reference, current, columns, "double"),
        "value",
        ["n_ref", "n_cur"],
        ["column"],
        n_buckets=n_buckets,
    )
    p = F.col("n_ref") / F.col("total_n_ref")
    q = F.col("n_cur") / F.col("total_n_cur")
    gap = F.abs(F.col("cum_n_ref") / F.col("total_n_ref") - F.col("cum_n_cur") / F.col("total_n_cur"))
    sums = _frequency_sums(p, q, F.col("n_ref"), F.col("n_cur"))
    stats = steps.groupBy("column").agg(
        *[v.alias(k) for k, v in sums.items()],
        F.coalesce(F.sum(gap * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("_area"),
        F.max(gap).alias("ks"),
    )
    spread = (
        melt(reference, columns, "double")
        .where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != math.inf))
        .groupBy("column")
        .agg(F.stddev_pop("value").alias("_spread"))
    )
    normed = F.col("_area") / F.greatest(F.col("_spread"), F.lit(MIN_SPREAD))
    return _with_z(stats.join(spread, "column")).select(
        "column",
        F.lit("numeric").alias("kind"),
        *_STATISTICS,
        normed.alias("wasserstein"),
        "ks",
    )


_STATISTICS = (
    "rows_ref", "rows_cur", "distinct_ref", "distinct_all", "jensen_shannon", "chi_square", "z",
)


def categorical_statistics(
    reference: DataFrame, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Every statistic of categorical columns from value counts of both sides."""
    counts = (
        _cells(reference, current, columns, "string")
        .groupBy("column", "value")
        .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    )
    totals = counts.groupBy("column").agg(
        F.sum("n_ref").alias("total_n_ref"), F.sum("n_cur").alias("total_n_cur")
    )
    # One total per monitored column: as small as the argument list.
    joined = counts.join(F.broadcast(totals), "column")
    p = F.col("n_ref") / F.col("total_n_ref")
    q = F.col("n_cur") / F.col("total_n_cur")
    sums = _frequency_sums(p, q, F.col("n_ref"), F.col("n_cur"))
    stats = joined.groupBy("column").agg(*[v.alias(k) for k, v in sums.items()])
    return _with_z(stats).select(
        "column",
        F.lit("categorical").alias("kind"),
        *_STATISTICS,
        F.lit(None).cast("double").alias("wasserstein"),
        F.lit(None).cast("double").alias("ks"),
    )


def kolmogorov_p(distance: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value: the alternating Kolmogorov series."""
    scale = n * m / (n + m)
    term = F.aggregate(
        F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS)),
        F.lit(0.0),
        lambda total, k: total
        + F.when(k % 2 == 1, 2.0).otherwise(-2.0)
        * F.exp(-2.0 * k.cast("double") * k * distance * distance * scale),
    )
    # Below this the series has not settled after the fixed terms and p is 1.
    return F.when(distance * F.sqrt(scale) < 0.05, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), term))
    )


def _exact_kolmogorov(distance: float, n: int, m: int) -> float:
    """Chance that two samples of one continuous distribution lie ``distance`` apart or more.

    The merged order of the samples is a random lattice path from (0, 0) to (n, m); the
    chance that it leaves the band |i/n - j/m| < distance is summed diagonal by diagonal.
    """
    limit = round(distance * n * m)  # on whole numbers, so that a tie counts as reached
    if limit <= 0:
        return 1.0
    inside, outside = np.zeros(n + 1), 0.0
    inside[0] = 1.0
    i = np.arange(n + 1)
    for step in range(n + m):
        up = inside * np.clip((n - i) / (n + m - step), 0.0, 1.0)
        inside = inside - up
        inside[1:] += up[:-1]
        j = step + 1 - i
        crossed = (np.abs(i * m - j * n) >= limit) & (inside > 0)
        outside += inside[crossed].sum()
        inside[crossed] = 0.0
    return min(1.0, outside)


@pandas_udf(T.DoubleType())
def _exact_kolmogorov_p(distance: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    rows = zip(distance, n, m)
    return pd.Series(
        [
            None if pd.isna(d) or min(a, b) < 1 or max(a, b) > EXACT_ROWS else _exact_kolmogorov(d, int(a), int(b))
            for d, a, b in rows
        ]
    )


def two_sample_p(distance: Column, n: Column, m: Column) -> Column:
    """Two-sample p-value of a Kolmogorov-Smirnov distance: exact for samples of up to
    ``EXACT_ROWS`` rows each, which are few rows of statistics and not of data, else by
    the asymptotic series."""
    return F.coalesce(_exact_kolmogorov_p(distance, n, m), kolmogorov_p(distance, n, m))


@pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


def _chi_square_tail(x: float, freedom: int) -> float:
    """Upper tail: the regularised incomplete gamma function, by its series below the
    mean and its continued fraction above.  Either settles within a few times the
    square root of the degrees of freedom."""
    if math.isinf(x):
        return 0.0
    if freedom < 1 or x <= 0:
        return 1.0
    a, z = freedom / 2, x / 2
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        order = a
        while term > total * 1e-16:
            order += 1
            term *= z / order
            total += term
        return max(0.0, 1 - scale * total)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    fraction, step, k = d, 0.0, 0
    while abs(step - 1) > 1e-15 and k < 1_000_000:
        k += 1
        factor = -k * (k - a)
        b += 2
        d = factor * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + factor / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        fraction *= step
    return min(1.0, scale * fraction)


@pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, freedom: pd.Series) -> pd.Series:
    pairs = zip(x, freedom)
    return pd.Series([None if pd.isna(a) else _chi_square_tail(a, int(b)) for a, b in pairs])


def drift_by_column(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    n_buckets: int | None = None,
    tests: Mapping[str, str] | None = None,
    policy: Column | None = None,
) -> DataFrame:
    """One row per monitored column: test name, score, drifted or not, and every
    statistic and p-value beside them.

    ``tests`` fixes a column's test by name.  Other columns follow ``policy``, a column
    over the statistics and their ``kind``: :func:`test_by_reference_size` unless
    another is given, such as :func:`distance_tests`, which holds at every size.
    """
    numeric = common_columns(numeric, reference, current)
    categorical = common_columns(categorical, reference, current)
    parts = []
    if numeric:
        parts.append(numeric_statistics(reference, current, numeric, n_buckets))
    if categorical:
        parts.append(categorical_statistics(reference, current, categorical))
    if not parts:
        raise ValueError("no monitored column is in both tables")
    stats = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    test = test_by_reference_size() if policy is None else policy
    if tests:
        pairs = [F.lit(part) for item in tests.items() for part in item]
        test = F.coalesce(F.create_map(*pairs)[F.col("column")], test)
    named = stats.withColumns(
        {
            "stattest": test,
            "ks_p": two_sample_p(F.col("ks"), F.col("rows_ref"), F.col("rows_cur")),
            "z_p": normal_p(F.col("z")),
            "chi_square_p": chi_square_p(F.col("chi_square"), F.col("distinct_all") - 1),
        }
    )
    scores = {
        JENSEN_SHANNON: "jensen_shannon",
        WASSERSTEIN: "wasserstein",
        KOLMOGOROV_SMIRNOV: "ks_p",
        PROPORTION_Z: "z_p",
        CHI_SQUARE: "chi_square_p",
    }
    score = F.coalesce(*[F.when(F.col("stattest") == t, F.col(c)) for t, c in scores.items()])
    by_distance = F.col("stattest").isin(JENSEN_SHANNON, WASSERSTEIN)
    drifted = F.when(by_distance, score >= DISTANCE_LIMIT).otherwise(score < P_LIMIT)
    return named.select(
        "column",
        "stattest",
        F.round(score, 4).alias("drift_score"),
        drifted.alias("drift_detected"),
        "rows_ref",
        "rows_cur",
        "chi_square",
        "z",
        "ks",
        *scores.values(),
    )


def test_by_reference_size() -> Column:
    """The test a column gets by default: a numeric column with few distinct values is
    tested as a category, a reference of more than 1,000 rows is judged by a
    distance, a smaller one by a p-value."""
    counted = (F.col("kind") == "categorical") | (F.col("distinct_ref") <= FEW_VALUES)
    large = F.col("rows_ref") > LARGE_REFERENCE
    return (
        F.when(large & counted, JENSEN_SHANNON)
        .when(large, WASSERSTEIN)
        .when(counted & (F.col("distinct_all") <= 2), PROPORTION_Z)
        .when(counted, CHI_SQUARE)
        .otherwise(KOLMOGOROV_SMIRNOV)
    )


def distance_tests() -> Column:
    """A distance for every column, whatever the sizes."""
    return F.when(F.col("kind") == "categorical", JENSEN_SHANNON).otherwise(WASSERSTEIN)


def drift_summary(columns: DataFrame, drift_share: float = DRIFT_SHARE) -> DataFrame:
    """One dataset row from the per-column rows."""
    drifted = F.col("drift_detected")
    return columns.agg(
        (F.avg(drifted.cast("double")) >= drift_share).alias("dataset_drift_detected"),
        F.count_if(drifted).alias("n_drifted_columns"),
        F.count_if(~drifted).alias("n_not_drifted_columns"),
        F.sort_array(F.collect_list(F.when(drifted, F.col("column")))).alias("drifted_columns"),
    )


def save_drift(columns: DataFrame, path: str) -> None:
    """Append the per-column rows with a timestamp."""
    columns.withColumn("generated_at", F.current_timestamp()).write.mode("append").parquet(path)


def drift_event(summary: DataFrame) -> DataFrame:
    """The dataset row as one ``drift_detection`` event."""
    return summary.select(
        F.current_timestamp().alias("timestamp"),
        F.lit("drift_detection").alias("event_type"),
        F.to_json(F.struct(*summary.columns)).alias("payload"),
    )
