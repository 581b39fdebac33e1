from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfern.operators import sketches

SCHEMA = "at timestamp, x double, day int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [
        (day, rng.choice([rng.lognormvariate(day / 4, 1), -rng.expovariate(1), 0.0, rng.gauss(0, 1e-9), 5e300]))
        for day in range(1, 5) for _ in range(400)
    ]
    odd = [(1, None), (2, math.nan), (3, math.inf), (4, -math.inf)]
    table = spark.createDataFrame([(f"2024-03-0{d} 10:00:00", x, d) for d, x in [*made, *odd]], "at string, x double, day int")
    return table.withColumn("at", F.col("at").cast("timestamp")), made


def test_windows_merge_to_the_sketch_of_the_whole(spark, rows):
    table, made = rows
    days = sketches.window_sketches(table, ["x", "day"], "at")
    whole = sketches.window_sketches(table, ["x", "day"], "at", "1000 days")
    plain = lambda s: sorted(map(tuple, s.select("column", "bucket", "n").collect()))
    merged = plain(sketches.merge_sketches(days))
    assert merged == plain(sketches.merge_sketches(whole))
    early, late = days.where("window_start < '2024-03-03'"), days.where("window_start >= '2024-03-03'")
    parts = sketches.merge_sketches(early).unionByName(sketches.merge_sketches(late))
    assert plain(sketches.merge_sketches(parts)) == merged
    assert sum(n for c, _, n in merged if c == "x") == len(made)


@pytest.mark.parametrize("alpha", [0.01, 0.2])
def test_quantiles_are_within_their_bound(rows, alpha):
    table, made = rows
    probabilities = [0, 0.1, 0.31, 0.5, 0.77, 0.99, 1]
    days = sketches.window_sketches(table, ["x"], "at", alpha=alpha)
    got = {r["probability"]: r for r in sketches.sketch_quantiles(days, probabilities, alpha=alpha).collect()}
    values = sorted(x for _, x in made)
    for p in probabilities:
        true, row = values[math.floor(p * (len(values) - 1))], got[p]
        assert abs(row["value"] - true) <= alpha * abs(true) * (1 + 1e-9)
        assert abs(row["value"] - true) <= row["error"] * (1 + 1e-9) and row["n"] == len(values)


def test_drift_bounds_hold_the_exact_statistics(spark):
    rng = np.random.default_rng(5)
    days = {d: rng.gamma(2 + d / 2, 3, 300) - 4 for d in range(1, 5)}
    table = spark.createDataFrame([(f"2024-03-0{d}", float(x)) for d, xs in days.items() for x in xs], "at string, x double")
    sketch = sketches.window_sketches(table.withColumn("at", F.col("at").cast("timestamp")), ["x"], "at")
    got = {r["window_start"].day: r for r in sketches.sketch_drift(sketch, sketch).collect()}
    ref = np.sort(np.concatenate(list(days.values())))
    for d, xs in days.items():
        xs, row = np.sort(xs), got[d]
        points = np.unique(np.concatenate([ref, xs]))
        gap = np.abs(np.searchsorted(ref, points, "right") / len(ref) - np.searchsorted(xs, points, "right") / len(xs))
        distance = (gap[:-1] * np.diff(points)).sum() / ref.std()
        assert row["ks"] - 1e-9 <= gap.max() <= row["ks_high"] + 1e-9 and row["rows"] == len(xs)
        assert row["wasserstein_low"] <= distance <= row["wasserstein_high"]
        assert not row["sure"] or row["drift_detected"] == (distance >= 0.1)
    assert sketches.sketch_drift(sketch, sketch.limit(0)).count() == 0
    assert sketches.sketch_drift(sketch.limit(0), sketch).count() == 0


def test_buckets_keep_the_order_of_values(spark):
    values = sorted([0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, -1.0, 0.5, 3.0, 1e-300])
    table = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["b"] for r in table.select("v", sketches.bucket_of(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) == len(values)
    with pytest.raises(ValueError):
        sketches.bucket_of(F.col("v"), 0)
