from __future__ import annotations

import random
import shutil
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyfern.operators import telemetry
from tallyfern.streaming import running, streams

SCHEMA = "timestamp timestamp, event_type string, x double"
START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def log(rng, minutes, n, resets):
    """Events of two types over some minutes, and resets at given minutes."""
    made = [
        (START + timedelta(seconds=rng.randrange(minutes * 60)), rng.choice(["a", "b", "other"]),
         rng.choice([None, float(rng.randrange(50))]))
        for _ in range(n)
    ]
    return made + [(START + timedelta(minutes=m), running.RESET, None) for m in resets]


def brute(events):
    last = max((t for t, e, _ in events if e == running.RESET), default=None)
    sums = {"a": [0, 0.0, 0], "b": [0, 0.0, 0]}
    for t, e, x in events:
        if e in sums and (last is None or t > last):
            sums[e][0] += 1
            sums[e][1] += x or 0.0
            sums[e][2] += x is not None
    return {e: (n, round(s / c, 9) if c else None) for e, (n, s, c) in sums.items()}


def run(spark, place, batches, idle=10_000):
    """The latest summaries after each batch has arrived, in a query that is started anew."""
    found, folder = [], place / "in"
    folder.mkdir(parents=True)
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(place / f"made{i}"))
        part = next((place / f"made{i}").glob("part-*.parquet"))
        shutil.copy(part, folder / f"{i}.parquet")
        events = streams.read_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema)
        summaries = running.running_summaries(
            events, {"x": F.col("x")}, ["a", "b"], lateness_minutes=10, idle_minutes=idle, n_lanes=2
        )
        running.run_summaries(summaries, str(place / "out"), str(place / "log")).awaitTermination()
        rows = running.latest(spark.read.parquet(str(place / "out")), ["x"]).collect()
        found.append({r["event_type"]: (r["n_events"], r["avg_x"] and round(r["avg_x"], 9)) for r in rows})
    return found


def test_summaries_follow_resets_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(2)
    events = sorted(log(rng, 30, 120, [7, 19]), key=lambda e: e[0])
    # arrival is shuffled by up to eight minutes, so resets come after later events too
    arrival = sorted(events, key=lambda e: e[0] + timedelta(seconds=rng.randrange(480)))
    cuts = [arrival[:50], arrival[50:90], arrival[90:]]
    seen = run(spark, tmp_path / "one", cuts)
    for i, got in enumerate(seen):
        assert got == brute([e for cut in cuts[: i + 1] for e in cut])
    assert run(spark, tmp_path / "two", [events])[-1] == seen[-1] == brute(events)


def test_idle_keys_are_closed_and_a_reset_after_that_still_clears(spark, tmp_path):
    rng = random.Random(4)
    early = log(rng, 20, 40, [])
    later = [(START + timedelta(hours=5), "a", 3.0)]
    reset = [(START + timedelta(hours=9), running.RESET, None)]
    last = [(START + timedelta(hours=14), "b", 8.0)]
    seen = run(spark, tmp_path / "idle", [early, later, reset, last], idle=30)
    assert seen[0] == brute(early) and seen[1] == brute(early + later)
    assert seen[2] == {"a": (0, None), "b": (0, None)} and seen[3] == {"a": (0, None), "b": (1, 8.0)}
    stored = spark.read.parquet(str(tmp_path / "idle" / "out"))
    assert stored.where("closed").count() > 0
    epochs = defaultdict(set)
    for r in stored.collect():
        epochs[r["event_type"], r["lane"]].add(r["epoch"])
    assert max(map(len, epochs.values())) >= 2


def test_equal_times_missing_times_and_bounds(spark, tmp_path):
    at = START + timedelta(minutes=3)
    events = [(at, "a", 1.0), (at, running.RESET, None), (at + timedelta(microseconds=1), "a", 2.0), (None, "a", 5.0)]
    assert run(spark, tmp_path / "ties", [events])[-1] == {"a": (1, 2.0), "b": (0, None)}
    with pytest.raises(ValueError):
        running.running_summaries(spark.createDataFrame([], SCHEMA), {}, ["a"], idle_minutes=1)


def test_means_equal_the_batch_summary(spark, tmp_path):
    rng = random.Random(6)
    rows = [(START + timedelta(seconds=i), telemetry.PREDICTION, float(rng.randrange(100))) for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = streams.read_stream(spark, str(tmp_path / "in"), table.schema)
    found = running.running_summaries(events, {"latency_ms": F.col("x")}, [telemetry.PREDICTION])
    running.run_summaries(found, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = running.latest(spark.read.parquet(str(tmp_path / "out")), ["latency_ms"]).first()
    scored = table.select(F.lit(0.5).alias("probability"), F.lit(1).alias("prediction"), F.col("x").alias("latency_ms"))
    want = telemetry.prediction_summary(scored).first()
    assert got["n_events"] == want["count"] and round(got["avg_latency_ms"], 3) == want["avg_latency_ms"]
