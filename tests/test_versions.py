"""Index versions: key records, and reads that leave the first version where it lies."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfern.sources import tables

COLUMNS = "chunk_id string, text string, n long"


def rows_of(keys, mark):
    return [(f"k{i:05d}", f"{mark} {i}", i) for i in keys]


@pytest.fixture(scope="module")
def sixteen(spark, tmp_path_factory):
    """A bulk version and fifteen edits with new, replaced and twice replaced keys."""
    base = str(tmp_path_factory.mktemp("versions") / "index")
    parts = [rows_of(range(2_000), "first")]
    parts += [rows_of([*range(40 * v, 40 * v + 60), 5_000 + v], f"edit {v}") for v in range(15)]
    expected = {}
    for part in parts:
        tables.upsert_version(spark.createDataFrame(part, COLUMNS), base)
        expected.update({k: t for k, t, _ in part})
    return base, expected


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_chunk_of_the_first_version_moves(spark, sixteen):
    base, expected = sixteen
    read = tables.read_index(spark, base)
    plan = plan_of(read)
    # The only exchange carries the replaced keys; the scan of the rows is not below one.
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert {r.chunk_id: r.text for r in read.collect()} == expected


def test_many_replaced_keys_move_only_rows_that_may_be_replaced(spark, sixteen, monkeypatch):
    base, expected = sixteen
    monkeypatch.setattr(tables, "small_side", lambda df: df)
    read = tables.read_index(spark, base)
    got = read.collect()
    assert len(got) == len(expected) and {r.chunk_id: r.text for r in got} == expected


def test_filters_admit_all_their_keys_and_few_others(spark):
    keys = spark.range(3_000).select(F.concat(F.lit("in"), "id").alias("k"))
    record = tables.key_record(keys, "k")
    small = tables.key_record(keys.where("k = 'in5'"), "k")
    assert (record.rows, record.low, record.high) == (3_000, "in0", "in999")
    assert tables.KeyRecord.parse(record.text()) == record and len(small.bits) < len(record.bits)
    asked = spark.range(6_000).select(F.concat(F.lit("in"), "id").alias("k"), "id")
    seen = asked.where(tables.may_hold(F.col("k"), [small, record])).agg(
        F.count_if(F.col("id") < 3_000).alias("own"), F.count_if(F.col("id") >= 3_000).alias("others")
    ).first()
    assert seen.own == 3_000 and seen.others < 150
    bits = np.unpackbits(np.frombuffer(record.bits, np.uint8)).mean()
    assert 0.05 < bits < 0.6
    none = tables.key_record(keys.where("false"), "k")
    assert asked.where(tables.may_hold(F.col("k"), [none])).count() == 0


def test_a_full_filter_admits_every_key(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_BITS", tables.LEAST_BITS)
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    record = tables.key_record(keys, "k")
    assert len(record.bits) * 8 == tables.LEAST_BITS
    assert keys.where(tables.may_hold(F.col("k"), [record])).count() == 20_000


def test_versions_without_records_repeats_and_replays(spark, tmp_path):
    base = str(tmp_path / "index")
    first = spark.createDataFrame([*rows_of(range(5), "a"), ("k00001", "z", 0)], COLUMNS)
    assert tables.write_version(first, base, "one") == 0
    assert tables.write_version(first, base, "one") == 0
    tables.write_version(spark.createDataFrame(rows_of([3, 9], "b"), COLUMNS), base, "two")
    expected = {"k00000": "a 0", "k00001": "z", "k00002": "a 2", "k00003": "b 3", "k00004": "a 4", "k00009": "b 9"}
    assert {r.chunk_id: r.text for r in tables.read_index(spark, base).collect()} == expected
    tables.remove(spark, f"{base}/{tables.RECORDS}")  # an index of an earlier release
    assert {r.chunk_id: r.text for r in tables.read_index(spark, base).collect()} == expected
    tables.compact(spark, base)
    assert {r.chunk_id: r.text for r in tables.read_index(spark, base).collect()} == expected
