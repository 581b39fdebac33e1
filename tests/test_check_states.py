from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyfern.operators import check_states, quality

def rules_of_all_kinds():
    return [
        quality.required_columns(["id", "age", "gone"]),
        quality.no_duplicate_ids("id"),
        replace(quality.no_duplicate_ids("y"), check="labels"),
        quality.numeric_range("age"),
        quality.allowed_values("y", ("yes", "no")),
        quality.nonempty_text("text"),
        quality.parseable_date("day"),
        quality.nonnegative("lost"),
    ]


SCHEMA = "id long, age string, y string, text string, day string, part int"


def rows(n=300):
    rng = random.Random(8)
    return [
        (rng.choice([None, *range(80)]), rng.choice(["17", "30", "x", None]),
         rng.choice(["yes", "no", "maybe", "perhaps", None]), rng.choice(["a", " ", None]),
         rng.choice(["2024-01-31", "2024-02-31", None]), rng.randrange(4))
        for _ in range(n)
    ]


def plain(records):
    return sorted((r["check"], r["passed"], r["failures"], sorted(r["details"].items())) for r in records.collect())


def test_states_of_parts_give_the_records_of_the_whole(spark):
    rules = rules_of_all_kinds()
    table = spark.createDataFrame(rows(), SCHEMA)
    want = plain(quality.run_checks(table, "d", rules))
    states = [check_states.check_state(table.where(F.col("part") == i), rules) for i in range(4)]
    whole = check_states.check_state(table, rules)
    assert plain(check_states.state_records(whole, "d", rules)) == want
    one = check_states.merge_states(*states)
    two = check_states.merge_states(check_states.merge_states(states[3], states[1]), states[0], states[2])
    key = lambda r: (r["check"], r["name"], r["key"] or "")
    pairs = [sorted(map(tuple, s.where("name <> '#missing' AND name <> '#absent'").collect()), key=str) for s in (one, two, whole)]
    assert pairs[0] == pairs[1] == pairs[2] and sorted(one.collect(), key=key) == sorted(two.collect(), key=key)
    assert plain(check_states.state_records(one, "d", rules)) == want


def test_stored_parts_are_replaced_not_added(spark, tmp_path):
    rules = rules_of_all_kinds()
    table, base = spark.createDataFrame(rows(), SCHEMA), str(tmp_path / "states")
    for i in (0, 1, 2, 3, 2):
        check_states.append_state(table.where(F.col("part") == i), rules, base, f"p{i}")
    stored = check_states.stored_states(spark, base)
    assert {r["part"] for r in stored.select("part").distinct().collect()} == {"p0", "p1", "p2", "p3"}
    records = check_states.state_records(stored, "d", rules)
    assert plain(records) == plain(quality.run_checks(table, "d", rules))
    assert quality.summary(records).first()["n_checks"] == len(rules)


def test_a_column_absent_from_one_part_and_empty_parts(spark):
    table = spark.createDataFrame(rows(40), SCHEMA)
    rules = [quality.numeric_range("age"), quality.no_duplicate_ids("id")]
    lacking = check_states.check_state(table.drop("age"), rules)
    both = check_states.merge_states(check_states.check_state(table, rules), lacking)
    got = {r["check"]: r for r in check_states.state_records(both, "d", rules).collect()}
    assert got["age_range"]["failures"] == 1 and got["age_range"]["details"] == {"error": "Column 'age' not found"}
    assert got["no_duplicate_ids"]["failures"] == 80 - table.select("id").distinct().count()
    none = check_states.check_state(table.limit(0), rules)
    assert all(r["passed"] for r in check_states.state_records(none, "d", rules).collect())
    with pytest.raises(ValueError):
        check_states.check_state(table, [*rules, rules[0]])


def test_ids_of_a_new_part_that_are_stored(spark, tmp_path):
    rule, base = quality.no_duplicate_ids("id"), str(tmp_path / "s")
    check_states.append_state(spark.createDataFrame([(1,), (2,), (None,)], "id long"), [rule], base, "a")
    new = spark.createDataFrame([(2,), (2,), (3,), (None,)], "id long")
    found = check_states.repeated_ids(new, check_states.stored_states(spark, base), rule)
    assert {tuple(r) for r in found.collect()} == {(2, 2), (None, 1)}
