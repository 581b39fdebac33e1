"""Quality rules over growing tables: mergeable states, one for each appended part.

A state is a table of counts: violations by rule, rows by digest of an id, rows by
unexpected value, absent columns.  States add up, in any order and grouping, to the
state of all parts together, so a new part is read alone and the older ones never again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators.quality import Rule, absent_column, record, unexpected_values

STATE = "check string, name string, key string, n bigint"
#: Names of the counts that are not a rule's own.
IDS, UNEXPECTED, MISSING, ABSENT = "#ids", "#unexpected", "#missing", "#absent"


def check_state(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``check, name, key, n`` of one table or part of a table.

    One aggregate holds all counting rules; uniqueness adds a shuffle of 64 hex digits
    an id after a map-side count, so a frequent id is one row.  Missing ids are equal
    to each other and have the empty key.  An empty part gives counts of zero.
    """
    names = [rule.check for rule in rules]
    if len(set(names)) < len(names):
        raise ValueError(f"checks share a name: {sorted({n for n in names if names.count(n) > 1})}")
    fixed: list[Column] = []
    counts: list[tuple[str, str, Column]] = []
    parts: list[DataFrame] = []

    def entry(check: str, name: str, key: Column, n: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"),
            F.lit(name).alias("name"),
            key.cast("string").alias("key"),
            n.cast("bigint").alias("n"),
        )

    for rule in rules:
        gone = absent_column(rule, df.columns)
        if rule.required is not None:
            missing = [c for c in rule.required if c not in df.columns]
            fixed += [entry(rule.check, MISSING, F.lit(c), F.lit(1)) for c in missing]
        elif gone is not None:
            fixed.append(entry(rule.check, ABSENT, F.lit(gone), F.lit(1)))
        elif rule.unique is not None:
            key = F.sha2(F.col(f"`{rule.unique}`").cast("string"), 256)
            ids = df.groupBy(F.coalesce(key, F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(ids.select(F.inline(F.array(entry(rule.check, IDS, F.col("k"), F.col("n"))))))
        else:
            counts += [(rule.check, name, condition) for name, condition in rule.counts.items()]
            if rule.unexpected:
                values = unexpected_values(df, *rule.unexpected)
                made = entry(rule.check, UNEXPECTED, F.col("value"), F.col("n_rows"))
                parts.append(values.select(F.inline(F.array(made))))
    if counts:
        totals = df.agg(*[F.count_if(c).alias(f"_{i}") for i, (_, _, c) in enumerate(counts)])
        entries = [
            entry(check, name, F.lit(None), F.col(f"_{i}")) for i, (check, name, _) in enumerate(counts)
        ]
        parts.append(totals.select(F.inline(F.array(*entries))))
    if fixed:
        parts.append(df.sparkSession.range(1).select(F.inline(F.array(*fixed))))
    if not parts:
        return df.sparkSession.createDataFrame([], STATE)
    return reduce(DataFrame.unionByName, parts)


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all parts together; associative, commutative, and of one state itself."""
    together = reduce(DataFrame.unionByName, [s.select("check", "name", "key", "n") for s in states])
    return together.groupBy("check", "name", "key").agg(F.sum("n").alias("n"))


def state_records(state: DataFrame, dataset: str, rules: Sequence[Rule]) -> DataFrame:
    """The records that ``run_checks`` gives for all parts of ``state`` as one table.

    Reads no part, only states: a shuffle of digests and unexpected values, then a
    few rows a rule.  A column counts as absent if any part lacks it.
    """
    folded = merge_states(state).groupBy("check", "name").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") - 1).alias("extra"),  # rows beyond the first of each id
        F.count(F.lit(1)).alias("keys"),
        F.min("key").alias("first"),
        # column names of a rule only: as few as its arguments
        F.collect_set(F.when(F.col("name") == MISSING, F.col("key"))).alias("missing"),
    )
    # a few rows a rule
    entry = F.struct(F.concat_ws("\n", "check", "name"), F.struct("n", "extra", "keys", "first", "missing"))
    totals = folded.agg(F.map_from_entries(F.collect_list(entry)).alias("counts"))

    def of(rule: Rule, name: str) -> Column:
        return F.col("counts").getItem(f"{rule.check}\n{name}")

    records = []
    for rule in rules:
        if rule.required is not None:
            found = F.coalesce(of(rule, MISSING)["missing"], F.array().cast("array<string>"))
            gone = F.array_intersect(F.array(*[F.lit(c) for c in rule.required]), found)
            records.append(record(dataset, rule, F.size(gone), {"missing_columns": F.concat_ws(",", gone)}))
            continue
        details = {k: F.lit(v) for k, v in rule.notes.items()}
        if rule.unique is not None:
            failures = F.coalesce(of(rule, IDS)["extra"], F.lit(0))
            details["duplicate_count"] = failures
        else:
            found = {c: F.coalesce(of(rule, c)["n"], F.lit(0)) for c in rule.counts}
            failures = sum((found[c] for c in rule.failures), F.lit(0))
            details.update(found)
            if rule.unexpected:
                details["unexpected_distinct"] = F.coalesce(of(rule, UNEXPECTED)["keys"], F.lit(0))
        name = of(rule, ABSENT)["first"]
        error = F.concat(F.lit("Column '"), name, F.lit("' not found"))
        broken = record(dataset, rule, F.lit(1), {"error": error})
        records.append(F.when(name.isNull(), record(dataset, rule, failures, details)).otherwise(broken))
    return totals.select(F.inline(F.array(*records)))


def append_state(part: DataFrame, rules: Sequence[Rule], base: str, name: str) -> None:
    """Check a new part alone and keep its state below ``base`` as ``part=<name>``.

    A part checked again replaces its own state, so a repeated run changes nothing; parts
    may be written by several jobs at once.
    """
    check_state(part, rules).write.mode("overwrite").parquet(f"{base}/part={name}")


def stored_states(spark: SparkSession, base: str) -> DataFrame:
    """The states of all parts below ``base``, with the column ``part``."""
    return spark.read.schema(f"{STATE}, part string").parquet(base)


def repeated_ids(part: DataFrame, stored: DataFrame, rule: Rule) -> DataFrame:
    """``id`` and ``n`` of a part's ids that other, already stored parts have too."""
    column = F.col(f"`{rule.unique}`")
    ids = part.groupBy(column.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    key = F.coalesce(F.sha2(F.col("id").cast("string"), 256), F.lit(""))
    known = stored.where((F.col("check") == rule.check) & (F.col("name") == IDS)).select("key")
    return ids.withColumn("key", key).join(known, "key", "left_semi").drop("key")
