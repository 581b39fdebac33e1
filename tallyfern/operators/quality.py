"""Data-quality rules as one conditional aggregate per table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.functions.text import is_nonempty, strip
from tallyfern.sources.readers import BANK_CATEGORIES, BANK_DOUBLES

# Suite names, columns and bounds.
BANK_DATASET = "bank_marketing"
BANK_COLUMNS = (
    "age", "job", "marital", "education", "default", "housing", "loan",
    "contact", "month", "day_of_week", "duration", "campaign", "pdays",
    "previous", "poutcome", "emp_var_rate", "cons_price_idx",
    "cons_conf_idx", "euribor3m", "nr_employed", "y",
)
BANK_TARGET_VALUES = ("yes", "no")
COMPLAINT_DATASET = "cfpb_complaints"
COMPLAINT_COLUMNS = (
    "complaint_id", "product", "issue", "company", "date_received", "complaint_narrative",
)
AGE_BOUNDS = (18, 100)


@dataclass(frozen=True)
class Rule:
    """One check: columns it needs, named counts, and which of them are failures."""

    check: str
    columns: tuple[str, ...]
    counts: dict[str, Column]
    failures: tuple[str, ...]
    notes: dict[str, str] = field(default_factory=dict)
    # Set on rules that need more than the shared pass.
    unique: str | None = None
    unexpected: tuple[str, tuple[str, ...]] | None = None
    required: tuple[str, ...] | None = None


def _number(column: str) -> Column:
    """The value as a double, or null when it is not a number."""
    value = F.col(f"`{column}`").cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def required_columns(columns: Sequence[str]) -> Rule:
    return Rule("required_columns", (), {}, (), required=tuple(columns))


def no_duplicate_ids(column: str) -> Rule:
    """Rows beyond the first of each id; missing ids are equal to each other."""
    return Rule("no_duplicate_ids", (column,), {}, (), {"id_column": column}, unique=column)


def numeric_range(
    column: str = "age",
    low: float = AGE_BOUNDS[0],
    high: float = AGE_BOUNDS[1],
    check: str = "age_range",
) -> Rule:
    """Missing, unparseable and out-of-bounds values fail; bounds are inclusive."""
    value = _number(column)
    bad = value.isNull() | (value < low) | (value > high)
    return Rule(
        check,
        (column,),
        {"out_of_range_count": bad},
        ("out_of_range_count",),
        {"min_age": str(low), "max_age": str(high)},
    )


def allowed_values(
    column: str = "y", valid: Sequence[str] | None = None, check: str = "target_column"
) -> Rule:
    """Nulls fail, and so do values outside ``valid`` when it is given."""
    c = F.col(f"`{column}`")
    outside = F.lit(False) if valid is None else c.isNotNull() & ~c.isin(*valid)
    return Rule(
        check,
        (column,),
        {"null_count": c.isNull(), "invalid_value_count": outside},
        ("null_count", "invalid_value_count"),
        unexpected=None if valid is None else (column, tuple(valid)),
    )


def nonempty_text(column: str = "complaint_narrative", check: str = "nonempty_complaints") -> Rule:
    bad = ~is_nonempty(F.col(f"`{column}`").cast("string"))
    return Rule(check, (column,), {"empty_narrative_count": bad}, ("empty_narrative_count",))


def nonnegative(column: str = "duration", check: str = "duration_values") -> Rule:
    value = _number(column)
    bad = value.isNull() | (value < 0)
    return Rule(check, (column,), {"invalid_duration_count": bad}, ("invalid_duration_count",))


def parseable_date(
    column: str = "date_received", pattern: str = "yyyy-MM-dd", check: str = "complaint_dates"
) -> Rule:
    bad = F.try_to_date(F.col(f"`{column}`").cast("string"), pattern).isNull()
    return Rule(
        check, (column,), {"unparseable_count": bad}, ("unparseable_count",), {"date_column": column}
    )


def record(dataset: str, rule: Rule, failures: Column, details: dict[str, Column]) -> Column:
    """One long-form record; ``details`` values become strings."""
    pairs = [part for k, v in details.items() for part in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(dataset).alias("dataset"),
        F.lit(rule.check).alias("check"),
        (failures == 0).alias("passed"),
        failures.cast("bigint").alias("failures"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias(
            "details"
        ),
    )


def absent_column(rule: Rule, columns: Sequence[str]) -> str | None:
    """The first column of a rule that a table has not."""
    return next((c for c in rule.columns if c not in columns), None)


def _missing(dataset: str, rule: Rule, df: DataFrame) -> Column | None:
    """The failed record of a rule whose column is absent."""
    gone = absent_column(rule, df.columns)
    if gone is None:
        return None
    # Fixed value: the error text of an absent column.
    text = f"Column '{gone}' not found"
    return record(dataset, rule, F.lit(1), {"error": F.lit(text)})


def unexpected_values(df: DataFrame, column: str, valid: Sequence[str]) -> DataFrame:
    """Every distinct value outside ``valid`` with its row count."""
    c = F.col(f"`{column}`")
    return (
        df.where(c.isNotNull() & ~c.isin(*valid))
        .groupBy(c.cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def _listed(df: DataFrame, column: str, valid: Sequence[str]) -> DataFrame:
    """One row with the number of distinct unexpected values; a record holds no list
    of any length, :func:`unexpected_values` has the values as rows."""
    return unexpected_values(df, column, valid).agg(F.count(F.lit(1)).alias("_listed"))


def run_checks(df: DataFrame, dataset: str, rules: Sequence[Rule]) -> DataFrame:
    """``dataset, check, passed, failures, details`` per rule.

    All counting rules share one aggregate over the table.  Uniqueness adds a
    shuffle of the id column, and a value list a scan of its column.  A rule
    whose column is absent fails once and reads nothing.
    """
    spark = df.sparkSession
    shared: list[tuple[Rule, Callable[[str], Column]]] = []
    fixed: list[Column] = []
    parts: list[DataFrame] = []

    for position, rule in enumerate(rules):
        absent = _missing(dataset, rule, df)
        if rule.required is not None:
            gone = [c for c in rule.required if c not in df.columns]
            listed = F.lit(",".join(gone))
            fixed.append(record(dataset, rule, F.lit(len(gone)), {"missing_columns": listed}))
        elif absent is not None:
            fixed.append(absent)
        elif rule.unique is not None:
            value = F.col(f"`{rule.unique}`")
            if df.schema[rule.unique].dataType == T.StringType():
                value = F.sha2(value, 256)  # long texts stay where they are
            ids = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
            extra = ids.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_extra"))
            notes = {k: F.lit(v) for k, v in rule.notes.items()}
            unique = record(
                dataset, rule, F.col("_extra"), {**notes, "duplicate_count": F.col("_extra")}
            )
            parts.append(extra.select(F.inline(F.array(unique))))
        else:
            shared.append((rule, f"_{position}_".__add__))

    if fixed:
        parts.append(spark.range(1).select(F.inline(F.array(*fixed))))
    if shared:
        totals = df.agg(
            *[
                F.count_if(condition).alias(name(count))
                for rule, name in shared
                for count, condition in rule.counts.items()
            ]
        )
        for rule, name in shared:
            if rule.unexpected:
                # A scalar subquery: one value, no join.
                listed = _listed(df, *rule.unexpected).scalar()
                totals = totals.withColumn(name("unexpected_distinct"), listed)
        records = []
        for rule, name in shared:
            failures = sum((F.col(name(c)) for c in rule.failures), F.lit(0))
            details = {k: F.lit(v) for k, v in rule.notes.items()}
            details.update({c: F.col(name(c)) for c in rule.counts})
            if rule.unexpected:
                details["unexpected_distinct"] = F.col(name("unexpected_distinct"))
            records.append(record(dataset, rule, failures, details))
        parts.append(totals.select(F.inline(F.array(*records))))

    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def bank_rules() -> list[Rule]:
    return [
        required_columns(BANK_COLUMNS),
        numeric_range(),
        allowed_values("y", BANK_TARGET_VALUES),
        nonnegative(),
    ]


def complaint_rules() -> list[Rule]:
    return [
        required_columns(COMPLAINT_COLUMNS),
        no_duplicate_ids("complaint_id"),
        nonempty_text(),
        parseable_date(),
    ]


def check_bank(df: DataFrame) -> DataFrame:
    return run_checks(df, BANK_DATASET, bank_rules())


def check_complaints(df: DataFrame) -> DataFrame:
    return run_checks(df, COMPLAINT_DATASET, complaint_rules())


def summary(records: DataFrame) -> DataFrame:
    """Per dataset: all checks passed, number of checks, number failed."""
    return records.groupBy("dataset").agg(
        F.bool_and("passed").alias("passed"),
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(~F.col("passed")).alias("n_failed"),
    )


def run_quality(bank: DataFrame, complaints: DataFrame) -> DataFrame:
    """Records of both suites."""
    return check_bank(bank).unionByName(check_complaints(complaints))


def assert_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


# Lower and upper bounds of a scoring request.
RECORD_BOUNDS = {
    "age": (17, 120),
    "duration": (0, None),
    "campaign": (1, None),
    "previous": (0, None),
    "pdays": (0, None),
}
REQUEST_COLUMNS = (*RECORD_BOUNDS, *BANK_DOUBLES, *BANK_CATEGORIES)
QUESTION_LENGTH = (3, 1000)
TOP_K_BOUNDS = (1, 20)


def _bounded(
    value: Column, name: str, low: float | None, high: float | None, required: bool = True
) -> list[Column]:
    """Error texts of one field, null where it is fine."""
    found = [F.when(value.isNull(), F.lit(f"{name} is missing"))] if required else []
    if low is not None:
        found.append(F.when(value < low, F.lit(f"{name} is below {low}")))
    if high is not None:
        found.append(F.when(value > high, F.lit(f"{name} is above {high}")))
    return found


def record_errors(
    required: Sequence[str] = REQUEST_COLUMNS,
    bounds: dict[str, tuple[float | None, float | None]] | None = None,
) -> Column:
    """Array of the constraint violations of a scoring record; empty when valid."""
    bounds = RECORD_BOUNDS if bounds is None else bounds
    found: list[Column] = []
    for name in required:
        found += _bounded(F.col(f"`{name}`"), name, *bounds.get(name, (None, None)))
    return F.array_compact(F.array(*found))


def question_errors(
    question: str = "question", top_k: str | None = "top_k", optional: bool = False
) -> Column:
    """Violations of a question row.  An optional question may be missing and
    has no lower length."""
    length = F.length(F.col(question))
    low, high = QUESTION_LENGTH
    found = [F.when(F.col(question).isNull(), F.lit("question is missing"))] if not optional else []
    found += _bounded(length, "question length", None if optional else low, high, False)
    if top_k:
        found += _bounded(F.col(top_k), "top_k", *TOP_K_BOUNDS, False)
    return F.array_compact(F.array(*found))


def normalise_categories(df: DataFrame, columns: Sequence[str] = BANK_CATEGORIES) -> DataFrame:
    """Categories stripped and lower-cased."""
    return df.withColumns({c: F.lower(strip(F.col(f"`{c}`"))) for c in columns})
