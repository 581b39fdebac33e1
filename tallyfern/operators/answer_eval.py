"""Judging answer records against expectations (Q1-Q3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators.answers import PROMPT_VERSION

PREVIEW = 200

# The question set that answers are judged on (id, question, whether a
# refusal is expected, description).
CASES = (
    ("tc01", "What are the most common issues with credit cards?", False, "General credit card complaint query"),
    ("tc02", "How do banks handle billing disputes?", False, "Billing dispute resolution query"),
    ("tc03", "What problems do customers face with mortgage loans?", False, "Mortgage complaint query"),
    ("tc04", "Are there complaints about debt collection practices?", False, "Debt collection issues query"),
    ("tc05", "What are common issues with student loan servicers?", False, "Student loan servicing query"),
    ("tc06", "How frequently do consumers complain about identity theft?", False, "Identity theft complaint frequency"),
    ("tc07", "What issues arise with checking and savings accounts?", False, "Checking account complaints query"),
    ("tc08", "Do complaints mention issues with credit reporting?", False, "Credit reporting issues query"),
    ("tc09", "What are common auto loan complaints?", False, "Auto loan complaint query"),
    ("tc10", "xyzzyqwerty123456 nonsense query with no match", True, "Nonsense query \u2014 should be refused"),
    ("tc11", "What happens when a bank ignores a customer's dispute?", False, "Bank dispute resolution failure query"),
    ("tc12", "Are there payday loan complaints in the data?", False, "Payday loan query"),
)


def default_cases(spark: SparkSession) -> DataFrame:
    kinds = "query_id string, question string, expect_refused boolean, description string"
    return spark.createDataFrame(list(CASES), kinds)


def judge_cases(
    cases: DataFrame, records: DataFrame, query_key: str = "query_id", version: str = PROMPT_VERSION
) -> DataFrame:
    """One row per case with its criteria and verdict.

    A case that expects a refusal passes when it is refused.  Any other passes
    with an answer, evidence and the expected prompt version.  A case without a
    record fails.
    """
    answered = records.select(
        query_key,
        F.col("refused").alias("actual_refused"),
        "answer",
        "evidence_ids",
        "evidence_sufficiency",
        "prompt_version",
        "retrieval_count",
    )
    expected = F.coalesce(F.col("expect_refused"), F.lit(False))
    refused = F.coalesce(F.col("actual_refused"), F.lit(True))
    criteria = {
        "answer_present": F.coalesce(F.col("answer") != "", F.lit(False)) & ~refused,
        "refusal_correct": F.coalesce(F.col("actual_refused") == expected, F.lit(False)),
        "evidence_ids_present": F.coalesce(F.size("evidence_ids") > 0, F.lit(False)),
        "prompt_version_ok": F.coalesce(F.col("prompt_version") == version, F.lit(False)),
    }
    judged = cases.join(answered, query_key, "left").withColumns(criteria)
    full = F.col("answer_present") & F.col("evidence_ids_present") & F.col("prompt_version_ok")
    return judged.withColumn(
        "passed", F.when(expected, F.col("refusal_correct")).otherwise(full)
    ).withColumn("answer_preview", F.coalesce(F.substring("answer", 1, PREVIEW), F.lit("")))


def eval_report(judged: DataFrame) -> DataFrame:
    """Totals and pass rate; the rate of no cases is 0."""
    n, passed = F.count(F.lit(1)), F.count_if("passed")
    return judged.agg(
        n.alias("total_cases"),
        passed.alias("passed"),
        (n - passed).alias("failed"),
        F.when(n == 0, F.lit(0.0)).otherwise(F.round(passed / n, 4)).alias("pass_rate"),
    )
