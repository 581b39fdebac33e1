"""Promotion gate over two metric rows, and its append-only log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Gate thresholds and the slack of the second test.
MIN_PR_AUC_GAIN = 0.03
MAX_F1_LOSS = 0.02
F1_SLACK = 1e-9

# Rejection texts.
PR_AUC_REASON = "PR-AUC improvement %+.4f is below the required +%.2f threshold."
F1_REASON = "F1 degradation %.4f exceeds the allowed %.2f limit."


def promotion_gate(
    metrics: DataFrame,
    baseline: str,
    improved: str,
    model: str = "model",
    min_pr_auc_gain: float = MIN_PR_AUC_GAIN,
    max_f1_loss: float = MAX_F1_LOSS,
) -> DataFrame:
    """One decision row: both deltas, both checks, reasons, thresholds, inputs."""

    kept = ("pr_auc", "f1", "roc_auc")
    both = metrics.where(F.col(model).isin(baseline, improved)).agg(
        *[
            F.max(F.when(F.col(model) == name, F.col(m))).alias(f"{side}_{m}")
            for side, name in (("baseline", baseline), ("improved", improved))
            for m in kept
        ]
    )
    gain = F.col("improved_pr_auc") - F.col("baseline_pr_auc")
    change = F.col("improved_f1") - F.col("baseline_f1")
    gain_limit, loss_limit = F.lit(float(min_pr_auc_gain)), F.lit(float(max_f1_loss))
    gained = F.coalesce(gain >= gain_limit, F.lit(False))
    held = F.coalesce(-change <= loss_limit + F.lit(F1_SLACK), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(~gained, F.format_string(PR_AUC_REASON, gain, gain_limit)),
            F.when(~held, F.format_string(F1_REASON, -change, loss_limit)),
        )
    )
    return both.select(
        (gained & held).alias("promoted"),
        F.round(gain, 6).alias("pr_auc_delta"),
        F.round(change, 6).alias("f1_delta"),
        gained.alias("pr_auc_check"),
        held.alias("f1_check"),
        reasons.alias("rejection_reasons"),
        gain_limit.alias("pr_auc_min_improvement"),
        loss_limit.alias("f1_max_degradation"),
        *both.columns,
    )


def log_decision(
    decision: DataFrame, path: str, run_metadata: Mapping[str, str] | None = None
) -> None:
    """Append the decision with a timestamp and the run's metadata."""
    pairs = [F.lit(str(part)) for item in (run_metadata or {}).items() for part in item]
    metadata = F.create_map(*pairs) if pairs else F.create_map()
    decision.select(
        F.current_timestamp().alias("timestamp"),
        "*",
        metadata.cast("map<string,string>").alias("run_metadata"),
    ).write.mode("append").parquet(path)


def gate_and_log(
    metrics: DataFrame,
    baseline: str,
    improved: str,
    path: str,
    run_metadata: Mapping[str, str] | None = None,
    **limits,
) -> DataFrame:
    decision = promotion_gate(metrics, baseline, improved, **limits)
    log_decision(decision, path, run_metadata)
    return decision
