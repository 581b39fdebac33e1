"""The six end-to-end jobs, composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators import (
    answers,
    drift,
    encoding,
    gate,
    models,
    prep,
    quality,
    retrieval,
    sampling,
)
from tallyfern.operators.chunking import chunk_table
from tallyfern.sources import readers
from tallyfern.sources.tables import cut_lineage, drop_cut, upsert_version, write_table

SEED = 42


def ingest(
    spark: SparkSession,
    bank_folder: str,
    complaints_file: str,
    output: str,
    bank_sample: int | None = None,
    complaints_sample: int | None = None,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Read both datasets, sample those with a size given, and write them."""
    bank = readers.read_bank_marketing(spark, bank_folder)
    if bank_sample is not None:
        bank = sampling.sample_n(bank, bank_sample, seed, bank.columns)
    # Sampling reads the rows several times: parse the CSV once.
    complaints = landed = cut_lineage(readers.read_text_corpus(spark, complaints_file))
    if complaints_sample is not None:
        complaints = sampling.bounded_sample(
            complaints, complaints_sample, seed, complaints.columns
        )
    write_table(bank, f"{output}/bank_sample")
    write_table(complaints, f"{output}/complaints_sample")
    drop_cut(landed)
    return (
        readers.read_sample(spark, f"{output}/bank_sample"),
        readers.read_sample(spark, f"{output}/complaints_sample"),
    )


def check_quality(bank: DataFrame, complaints: DataFrame) -> tuple[DataFrame, bool]:
    """Records of both suites and whether everything passed."""
    records = quality.run_quality(bank, complaints)
    failed = records.where(~F.col("passed")).limit(1).count()
    return records, failed == 0


def build_features(
    bank: DataFrame,
    output: str,
    numeric: Sequence[str] = prep.BANK_NUMERIC,
    categorical: Sequence[str] = readers.BANK_CATEGORIES,
    target: str = readers.BANK_TARGET,
) -> PipelineModel:
    """Validate, fit on all rows, write matrix, contract and fitted state."""
    quality.assert_columns(bank, [*numeric, *categorical, target])
    labelled = prep.encode_target(bank, target)
    model = prep.fit_preprocessor(labelled, numeric=numeric, categorical=categorical)
    write_table(prep.named_features(labelled, model), f"{output}/features")
    prep.save_feature_schema(
        bank.sparkSession, prep.feature_schema(numeric, categorical, target), f"{output}/schema"
    )
    models.save_model(model, f"{output}/preprocessor")
    return model


def train_and_gate(
    bank: DataFrame,
    keys: Sequence[str],
    output: str,
    numeric: Sequence[str] = prep.BANK_NUMERIC,
    categorical: Sequence[str] = readers.BANK_CATEGORIES,
    target: str = readers.BANK_TARGET,
    **options,
) -> DataFrame:
    """Train both models, log their run, save them and log the gate's decision."""
    labelled = prep.encode_target(bank, target)
    fitted, metrics, seconds = models.train_both(labelled, keys, numeric, categorical, **options)
    metrics = cut_lineage(metrics)
    for name, took in seconds.items():
        models.log_run(metrics.where(F.col("model") == name), f"{output}/runs", options, took)
    for name, model in fitted.items():
        models.save_model(model, f"{output}/{name}")
    return gate.gate_and_log(
        metrics, models.BASELINE, models.BOOSTED, f"{output}/gate_log", options
    )


def build_index(
    documents: DataFrame,
    base: str,
    model_path: str,
    text_column: str = "complaint_narrative",
    columns: Mapping[str, str] | None = None,
    size: int = 300,
    overlap: int = 50,
    min_length: int = 30,
) -> int:
    """Chunk, encode and upsert documents; returns the number of chunks."""
    chunks = chunk_table(documents, text_column, columns, size, overlap, min_length)
    encoder, encoded = encoding.fit_and_encode(chunks)
    n = encoded.count()
    encoder.write().overwrite().save(model_path)
    upsert_version(encoded, base)
    return n


def ask(
    index: DataFrame,
    questions: DataFrame,
    encoder: PipelineModel,
    refusal_distance: float = retrieval.REFUSAL_DISTANCE,
    min_similarity: float = answers.MIN_SIMILARITY,
    k: int = retrieval.TOP_K,
) -> DataFrame:
    """Questions with filters chosen, evidence gathered and prompts filled; blank
    questions are refused."""
    chosen = answers.choose_filter(questions)
    texts = chosen.withColumnRenamed("question", "text")
    encoded = encoding.encode(texts, encoder).withColumnRenamed("text", "question")
    found = retrieval.retrieve(index, encoded, k, refusal_distance)
    return answers.prepare_questions(chosen, found, min_similarity=min_similarity)


def run_drift(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    output: str,
    order: Sequence[str] = (),
    required: Sequence[str] = (),
    reference_rows: int | None = None,
) -> DataFrame:
    """Reference against current rows: log columns and one event (D-9).

    The whole reference counts, or its first ``reference_rows`` by ``order`` if the
    caller asks for a window.
    """
    window = reference
    if reference_rows is not None:
        window = sampling.first_n(reference, reference_rows, required or order, order)
    columns = cut_lineage(drift.drift_by_column(window, current, numeric, categorical))
    drift.save_drift(columns, f"{output}/columns")
    summary = drift.drift_summary(columns)
    drift.drift_event(summary).write.mode("append").parquet(f"{output}/events")
    return summary
