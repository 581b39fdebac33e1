"""Document cleaning, chunking and the content-addressed chunk table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfern.functions import text as tx

# The metadata every chunk carries.
METADATA = ("complaint_id", "product", "issue", "company", "date")
CHUNK_COLUMNS = ("chunk_id", "text", *METADATA, "chunk_index")


def _cleaned(documents: DataFrame, text_column: str, id_column: str, min_length: int) -> DataFrame:
    body = F.col("_clean")
    return documents.withColumn("_clean", tx.clean_text(F.col(text_column))).withColumn(
        "_usable", tx.is_valid_text(body, min_length) & F.col(id_column).isNotNull()
    )


def clean_text_report(
    documents: DataFrame,
    text_column: str,
    id_column: str,
    min_length: int = tx.MIN_CHUNK_LENGTH,
) -> DataFrame:
    """Per document: cleaned text, its length and whether it can be chunked."""
    kept = _cleaned(documents, text_column, id_column, min_length)
    return kept.select(
        F.col(id_column),
        F.col("_clean").alias("clean_text"),
        F.length("_clean").alias("clean_length"),
        F.col("_usable").alias("usable"),
    )


def chunk_table(
    documents: DataFrame,
    text_column: str = "complaint_narrative",
    columns: Mapping[str, str] | None = None,
    size: int = tx.CHUNK_SIZE,
    overlap: int = tx.CHUNK_OVERLAP,
    min_length: int = tx.MIN_CHUNK_LENGTH,
) -> DataFrame:
    """One row per chunk with its content id and metadata.

    ``columns`` maps metadata names to columns of ``documents``; a name without
    a column is a null string.  Texts too short to use and rows without a
    document id give no chunk (:func:`index_summary` counts them).  The index counts
    the kept chunks of a document from 0.
    """
    columns = dict(
        columns
        or {
            "complaint_id": "complaint_id",
            "product": "product",
            "issue": "issue",
            "company": "company",
            "date": "date_received",
        }
    )
    # No length test here: a text too short to use has no window to explode, and
    # a filter on the cleaned text would clean every text twice.
    identified = documents.where(F.col(columns["complaint_id"]).isNotNull())
    cleaned = identified.withColumn("_clean", tx.clean_text(F.col(text_column)))
    metadata = [
        F.col(columns[name]).cast("string").alias(name)
        if name in columns
        else F.lit(None).cast("string").alias(name)
        for name in METADATA
    ]
    pieces = cleaned.select(
        *metadata,
        F.posexplode(tx.chunk_text(F.col("_clean"), size, overlap, min_length)).alias(
            "chunk_index", "text"
        ),
    )
    return pieces.withColumn(
        "chunk_id", tx.chunk_id(F.col("complaint_id"), F.col("chunk_index"), F.col("text"))
    ).select(*CHUNK_COLUMNS)


def index_summary(
    documents: DataFrame,
    text_column: str = "complaint_narrative",
    id_column: str = "complaint_id",
    size: int = tx.CHUNK_SIZE,
    overlap: int = tx.CHUNK_OVERLAP,
    min_length: int = tx.MIN_CHUNK_LENGTH,
) -> DataFrame:
    """One row: chunks the documents give, documents used, documents skipped."""
    pieces = F.size(tx.chunk_text(F.col("_clean"), size, overlap, min_length))
    return _cleaned(documents, text_column, id_column, min_length).agg(
        F.sum(F.when(F.col("_usable"), pieces).otherwise(0)).alias("n_chunks"),
        F.count_if("_usable").alias("documents_used"),
        F.count_if(~F.col("_usable")).alias("documents_skipped"),
    )


def chunks_per_group(chunks: DataFrame, group: str) -> DataFrame:
    """Chunks and characters of an index per metadata value."""
    return chunks.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.length("text")).alias("n_chars"),
    )


def index_count(chunks: DataFrame) -> DataFrame:
    """One row with the number of chunks in the index."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"))


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row per key.  Rows sharing a key are compared as a whole and the
    greatest wins, so retries agree; copies collapse before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(F.max(F.struct(*rest)).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*rows.columns)
    )


def upsert_chunks(
    existing: DataFrame,
    new: DataFrame,
    key: str = "chunk_id",
    replace_documents: bool = False,
    document_column: str = "complaint_id",
) -> DataFrame:
    """The index after inserting or replacing ``new`` by chunk id.

    With ``replace_documents`` the earlier chunks of every document in ``new``
    go first, so an edited document leaves no stale chunk behind.
    """
    fresh = one_per_key(new, key)
    kept = existing
    if replace_documents:
        touched = new.select(document_column).where(F.col(document_column).isNotNull()).distinct()
        kept = kept.join(touched, document_column, "left_anti")
    kept = kept.join(fresh.select(key), key, "left_anti")
    return kept.select(*existing.columns).unionByName(fresh)
