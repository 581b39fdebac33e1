"""Registered queries over documents: cleaning, chunking, indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators import chunking
from tallyfern.sources.readers import read_table
from tallyfern.sources.tables import cut_lineage

# documents stands in for the complaint table.
DOCUMENT_COLUMNS = {"complaint_id": "doc_id", "product": "lang", "company": "source"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", "doc_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_table(documents(spark, sf_dir), "text", DOCUMENT_COLUMNS)


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).drop("issue", "date")


def clean_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.clean_text_report(documents(spark, sf_dir), "text", "doc_id")


def chunks_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks_per_group(chunks(spark, sf_dir), "product")


def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.index_summary(documents(spark, sf_dir), "text", "doc_id")


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index with every text not in English arriving again under a new
    company name."""
    docs = documents(spark, sf_dir)
    existing = chunking.chunk_table(docs, "text", DOCUMENT_COLUMNS)
    edited = docs.where("lang <> 'en'").withColumn("source", F.concat("source", F.lit("-new")))
    new = cut_lineage(chunking.chunk_table(edited, "text", DOCUMENT_COLUMNS))
    return chunking.upsert_chunks(existing, new).select(
        "chunk_id", "complaint_id", "company", "chunk_index"
    )


_BLANK = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Cleaned documents and their chunks, restated for the oracle.
CLEANED_SQL = rf"""
stripped AS (
  SELECT doc_id, lang, source, n_chars,
         regexp_replace(text, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS s
  FROM documents
), cleaned AS (
  SELECT doc_id, lang, source, n_chars,
         trim(regexp_replace(
           regexp_replace(replace(replace(s, chr(8211), '-'), chr(8212), '-'),
                          '(?i)\bXX+\b', '', 'g'),
           '[{_BLANK}]+', ' ', 'g')) AS c
  FROM stripped
)"""
CHUNKS_SQL = (
    CLEANED_SQL
    + """, pieces AS (
  SELECT doc_id, lang, source, n_chars,
         list_filter(
           CASE WHEN length(c) <= 300 THEN [c]
                ELSE list_transform(range(0, length(c), 250),
                                    lambda s: trim(substring(c, s + 1, 300))) END,
           lambda k: length(k) >= 30) AS ks
  FROM cleaned WHERE length(c) >= 30
), chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS complaint_id, lang AS product, source AS company, n_chars,
         CAST(u.i - 1 AS INTEGER) AS chunk_index, ks[u.i] AS text,
         substring(sha256(doc_id || ':' || (u.i - 1) || ':' || ks[u.i]), 1, 16) AS chunk_id
  FROM pieces, unnest(range(1, len(ks) + 1)) AS u(i)
)"""
)

QUERIES = {
    "chunk_index": chunk_index,
    "clean_text_report": clean_text_report,
    "chunks_per_lang": chunks_per_lang,
    "index_counts": index_counts,
    "upsert_chunks": upsert_chunks,
}

ORACLES = {
    "chunk_index": f"""WITH {CHUNKS_SQL}
SELECT chunk_id, text, complaint_id, product, company, chunk_index FROM chunks""",
    "clean_text_report": f"""WITH {CLEANED_SQL}
SELECT doc_id, c AS clean_text, CAST(length(c) AS INTEGER) AS clean_length,
       length(c) >= 30 AS usable FROM cleaned""",
    "chunks_per_lang": f"""WITH {CHUNKS_SQL}
SELECT product, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM chunks GROUP BY product""",
    "index_counts": f"""WITH {CHUNKS_SQL}
SELECT (SELECT count(*) FROM chunks) AS n_chunks,
       count(*) FILTER (WHERE length(c) >= 30) AS documents_used,
       count(*) FILTER (WHERE length(c) < 30) AS documents_skipped FROM cleaned""",
    "upsert_chunks": f"""WITH {CHUNKS_SQL}
SELECT chunk_id, complaint_id,
       CASE WHEN product <> 'en' THEN company || '-new' ELSE company END AS company, chunk_index
FROM chunks""",
}
