"""Registered queries that write files and read them back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators import sampling
from tallyfern.plans.table_queries import SEED, table
from tallyfern.sources import delimited, readers
from tallyfern.sources.session import shared_folder
from tallyfern.sources.tables import write_table

_CSV_COLUMNS = (
    "Date received", "Product", "Issue", "Company", "Complaint ID", "Consumer complaint narrative", "Tags",
)
#: Documents that get a surplus cell, and those whose last cell is left out.
_LONG, _SHORT = 7, 9


def _quoted(column: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(column, F.lit('"'), F.lit('""')), F.lit('"'))


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _raw_complaints(spark: SparkSession, sf_dir: str) -> str:
    """All documents as CSV files: quoted texts with their line breaks, a header in each
    file, some lines with a cell too many and some with one too few."""
    docs = table(spark, sf_dir, "documents")
    cells = [
        F.lit("2024-01-02"),
        F.coalesce("lang", F.lit("")),
        F.coalesce(F.col("n_chars").cast("string"), F.lit("NA")),
        _quoted(F.coalesce("source", F.lit(""))),
        F.col("doc_id").cast("string"),
        F.coalesce(_quoted(F.col("text")), F.lit("")),
    ]
    kind = F.col("doc_id") % 50
    tags = F.when(kind == _LONG, F.lit(",x,surplus")).when(kind == _SHORT, F.lit("")).otherwise(F.lit(",x"))
    lines = docs.select(F.concat(F.concat_ws(",", *cells), tags).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([",".join(_CSV_COLUMNS)])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names=["value"])

    path = _new_folder(spark, "complaints-csv")
    lines.mapInArrow(headed, "value string").write.text(path)
    return path


def corpus_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text corpus read in ranges from CSV files with multi-line cells (S3)."""
    corpus = readers.read_text_corpus(spark, _raw_complaints(spark, sf_dir))
    return corpus.select(
        "complaint_id",
        "product",
        "issue",
        "company",
        "date_received",
        F.md5("complaint_narrative").alias("narrative_md5"),
    )


def corpus_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the raw files by their number of cells: short, whole, rejected ones."""
    raw = delimited.read_quoted_csv(spark, _raw_complaints(spark, sf_dir), ["Complaint ID"])
    return raw.groupBy(F.col(delimited.CELLS).alias("n_cells")).agg(
        F.count("*").alias("n_records"), F.sum(F.col("Complaint ID").cast("long")).alias("sum_of_ids")
    )


def sample_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ``;`` file, read by the first name that exists, sampled, written, read."""
    folder = _new_folder(spark, "orders-csv")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("Order Key"), "o_orderstatus", "o_orderpriority"
    )
    write = orders.write.option("header", True).option("sep", ";")
    write.csv(f"{folder}/second.csv")
    raw = readers.normalise_columns(
        readers.read_delimited_first_available(spark, folder, ["first.csv", "second.csv"])
    )
    size = raw.count() // 3
    write_table(sampling.sample_n(raw, size, SEED, ["order_key"]), f"{folder}/sample")
    return readers.read_sample(spark, f"{folder}/sample")


QUERIES = {
    "corpus_read_back": corpus_read_back,
    "corpus_cells": corpus_cells,
    "sample_read_back": sample_read_back,
}

ORACLES = {
    "corpus_read_back": f"""
SELECT CAST(doc_id AS VARCHAR) AS complaint_id, lang AS product, CAST(n_chars AS VARCHAR) AS issue,
       source AS company, '2024-01-02' AS date_received, md5(text) AS narrative_md5
FROM documents WHERE doc_id % 50 <> {_LONG} AND trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''""",
    "corpus_cells": f"""
SELECT CAST(CASE doc_id % 50 WHEN {_LONG} THEN 8 WHEN {_SHORT} THEN 6 ELSE 7 END AS INTEGER) AS n_cells,
       count(*) AS n_records, CAST(sum(doc_id) AS BIGINT) AS sum_of_ids FROM documents GROUP BY 1""",
    "sample_read_back": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderstatus, o_orderpriority FROM orders
ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey LIMIT (SELECT count(*) // 3 FROM orders)""",
}
