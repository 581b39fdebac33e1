"""From raw documents to token ids: five stages, each over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as
Parquet and hands the table read back to the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.llm import bpe, decontamination, line_quality, pii, simhash
from tallyfern.sources.tables import cut_result, drop_cut

RANKS = "byte_bpe_multi_50k.tiktoken"

#: No SQL can express the span classifier or the merges; tests compare with brute force.
ORACLE_SQL = None


def _identity(*also: str) -> list[Column]:
    """A row's identity without nulls: its id, whether that is null, a hash of the rest."""
    return [
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"),
        F.col("doc_id").isNull().alias("__no_id"),
        F.xxhash64("text", *also).alias("__mark"),
    ]


KEY = ["__id", "__no_id", "__mark"]


def _with_length(docs: DataFrame, made: DataFrame) -> DataFrame:
    """``made`` with the columns of ``docs``, ``n_chars`` by its own text."""
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        made = made.withColumn("n_chars", length)
    return made.select(*[f"`{c}`" for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their host's lines above the limits;
    lengths follow the text.  Rows equal in id, text and source share their verdict;
    null and empty texts go."""
    kept = line_quality.remove_lines(docs, keep=docs.columns)
    return _with_length(docs, kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id
    (a null id is the largest; of equal ids the text with the smallest hash)."""
    marked = docs.select("doc_id", "text", *_identity())
    groups = simhash.near_duplicates(marked, keep=KEY)
    rank = F.struct("__no_id", "doc_id", "__mark", "__id")
    chosen = (
        groups.groupBy("component_fingerprint")
        .agg(F.min(rank).alias("best"))
        .select("best.__id", "best.__no_id", "best.__mark")
    )
    return (
        docs.select("*", *_identity())
        .join(chosen, KEY, "left_semi")
        .dropDuplicates(KEY)
        .select(*[f"`{c}`" for c in docs.columns])
    )


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = docs.select(F.struct("*").alias("__document"), F.col("text").alias("__text"))
    found = decontamination.contamination(whole, benchmark, "__text", keep=["__document"])
    return found.where(~F.col("contaminated")).select("__document.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; lengths follow the text."""
    masked = pii.mask(docs, pii.fit(docs), keep=docs.columns)
    return _with_length(docs, masked)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, four bytes each) of each document, and digests of a round trip."""
    coded = bpe.encode(
        docs, public_tokenizers.path(RANKS), keep=["doc_id", "lang", "source"], offsets=False, decoded=True
    )
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("tokens", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is cut into the shared folder.

    What a stage cut on its way, and the result before it, are deleted once its own
    result is written; the last stage's input stays, as the returned rows read it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for i, (_, stage) in enumerate(before):
        given = docs
        docs = cut_result(spark, lambda: stage(spark, given, sf_dir))
        if i:
            drop_cut(given)
    return last(spark, docs, sf_dir)
