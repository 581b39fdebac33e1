"""Table readers: delimited files, the text corpus, parquet samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.functions.text import is_nonempty
from tallyfern.sources import delimited
from tallyfern.sources.paths import path_exists, stored_bytes

# Bank-marketing columns, in order.
BANK_INTEGERS = ("age", "duration", "campaign", "previous", "pdays")
BANK_DOUBLES = ("emp_var_rate", "cons_price_idx", "cons_conf_idx", "euribor3m", "nr_employed")
BANK_CATEGORIES = (
    "job", "marital", "education", "default", "housing",
    "loan", "contact", "month", "day_of_week", "poutcome",
)
BANK_TARGET = "y"
BANK_FILES = ("bank-additional-full.csv", "bank-additional.csv", "bank-full.csv", "bank.csv")

# The raw complaint columns kept and their new names.
COMPLAINT_COLUMNS = {
    "Complaint ID": "complaint_id",
    "Product": "product",
    "Issue": "issue",
    "Company": "company",
    "Date received": "date_received",
    "Consumer complaint narrative": "complaint_narrative",
}

# Cell texts a CSV reader takes for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_EXTRA = "_extra"
#: Half of a default split.
SPREAD_BYTES = 64 << 20


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A parquet table; one of at most ``SPREAD_BYTES`` is dealt by ``spread_by``.

    A table smaller than a split is one task whatever the cluster, so dealing it lets
    CPU-heavy expressions use the cores; the bytes bound what that exchange can
    ever move.  Anything larger is read where it lies, and no result depends on it.
    """
    table = spark.read.parquet(path)
    if spread_by and stored_bytes(spark, path) <= SPREAD_BYTES:
        return table.repartition(spark.sparkContext.defaultParallelism, spread_by)
    return table


def normalise_columns(df: DataFrame) -> DataFrame:
    """Column names stripped, lower-cased, with blanks and dots as underscores."""
    names = [c.strip().lower().replace(" ", "_").replace(".", "_") for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after normalising: {clashes}")
    return df.toDF(*names)


def rename_project(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns under their new names, in mapping order."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items()])


def filter_nonempty_text(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_nonempty(F.col(column)))


def missing_tokens_to_null(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """String cells that spell a missing value become null."""
    strings = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c)
            if c in strings
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def _padded(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All-string read of one-line records where short lines are padded; one sentinel
    column after the header's catches the surplus of a long line."""
    names = delimited.header(spark, path, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _EXTRA]])
    return spark.read.csv(
        path,
        schema=schema,
        sep=sep,
        header=True,
        enforceSchema=True,
        quote='"',
        escape='"',
        mode="PERMISSIVE",
    )


def _delimited(
    spark: SparkSession,
    path: str,
    sep: str,
    multiline: bool,
    tokens: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """All-string read without the lines that are too long (:func:`rejected_lines`
    counts them).  DROPMALFORMED would decide by the columns a query selects."""
    if not multiline:
        raw = _padded(spark, path, sep)
        return missing_tokens_to_null(raw.where(F.col(_EXTRA).isNull()).drop(_EXTRA), tokens)
    limit = len(delimited.header(spark, path, sep))
    raw = delimited.read_quoted_csv(spark, path, columns, sep)
    return missing_tokens_to_null(raw.where(F.col(delimited.CELLS) <= limit).drop(delimited.CELLS), tokens)


def rejected_lines(
    spark: SparkSession, path: str, sep: str = ",", multiline: bool = True
) -> int:
    """Lines with more fields than the header, which the readers leave out."""
    if not multiline:
        return _padded(spark, path, sep).where(F.col(_EXTRA).isNotNull()).count()
    names = delimited.header(spark, path, sep)
    raw = delimited.read_quoted_csv(spark, path, names[:1], sep)
    return raw.where(F.col(delimited.CELLS) > len(names)).count()


def read_delimited_first_available(
    spark: SparkSession,
    folder: str,
    candidates: Sequence[str] = BANK_FILES,
    sep: str = ";",
    multiline: bool = False,
) -> DataFrame:
    """The first candidate file that exists, all columns as strings."""
    for name in candidates:
        path = f"{folder.rstrip('/')}/{name}"
        if path_exists(spark, path):
            return _delimited(spark, path, sep, multiline, NA_TOKENS)
    raise FileNotFoundError(f"none of {list(candidates)} exists in {folder}")


def typed_bank(df: DataFrame) -> DataFrame:
    """Bank-marketing strings in their declared types; a bad number becomes null."""
    casts = {**dict.fromkeys(BANK_INTEGERS, "int"), **dict.fromkeys(BANK_DOUBLES, "double")}
    return df.select(
        *[F.col(c).try_cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns]
    )


def read_bank_marketing(
    spark: SparkSession, folder: str, candidates: Sequence[str] = BANK_FILES
) -> DataFrame:
    return typed_bank(normalise_columns(read_delimited_first_available(spark, folder, candidates)))


def read_text_corpus(
    spark: SparkSession,
    path: str,
    mapping: Mapping[str, str] = COMPLAINT_COLUMNS,
    text_column: str = "complaint_narrative",
    sep: str = ",",
) -> DataFrame:
    """Mapped columns of a CSV with quoted multi-line text; blank texts drop.

    Files are read in parallel ranges and only the mapped columns are taken out of
    their records.
    """
    raw = _delimited(spark, path, sep, True, NA_TOKENS, list(mapping))
    return filter_nonempty_text(rename_project(raw, mapping), text_column)


def read_sample(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet sample written earlier; an error when it is absent."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)
