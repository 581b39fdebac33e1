"""Approximate nearest chunks by product-quantised codes.

A unit vector is cut into parts and each part is replaced by the number of its nearest
centre in that part's codebook: a vector of 384 floats becomes a few bytes.  A search
reads codes only: for each question a table holds the dot product of its parts with all
centres, so a row's cosine is a sum of looked-up numbers.  The best rows by this sum are
then ranked by their exact distances.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tallyfern.functions.text import is_nonempty
from tallyfern.functions.vectors import DISTANCE_DECIMALS, cosine_distance
from tallyfern.operators.retrieval import (
    BLOCK_BYTES,
    PAIRS_PER_STEP,
    TOP_K,
    _matrix,
    _ranked,
    _unit,
)
from tallyfern.sources.session import shared_folder
from tallyfern.sources.tables import cut_lineage

PARTS, CODES = 16, 256
#: Rows that the codebooks are fitted on, and Lloyd's rounds.
SAMPLE_ROWS, ROUNDS = 20_000, 15
#: Candidates that are ranked exactly, for each result wanted.
RERANK = 20
QUESTIONS_TOGETHER = 32
CODE = "codes"


@dataclass(frozen=True)
class Codebooks:
    """Centres by part and code; all parts have one width, the last padded with zeros."""

    centers: np.ndarray
    dimensions: int

    def parted(self, units: np.ndarray) -> np.ndarray:
        """Rows cut into parts: rows x parts x width."""
        if units.shape[1] != self.dimensions:
            raise ValueError(f"vectors have {units.shape[1]} dimensions, the codebooks {self.dimensions}")
        return _parted(units, len(self.centers))

    def encode(self, units: np.ndarray) -> np.ndarray:
        """Code of each part: rows x parts bytes."""
        own = self.parted(units)
        return np.stack([_nearest(own[:, p], c) for p, c in enumerate(self.centers)], 1).astype(np.uint8)

    def tables(self, units: np.ndarray) -> np.ndarray:
        """Dot products of each question's parts with all centres: questions x parts x codes."""
        return np.einsum("qpw,pcw->qpc", self.parted(units), self.centers)


def _parted(units: np.ndarray, parts: int) -> np.ndarray:
    width = math.ceil(units.shape[1] / parts)
    padded = np.zeros((len(units), parts * width))
    padded[:, : units.shape[1]] = units
    return padded.reshape(len(units), parts, width)


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(1)[None, :] - 2 * points @ centers.T).argmin(1)


def _centers(points: np.ndarray, codes: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from distinct points; a centre without points moves to the worst fitted."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= codes:
        return np.concatenate([distinct, np.repeat(distinct[:1], codes - len(distinct), 0)])
    centers = distinct[rng.choice(len(distinct), codes, replace=False)]
    for _ in range(rounds):
        near = _nearest(points, centers)
        counts = np.bincount(near, minlength=codes)
        sums = np.stack([np.bincount(near, points[:, d], codes) for d in range(points.shape[1])], 1)
        moved = sums / np.maximum(counts, 1)[:, None]
        empty = np.nonzero(counts == 0)[0]
        if len(empty):
            error = ((points - centers[near]) ** 2).sum(1)
            moved[empty] = points[np.argsort(-error)[: len(empty)]]
        centers = moved
    return centers


def fit_codebooks(
    vectors: DataFrame,
    vector: str = "embedding",
    parts: int = PARTS,
    codes: int = CODES,
    sample_rows: int = SAMPLE_ROWS,
    rounds: int = ROUNDS,
    seed: int = 42,
) -> Codebooks:
    """Codebooks of a bounded sample: the ``sample_rows`` rows of the lowest hashes of their
    vectors, so the sample depends on the rows and not on their order."""
    if not 1 <= codes <= 256:
        raise ValueError("a code is one byte")
    chosen = (
        vectors.where(F.col(vector).isNotNull())
        .select(vector, F.xxhash64(vector, F.lit(seed)).alias("_order"))
        .orderBy("_order")
        .limit(sample_rows)
        .select(vector)
        .toArrow()
    )
    if not chosen.num_rows:
        raise ValueError("there is no vector to fit codebooks on")
    units = _unit(_matrix(chosen.column(0)))
    own, rng = _parted(units, parts), np.random.default_rng(seed)
    centers = np.stack([_centers(own[:, p], codes, rounds, rng) for p in range(parts)])
    return Codebooks(centers, units.shape[1])


def encode_vectors(
    vectors: DataFrame, books: Codebooks, vector: str = "embedding", output: str = CODE
) -> DataFrame:
    """Rows with their codes, one byte for each part, in place of the vector.

    Rows without a vector have none.  Store the result by itself: a search reads it
    whole, and the vectors only for the candidates.
    """
    rest = [c for c in vectors.columns if c != vector]
    schema = T.StructType([*[vectors.schema[c] for c in rest], T.StructField(output, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = books.encode(_unit(_matrix(batch.column(len(rest))))) if batch.num_rows else []
            made = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=schema.names)

    return vectors.where(F.col(vector).isNotNull()).select(*rest, vector).mapInArrow(run, schema)


class _Candidates:
    """The best rows of a task for each question of a block."""

    def __init__(self, books: Codebooks, units: np.ndarray, size: int):
        self.books, self.units, self.size = books, units, size
        self.score = np.full((len(units), 0), -np.inf)
        self.key = np.empty((len(units), 0), object)

    def add(self, keys: np.ndarray, codes: np.ndarray) -> None:
        parts = len(self.books.centers)
        width = min(self.size, self.score.shape[1] + len(keys))
        score, key = np.empty((len(self.units), width)), np.empty((len(self.units), width), object)
        for at in range(0, len(self.units), QUESTIONS_TOGETHER):
            group = slice(at, at + QUESTIONS_TOGETHER)
            tables = self.books.tables(self.units[group])
            found = np.zeros((len(tables), len(keys)))
            for p in range(parts):
                found += tables[:, p, :][:, codes[:, p]]
            every = np.concatenate([self.score[group], found], 1)
            names = np.concatenate([self.key[group], np.broadcast_to(keys, found.shape)], 1)
            if every.shape[1] > width:
                best = np.argpartition(-every, width - 1, axis=1)[:, :width]
                every, names = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)
            score[group], key[group] = every, names
        self.score, self.key = score, key


def _search(
    coded: DataFrame, books: Codebooks, ids: list, units: np.ndarray, field: T.StructField, key: str, size: int, code: str
) -> DataFrame:
    """Each task's best ``size`` rows for every question of a block, by their codes."""
    schema = T.StructType(
        [
            field,
            coded.schema[key],
            T.StructField("distance", T.DoubleType()),
            T.StructField("_k", T.IntegerType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    shipped = coded.sparkSession.sparkContext.broadcast((books, ids, units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, ids, units = shipped.value
        best = _Candidates(books, units, size)
        parts = len(books.centers)
        step = max(1, PAIRS_PER_STEP // QUESTIONS_TOGETHER)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                own = batch.slice(start, step)
                keys = np.empty(own.num_rows, object)
                keys[:] = own.column(0).to_pylist()
                codes = np.frombuffer(b"".join(own.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                best.add(keys, codes)
        width = best.score.shape[1]
        if width:
            each = max(1, 100_000 // width)
            for at in range(0, len(ids), each):
                some = best.score[at : at + each]
                columns = [
                    [i for i in ids[at : at + each] for _ in range(width)],
                    best.key[at : at + each].ravel().tolist(),
                    (1.0 - some).ravel(),
                    np.full(some.size, size, np.int32),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
                )

    return coded.select(key, code).mapInArrow(run, schema)


def quantised_top_k(
    coded: DataFrame,
    vectors: DataFrame,
    questions: DataFrame,
    books: Codebooks,
    k: int = TOP_K,
    rerank: int = RERANK,
    chunk_key: str = "chunk_id",
    query_key: str = "query_id",
    vector: str = "embedding",
    code: str = CODE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` among the ``k * rerank`` best by their codes:
    ``query_key``, the other columns of ``vectors``, ``distance`` and ``rank``.

    ``coded`` has the codes of all rows of ``vectors`` by ``chunk_key``.  Exact when
    ``k * rerank`` is the number of rows.  Blank questions and those without a vector find
    nothing.  Questions are shipped in blocks of about ``block_bytes``; distances are
    compared at nine decimals and equal ones rank by key.
    """
    asked = questions.where(F.col(vector).isNotNull())
    if "question" in questions.columns:
        asked = asked.where(is_nonempty(F.col("question")))
    asked = cut_lineage(asked.select(F.col(query_key), F.col(vector).alias("_asked")))
    field = T.StructField(query_key, questions.schema[query_key].dataType)
    per_block = max(1, block_bytes // (8 * books.dimensions))
    n_blocks = max(1, math.ceil(asked.count() / per_block))
    numbered = asked.withColumn("_block", F.pmod(F.xxhash64(query_key), F.lit(n_blocks)))
    size = k * rerank
    folder = f"{shared_folder(coded.sparkSession)}/candidates-{uuid.uuid4().hex}"
    for number in range(n_blocks):
        rows = numbered.where(F.col("_block") == number).collect()
        ids = [r[query_key] for r in rows]
        units = np.array([r["_asked"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
        units = _unit(units) if len(rows) else np.zeros((0, books.dimensions))
        found = _search(coded, books, ids, units, field, chunk_key, size, code)
        best = _ranked(found, query_key, chunk_key, size)
        best.select(query_key, chunk_key).write.mode("append").parquet(folder)
    candidates = coded.sparkSession.read.schema(T.StructType([field, coded.schema[chunk_key]])).parquet(folder)
    exact = F.round(cosine_distance(F.col("_asked"), F.col(vector)), DISTANCE_DECIMALS)
    order = Window.partitionBy(query_key).orderBy("distance", chunk_key)
    rest = [c for c in vectors.columns if c != vector]
    return (
        candidates.join(vectors, chunk_key)
        .join(asked, query_key)
        .select(query_key, *rest, exact.alias("distance"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def recall(found: DataFrame, exact: DataFrame, chunk_key: str = "chunk_id", query_key: str = "query_id") -> DataFrame:
    """Share of each question's exact results that a search found."""
    hits = found.select(query_key, chunk_key, F.lit(1).alias("hit"))
    return (
        exact.select(query_key, chunk_key)
        .join(hits, [query_key, chunk_key], "left")
        .groupBy(query_key)
        .agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    )
