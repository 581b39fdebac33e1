"""Nearest chunks of questions, exact and by cells."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tallyfern.functions.text import is_nonempty
from tallyfern.functions.vectors import DISTANCE_DECIMALS, similarity
from tallyfern.sources.session import shared_folder, small_side
from tallyfern.sources.tables import cut_lineage

# Results per question and the refusal distance.
TOP_K = 5
REFUSAL_DISTANCE = 0.75
DOCUMENT_TOP_K = 10

# Questions travel to the tasks in blocks of at most this many bytes.
BLOCK_BYTES = 32 << 20
PAIRS_PER_STEP = 4_000_000
SLACK = 1e-8
RANK_SALTS = 16


@dataclass
class _Block:
    """Question vectors on their way to the tasks, and what each may match."""

    ids: list
    vectors: np.ndarray
    k: int
    own_k: list
    filter_keys: list
    filter_values: list
    cells: list | None


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    lengths[lengths == 0] = 1.0
    return matrix / lengths[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(1, len(column))
    if width * len(column) != len(flat):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), width)


def _allowed(batch: pa.RecordBatch, block: _Block, cell: str | None) -> np.ndarray | None:
    """Which (row, question) pairs the filters admit; None when all."""
    groups: dict = {}
    for i, (key, value) in enumerate(zip(block.filter_keys, block.filter_values)):
        if key is not None:
            groups.setdefault((key, value), []).append(i)
    if not groups and cell is None:
        return None
    admitted = np.ones((batch.num_rows, len(block.ids)), dtype=bool)
    for (key, value), members in groups.items():
        same = pc.equal(pc.cast(batch.column(key), pa.string()), value)
        admitted[:, members] = same.fill_null(False).to_numpy(zero_copy_only=False)[:, None]
    if cell is not None:
        cells = batch.column(cell).to_numpy(zero_copy_only=False)
        for i, probed in enumerate(block.cells):
            admitted[:, i] &= np.isin(cells, probed)
    return admitted


class _Best:
    """The k nearest rows seen so far for every question of a block."""

    def __init__(self, block: _Block, key: str):
        self.k, self.key = block.k, key
        self.vectors = block.vectors
        self.limit = np.full(len(block.ids), np.inf)
        self.pairs = pd.DataFrame({"q": [], "d": [], "id": []})
        self.rows: pa.Table | None = None

    def add(self, batch: pa.RecordBatch, units: np.ndarray, admitted: np.ndarray | None) -> None:
        distances = 1.0 - self.vectors @ units.T
        if admitted is not None:
            distances[~admitted.T] = np.inf
        limit = self.limit.copy()
        fresh = np.isinf(limit)
        if fresh.any() and distances.shape[1] > self.k:
            kth = np.partition(distances[fresh], self.k - 1, axis=1)[:, self.k - 1]
            limit[fresh] = kth
        question, near = np.nonzero((distances <= limit[:, None] + SLACK) & np.isfinite(distances))
        if not len(near):
            return
        # Summed per pair in one fixed order, so equal vectors score equally
        # whatever batch they arrive in.
        exact = 1.0 - (units[near] * self.vectors[question]).sum(axis=1)
        found = pd.DataFrame(
            {
                "q": question,
                "d": np.round(exact, DISTANCE_DECIMALS),
                "id": batch.column(self.key).take(pa.array(near)).to_pandas(),
            }
        )
        rows = pa.Table.from_batches([batch]).take(pa.array(near))
        if self.rows is not None:
            found = pd.concat([self.pairs, found], ignore_index=True)
            rows = pa.concat_tables([self.rows, rows])
        kept = found.sort_values(["q", "d", "id"]).groupby("q", sort=False).head(self.k)
        self.rows = rows.take(pa.array(kept.index.to_numpy()))
        self.pairs = kept.reset_index(drop=True)
        full = self.pairs.groupby("q")["d"].agg(["size", "max"])
        full = full[full["size"] >= self.k]
        self.limit[full.index.to_numpy(dtype=int)] = full["max"].to_numpy()


def _search_block(
    chunks: DataFrame,
    block: _Block,
    query_field: T.StructField,
    key: str,
    vector: str,
    cell: str | None,
    matrix: Callable[[pa.Array], np.ndarray],
) -> DataFrame:
    """Keys and distances of the k nearest rows per question and task."""
    carried = [chunks.schema[key]]
    extra = [T.StructField("distance", T.DoubleType()), T.StructField("_k", T.IntegerType())]
    schema = T.StructType([query_field, *carried, *extra])
    arrow_schema = to_arrow_schema(schema)
    used = {*block.filter_keys, key, vector, *([cell] if cell else [])} - {None}
    names = [c for c in chunks.columns if c in used and c != vector]
    chunks = _matching(chunks.select(*[c for c in chunks.columns if c in used]), block)
    shipped = chunks.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shipped.value
        best = _Best(block, key)
        step = max(1, PAIRS_PER_STEP // max(1, len(block.ids)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                units = _unit(matrix(batch.column(vector)).astype(np.float64, copy=False))
                best.add(batch.select(names), units, _allowed(batch, block, cell))
        if best.rows is not None:
            asked = best.pairs["q"].astype(int)
            table = best.rows.select([key])
            table = table.add_column(0, query_field.name, pa.array([block.ids[q] for q in asked]))
            table = table.append_column("distance", pa.array(best.pairs["d"].to_numpy()))
            table = table.append_column("_k", pa.array([block.own_k[q] for q in asked], pa.int32()))
            yield from table.cast(arrow_schema).combine_chunks().to_batches()

    return chunks.where(F.col(vector).isNotNull()).mapInArrow(run, schema)


def _matching(chunks: DataFrame, block: _Block) -> DataFrame:
    """Only rows that some question's filter admits, where every question has one:
    a condition that reaches the scan."""
    if any(k is None for k in block.filter_keys):
        return chunks
    admitted: dict[str, set[str]] = {}
    for name, value in zip(block.filter_keys, block.filter_values):
        admitted.setdefault(name, set()).add(value)
    condition = F.lit(False)
    for name, values in sorted(admitted.items()):
        if isinstance(chunks.schema[name].dataType, T.IntegralType):
            numbers = sorted(int(v) for v in values if v is not None and re.fullmatch(r"-?[0-9]{1,18}", v))
            condition = condition | F.col(name).isin(numbers)
        else:
            texts = sorted(v for v in values if v is not None)
            condition = condition | F.col(name).cast("string").isin(texts)
    return chunks.where(condition)


def _block_of(rows: list, vector: str, cell: str | None) -> _Block:
    own_k = [int(r["_k"]) for r in rows]
    return _Block(
        ids=[r["_id"] for r in rows],
        vectors=_unit(np.array([r[vector] for r in rows], dtype=np.float64)),
        k=max(own_k),
        own_k=own_k,
        filter_keys=[r["_filter_key"] for r in rows],
        filter_values=[r["_filter_value"] for r in rows],
        cells=[list(r["_cells"]) for r in rows] if cell else None,
    )


def _ranked(found: DataFrame, query_key: str, chunk_key: str, k: int) -> DataFrame:
    """The best of all tasks' candidates.  Each question's candidates are thinned by
    salt first; both limits are literals, which Spark applies before it sorts."""
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(chunk_key), F.lit(RANK_SALTS)))
    part = Window.partitionBy(query_key, "_salt").orderBy("distance", chunk_key)
    thinned = salted.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= k)
    order = Window.partitionBy(query_key).orderBy("distance", chunk_key)
    ranked = thinned.drop("_salt", "_place").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).where(F.col("rank") <= F.col("_k")).drop("_k")


def top_k(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = TOP_K,
    chunk_key: str = "chunk_id",
    query_key: str = "query_id",
    vector: str = "embedding",
    cell: str | None = None,
    block_bytes: int = BLOCK_BYTES,
    stored: str | None = None,
    matrix: Callable[[pa.Array], np.ndarray] = _matrix,
) -> DataFrame:
    """The ``k`` nearest chunks of every question, nearest first, exact.

    ``questions`` has a unique ``query_key`` and a ``vector``.  Optional columns:
    ``question`` (blank ones find nothing), ``top_k`` (its own number of
    results), ``filter_key`` and ``filter_value`` (only chunks whose column of
    that name has that value are searched).

    The questions are counted first.  A block of about ``block_bytes`` is sent to
    all tasks, each task multiplies its chunks with it and emits only
    its best ``k`` per question, and a window picks among those.  More questions
    than one block are searched block after block, each result landing in the
    shared folder, so no size of either side has to fit a machine.

    Chunks that have their vectors in another form name its column as ``stored`` and
    give the function that makes a ``matrix`` of a batch of it; it is not returned.

    Distances are compared at nine decimals; equal ones rank by chunk key.
    """
    stored = stored or vector
    columns = set(questions.columns)
    asked = questions.where(F.col(vector).isNotNull())
    if "question" in columns:
        asked = asked.where(is_nonempty(F.col("question")))
    wanted = F.coalesce(F.col("top_k"), F.lit(k)) if "top_k" in columns else F.lit(k)
    filtered = "filter_key" in columns
    asked = asked.select(
        F.col(query_key).alias("_id"),
        vector,
        wanted.cast("int").alias("_k"),
        (F.col("filter_key") if filtered else F.lit(None).cast("string")).alias("_filter_key"),
        (F.col("filter_value") if filtered else F.lit(None).cast("string")).alias("_filter_value"),
        (F.col("_cells") if cell else F.lit(None).cast("array<int>")).alias("_cells"),
    )
    query_field = T.StructField(query_key, questions.schema[query_key].dataType)

    def search(rows: list) -> DataFrame:
        block = _block_of(rows, vector, cell)
        found = _search_block(chunks, block, query_field, chunk_key, stored, cell, matrix)
        best = _ranked(found, query_key, chunk_key, block.k)
        # Few winners are sent to the chunks; many meet them in a shuffle.
        rest = [c for c in chunks.columns if c != stored]
        return chunks.select(*rest).join(small_side(best), chunk_key).select(
            query_key, *rest, "distance", "rank"
        )

    asked = cut_lineage(asked)
    first = asked.select(F.size(vector)).first()
    per_block = max(1, block_bytes // (8 * max(1, first[0] if first else 1)))
    few = asked.limit(per_block + 1).collect()
    if not few:
        rest = [F.col(c) for c in chunks.columns if c != stored]
        return chunks.where(F.lit(False)).select(
            F.lit(None).cast(query_field.dataType).alias(query_key),
            *rest,
            F.lit(None).cast("double").alias("distance"),
            F.lit(None).cast("int").alias("rank"),
        )
    if len(few) <= per_block:
        return search(few)

    spark = chunks.sparkSession
    folder = f"{shared_folder(spark)}/top-k-{uuid.uuid4().hex}"
    n_blocks = math.ceil(asked.count() / per_block)
    numbered = asked.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(n_blocks)))
    for number in range(n_blocks):
        rows = numbered.where(F.col("_block") == number).collect()
        if rows:
            search(rows).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def refuse_far(ranked: DataFrame, refusal_distance: float = REFUSAL_DISTANCE) -> DataFrame:
    """Drop results at or beyond the refusal distance, after the top k."""
    return ranked.where(F.col("distance") < refusal_distance)


def retrieve(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = TOP_K,
    refusal_distance: float = REFUSAL_DISTANCE,
    **options,
) -> DataFrame:
    """Top k, then refusal, then similarity: one row per question and rank."""
    near = refuse_far(top_k(chunks, questions, k, **options), refusal_distance)
    return near.withColumn("similarity", similarity(F.col("distance")))


def chunks_of_document(
    chunks: DataFrame, document: str, k: int = DOCUMENT_TOP_K, document_column: str = "complaint_id"
) -> DataFrame:
    """The first ``k`` chunks of one document in text order."""
    own = chunks.where(F.col(document_column) == document)
    return own.orderBy("chunk_index", "chunk_id").limit(k)


def chunks_by_document(
    chunks: DataFrame, k: int = DOCUMENT_TOP_K, document_column: str = "complaint_id"
) -> DataFrame:
    """The first ``k`` chunks of every document, with their place from 1 as ``place``."""
    order = Window.partitionBy(document_column).orderBy("chunk_index", "chunk_id")
    return chunks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def fit_cells(
    chunks: DataFrame, n_cells: int, vector: str = "embedding", seed: int = 42
) -> KMeansModel:
    """Cells of the vector space for :func:`approx_top_k`."""
    points = chunks.where(F.col(vector).isNotNull()).select(array_to_vector(vector).alias("_point"))
    return KMeans(k=n_cells, seed=seed, featuresCol="_point", predictionCol="cell").fit(points)


def assign_cells(chunks: DataFrame, cells: KMeansModel, vector: str = "embedding") -> DataFrame:
    """Chunks with their cell; store them ``partitionBy("cell")`` so that a
    search reads only the probed cells."""
    return cells.transform(chunks.withColumn("_point", array_to_vector(vector))).drop("_point")


def approx_top_k(
    celled: DataFrame,
    questions: DataFrame,
    cells: KMeansModel,
    probes: int,
    vector: str = "embedding",
    **options,
) -> DataFrame:
    """Top k among the chunks of the ``probes`` cells nearest to each question.

    Exact when ``probes`` is the number of cells.
    """
    centers = np.array(cells.clusterCenters())
    square = (centers * centers).sum(axis=1)

    def nearest_cells(vectors: pd.Series) -> pd.Series:
        points = np.array(vectors.tolist(), dtype=np.float64)
        gaps = square[None, :] - 2 * points @ centers.T
        return pd.Series(list(np.argsort(gaps, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    pick = F.pandas_udf(nearest_cells, T.ArrayType(T.IntegerType()))
    probing = questions.where(F.col(vector).isNotNull()).withColumn("_cells", pick(vector))
    # At most one value per cell of the model.
    probed = [r[0] for r in probing.select(F.explode("_cells")).distinct().collect()]
    visible = celled.where(F.col("cell").isin(probed))
    return top_k(visible, probing, vector=vector, cell="cell", **options)
