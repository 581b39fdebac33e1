"""Text encoders that give every chunk a unit vector."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
)
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.sources.tables import cut_lineage

# Vector length and the batch size of a user encoder.
DIMENSIONS = 384
ENCODE_BATCH = 64

# Words, lower-cased, each sent to one of the dimensions by its md5.
_BUCKETS = r"""
SELECT *, transform(
    regexp_extract_all(lower({text}), r'[\p{{L}}\p{{N}}]+', 0),
    w -> CAST(CAST(conv(substring(md5(w), 1, 8), 16, 10) AS BIGINT) % {dimensions} AS STRING)
  ) AS _buckets
FROM __THIS__"""


def _counter(text_column: str, dimensions: int) -> PipelineModel:
    slots = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(dimensions)], inputCol="_buckets", outputCol="_counts"
    )
    words = SQLTransformer(statement=_BUCKETS.format(text=text_column, dimensions=dimensions))
    return PipelineModel([words, slots])


def _slots(dimensions: int) -> Callable[[Column], Column]:
    """The filled slots of a list of words and the words in each, as sorted arrays.

    The same counts as the model's own first stages, where a word's md5 is taken for
    every time it occurs; here once for all rows of a batch.
    """

    def count(words: pa.Array) -> pa.Array:
        n_words = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        digests = [hashlib.md5(w.encode()).digest()[:4] for w in coded.dictionary.to_pylist()]
        slots = np.array([int.from_bytes(d, "big") % dimensions for d in digests], np.int64)
        rows = np.repeat(np.arange(len(words)), n_words)
        cells, counts = np.unique(
            rows * dimensions + slots[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True
        )
        ends = np.searchsorted(cells, np.arange(len(words) + 1) * dimensions).astype(np.int32)
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(ends, pa.array((cells % dimensions).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
            ],
            names=["slots", "counts"],
        )

    count.__annotations__ = {"words": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, "struct<slots:array<int>,counts:array<int>>")


def unit_matrix(idf: np.ndarray) -> Callable[[pa.Array], np.ndarray]:
    """A function from counted slots to weighted rows of length one, in single precision."""

    def weigh(counted: pa.Array) -> np.ndarray:
        if isinstance(counted, pa.ChunkedArray):
            counted = counted.combine_chunks()
        slots, counts = counted.flatten()
        filled = np.zeros((len(counted), len(idf)))
        rows = np.repeat(np.arange(len(counted)), slots.value_lengths().to_numpy(zero_copy_only=False))
        places = slots.flatten().to_numpy(zero_copy_only=False)
        filled[rows, places] = counts.flatten().to_numpy(zero_copy_only=False) * idf[places]
        lengths = np.sqrt((filled * filled).sum(axis=1))
        lengths[lengths == 0] = 1.0
        filled /= lengths[:, None]
        return filled.astype(np.float32)

    return weigh


def _unit_of(idf: np.ndarray) -> Callable[[Column], Column]:
    """The vector of counted slots as a column."""
    weigh = unit_matrix(idf)

    def vectors(counted: pa.Array) -> pa.Array:
        rows = weigh(counted)
        ends = np.arange(len(rows) + 1, dtype=np.int32) * len(idf)
        return pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))

    vectors.__annotations__ = {"counted": pa.Array, "return": pa.Array}
    return F.arrow_udf(vectors, T.ArrayType(T.FloatType()))


def _counted(text: str, dimensions: int) -> Column:
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return _slots(dimensions)(words)


def _fitted(counted: DataFrame, text_column: str, dimensions: int) -> tuple[PipelineModel, np.ndarray]:
    """The encoder of counted rows: one counter for each dimension reaches the driver."""
    seen = counted.select(F.explode("_counted.slots").alias("slot")).groupBy("slot").count()
    frequency = np.zeros(dimensions)
    for slot, n in seen.collect():
        frequency[slot] = n
    idf = np.log((counted.count() + 1.0) / (frequency + 1.0))
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense(idf), inputCol="_counts", outputCol="_weighted"
    )
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit")
    return PipelineModel([*_counter(text_column, dimensions).stages, scale, unit]), idf


def fit_hashed_tfidf(
    chunks: DataFrame, text_column: str = "text", dimensions: int = DIMENSIONS
) -> PipelineModel:
    """Hashed word counts weighted by inverse document frequency, unit length.

    All stages are Spark ML's own, so the model saves and loads as any pipeline does.
    """
    counted = chunks.select(_counted(text_column, dimensions).alias("_counted"))
    return _fitted(cut_lineage(counted), text_column, dimensions)[0]


def fit_and_count(
    chunks: DataFrame, text_column: str = "text", dimensions: int = DIMENSIONS
) -> tuple[PipelineModel, DataFrame, np.ndarray]:
    """The fitted encoder, the chunks with their filled slots as ``_counted`` and the slots'
    weights: a search reads a tenth of what vectors take, by :func:`unit_matrix`."""
    counted = cut_lineage(chunks.withColumn("_counted", _counted(text_column, dimensions)))
    if counted.isEmpty():
        raise ValueError("there is no chunk to encode")
    model, idf = _fitted(counted, text_column, dimensions)
    return model, counted, idf


def fit_and_encode(
    chunks: DataFrame,
    text_column: str = "text",
    dimensions: int = DIMENSIONS,
    output: str = "embedding",
) -> tuple[PipelineModel, DataFrame]:
    """The fitted encoder and the encoded chunks, with the words counted once.

    The counts are written to the shared folder; fitting and encoding read them.
    """
    model, counted, idf = fit_and_count(chunks, text_column, dimensions)
    return model, counted.select(*chunks.columns, _unit_of(idf)(F.col("_counted")).alias(output))


def _hashed_weights(model: PipelineModel) -> tuple[str, np.ndarray] | None:
    """Text column and weights of a model that :func:`fit_and_encode` made; None for others."""
    kinds = (SQLTransformer, CountVectorizerModel, ElementwiseProduct, Normalizer)
    if [type(s) for s in model.stages] != list(kinds):
        return None
    idf = np.array(model.stages[2].getScalingVec())
    statement = model.stages[0].getStatement()
    named = re.search(r"regexp_extract_all\(lower\((\w+)\)", statement)
    if not named or statement != _BUCKETS.format(text=named[1], dimensions=len(idf)):
        return None
    return named[1], idf


def encode(chunks: DataFrame, model: PipelineModel, output: str = "embedding") -> DataFrame:
    """Rows plus their vector as ``array<float>``."""
    if (hashed := _hashed_weights(model)) is not None:
        text, idf = hashed
        return chunks.withColumn(output, _unit_of(idf)(_counted(text, len(idf))))
    return model.transform(chunks).select(
        *chunks.columns, vector_to_array("_unit", "float32").alias(output)
    )


def encode_with(
    chunks: DataFrame,
    load_encoder: Callable[[], Callable[[list[str]], object]],
    text_column: str = "text",
    output: str = "embedding",
    batch_size: int = ENCODE_BATCH,
) -> DataFrame:
    """Rows plus vectors of a user's encoder.

    ``load_encoder`` runs once per Python process and returns a function from a list of
    at most ``batch_size`` texts to as many vectors of one length.  Only the text column
    goes to Python; a null text is an empty one.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        encoder = load_encoder()

        def predict(texts: np.ndarray) -> np.ndarray:
            vectors = np.asarray(encoder([str(t) for t in texts]), np.float32)
            if vectors.ndim != 2 or len(vectors) != len(texts):
                raise ValueError(f"the encoder gave shape {vectors.shape} for {len(texts)} texts")
            return vectors

        return predict

    encoded = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return chunks.withColumn(output, encoded(F.coalesce(F.col(text_column), F.lit(""))))


def unit_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Given vectors scaled to length one; a zero vector stays zero."""
    square = F.aggregate(
        column, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    scaled = F.transform(column, lambda x: (x / F.col("_length")).cast("float"))
    return (
        df.withColumn("_length", F.sqrt(square))
        .withColumn(column, F.when(F.col("_length") > 0, scaled).otherwise(F.col(column)))
        .drop("_length")
    )
