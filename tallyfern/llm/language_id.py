"""Language identification (operator 2): averaged hashed subword embeddings.

Letters of a text, with one mark between words, give all runs of two to four
marks; each run hashes to an embedding, and the mean embedding of the whole text
goes through a linear softmax.  Embeddings and softmax are trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents; a held-back
part of the sample calibrates the score and the limit below which a prediction is
marked as rejected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.llm.batches import field, map_rows
from tallyfern.llm.bpe import LETTER, _point_classes

SIZES = (2, 3, 4)
BUCKETS = 1 << 15
DIMENSIONS = 16
CHUNK_POINTS = 1 << 19
#: Expected number of labelled documents that the model is fitted on, over all
#: languages together; the bound of what reaches the driver.
SAMPLE_DOCUMENTS = 2_000
#: Most languages learned: the most frequent ones.
MAX_LANGUAGES = 500
EPOCHS = 12
STEP_RUNS = 256
CALIBRATION_SHARE = 5
TARGET_PRECISION = 0.99
UNKNOWN = "und"
HOLD_OUT = 2


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that nothing is learned from; false for a null id."""
    rest = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))
    return F.coalesce(rest == HOLD_OUT, F.lit(False))


def subword_runs(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs, the text each belongs to, and whether a text has letters.

    Runs come text by text for each size in turn.
    """
    joined = " ".join(f" {t} " for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t.lower()) + 3 for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(points)]
    letters = _point_classes()[points] == LETTER
    same = owner[1:] == owner[:-1]
    keep = letters | np.append(True, letters[:-1] | ~same)
    has_letters = np.bincount(owner[letters], minlength=len(texts)) > 0
    marks = np.where(letters, points, 32)[keep]
    owner = owner[keep]
    buckets, owners = [], []
    code = marks * np.uint32(2654435761)
    for size in range(2, max(SIZES) + 1):
        code = (code[:-1] ^ (code[:-1] >> np.uint32(15))) * np.uint32(2246822519) + marks[size - 1 :]
        if size in SIZES:
            inside = owner[size - 1 :] == owner[: 1 - size]
            mixed = code[inside] * np.uint32(3266489917)
            buckets.append(mixed >> np.uint32(32 - 15))
            owners.append(owner[: 1 - size][inside])
    return np.concatenate(buckets), np.concatenate(owners), has_letters


def _chunks(texts: Sequence[str]):
    chunk, points = [], 0
    for text in texts:
        if chunk and points + len(text) > CHUNK_POINTS:
            yield chunk
            chunk, points = [], 0
        chunk.append(text)
        points += len(text)
    if chunk:
        yield chunk


def mean_rows(texts: Sequence[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of ``table``'s rows over each text's runs, and whether it has letters."""
    means, seen = [], []
    for chunk in _chunks(texts):
        buckets, owners, letters = subword_runs(chunk)
        totals = np.empty((len(chunk), table.shape[1]))
        for i in range(table.shape[1]):
            totals[:, i] = np.bincount(owners, table[buckets, i], len(chunk))
        counts = np.bincount(owners, minlength=len(chunk))
        means.append(totals / np.maximum(counts, 1)[:, None])
        seen.append(letters)
    if not means:
        return np.empty((0, table.shape[1])), np.empty(0, bool)
    return np.concatenate(means), np.concatenate(seen)


@dataclass
class LanguageModel:
    """``table``: each bucket's contribution to the class scores (embedding times
    softmax weights, or the embedding where that is narrower)."""

    languages: list[str]
    table: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def scores(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        means, letters = mean_rows(texts, self.table)
        if self.weights is not None:
            means = means @ self.weights
        return _softmax((means + self.bias) / self.temperature), letters


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def train(
    rows: Sequence[tuple[int, np.ndarray, np.ndarray]], languages: list[str], seed: int = 7
) -> LanguageModel:
    """Fit on ``rows`` of (language number, bucket ids, counts).

    A step draws ``STEP_RUNS`` runs of one document, so that short texts are learned
    too.  Every fifth row is held back for the temperature and the rejection limit.
    """
    rng = np.random.default_rng(seed)
    classes = len(languages)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = rng.normal(0, 0.1, (DIMENSIONS, classes))
    bias = np.zeros(classes)
    squares = [np.full(x.shape, 1e-6) for x in (table, weights, bias)]
    fitted = [r for i, r in enumerate(rows) if i % CALIBRATION_SHARE] or list(rows)
    checked = [r for i, r in enumerate(rows) if not i % CALIBRATION_SHARE] or list(rows)

    def draw(counts: np.ndarray, n: int) -> np.ndarray:
        return np.searchsorted(np.cumsum(counts), rng.random(n) * counts.sum(), side="right")

    for epoch in range(EPOCHS):
        rate = 0.2 * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(fitted)).tolist():
            language, buckets, counts = fitted[i]
            drawn, times = np.unique(buckets[draw(counts, STEP_RUNS)], return_counts=True)
            share = times / STEP_RUNS
            mean = share @ table[drawn]
            error = _softmax(mean @ weights + bias)
            error[language] -= 1
            to_table = np.outer(share, weights @ error)
            to_weights = np.outer(mean, error)
            squares[0][drawn] += to_table**2
            squares[1] += to_weights**2
            squares[2] += error**2
            table[drawn] -= rate * to_table / np.sqrt(squares[0][drawn])
            weights -= rate * to_weights / np.sqrt(squares[1])
            bias -= rate * error / np.sqrt(squares[2])

    logits, truth = [], []
    for language, buckets, counts in checked:
        for n in (8, 32, STEP_RUNS):
            mean = table[buckets[draw(counts, n)]].mean(0)
            logits.append(mean @ weights + bias)
            truth.append(language)
    logits, truth = np.array(logits), np.array(truth)
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    spread = _softmax(logits / temperature)
    best, right = spread.max(1), spread.argmax(1) == truth
    order = np.argsort(-best)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(precision >= TARGET_PRECISION)
    limit = float(best[order[enough[-1]]]) if len(enough) else 1.0
    narrow = classes <= DIMENSIONS
    return LanguageModel(
        languages,
        (table @ weights if narrow else table).astype(np.float32),
        None if narrow else weights,
        bias,
        temperature,
        limit,
    )


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    sample_documents: int = SAMPLE_DOCUMENTS,
) -> LanguageModel | None:
    """A model from documents that are not held out and have a language and a text.

    The same number of documents is expected of each language; they are chosen by a
    hash of the id at a rate that the languages' counts give.  Subwords are counted
    where the texts are; only the sample's counts reach the driver.  None without
    labelled documents.
    """
    usable = docs.where(
        ~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(lang).isNotNull()
    )
    sizes = usable.groupBy(F.col(lang).alias("lang")).count()
    counts = {r["lang"]: r["count"] for r in sizes.orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    quota = max(1, sample_documents // len(languages))
    rates = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, quota / counts[l]))])
    place = F.pmod(F.xxhash64(F.lit("sample"), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = usable.where(place < rates[F.col(lang)])

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            ids, counts = [], []
            for t in texts.to_pylist():
                found, letters = np.empty(0, np.int64), False
                if t:
                    found, _, seen = subword_runs([t])
                    letters = bool(seen[0])
                ids_of, n = np.unique(found, return_counts=True) if letters else (found[:0],) * 2
                ids.append(ids_of.astype("<u2").tobytes())
                counts.append(n.astype("<u4").tobytes())
            return [pa.array(ids, pa.binary()), pa.array(counts, pa.binary())]

        return work

    fields = [field("buckets", T.BinaryType()), field("counts", T.BinaryType())]
    counted = map_rows(
        chosen.withColumn("__lang", F.col(lang)).withColumn("__id", F.col(doc_id)),
        [F.col(text).cast("string")],
        fields,
        make,
        ["__lang", "__id"],
    )
    number = {l: i for i, l in enumerate(languages)}
    rows = sorted(
        (str(r["__id"]), number[r["__lang"]], bytes(r["buckets"]), bytes(r["counts"]))
        for r in counted.collect()
        if r["buckets"]
    )
    if not rows:
        return None
    return train(
        [(l, np.frombuffer(b, "<u2"), np.frombuffer(c, "<u4")) for _, l, b, c in rows], languages
    )


def identify(
    docs: DataFrame,
    model: LanguageModel | None,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``keep`` with ``lang_pred``, ``score`` (calibrated probability of it) and
    ``rejected`` (the score is below the calibrated limit), for whole texts.

    Null texts, texts without a letter, and all texts without a model are ``und``
    with score 0, rejected.  Nothing but the text is used.  No shuffle; one row out
    per row in, and a column of ``keep`` named as an output column gives way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def work(column: pa.Array) -> list[pa.Array]:
            texts = [t or "" for t in column.to_pylist()]
            names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
            low = np.ones(len(texts), bool)
            if fitted is not None and texts:
                spread, letters = fitted.scores(texts)
                top = spread.argmax(1)
                names = [fitted.languages[i] if l else UNKNOWN for i, l in zip(top, letters)]
                best = np.where(letters, spread.max(1), 0.0)
                low = ~letters | (best < fitted.limit)
            return [pa.array(names, pa.string()), pa.array(best), pa.array(low)]

        return work

    fields = [
        field("lang_pred", T.StringType()),
        field("score", T.DoubleType()),
        field("rejected", T.BooleanType()),
    ]
    return map_rows(docs, [F.col(text).cast("string")], fields, make, keep)
