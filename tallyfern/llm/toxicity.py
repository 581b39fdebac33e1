"""Toxicity (operator 4): noisy-channel deobfuscation, then a score of the restored words.

A written form with digits or signs inside, letters drawn out, or letters spaced
apart becomes a lattice: each mark stands for itself, for letters it imitates, or for
nothing.  A Viterbi pass under a character trigram model of the whole corpus
picks the most probable word; the document is scored by the words restored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.llm.batches import bound_batches, field, map_rows, utf8
from tallyfern.llm.language_id import held_out
from tallyfern.sources.tables import cut_lineage

# Marks and the letters that they imitate.
IMITATIONS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
    "€": "e", "£": "l", "*": "aeiou", "#": "aeiouh", "%": "aeiou", "&": "aeiou",
}
#: Log-costs of the channel: imitation, a mark that is noise though it could imitate
#: a letter, any other mark, letters drawn out to three or more, doubled letters.
IMITATED, NOISE, SEPARATOR, DRAWN_OUT, DOUBLED = -0.7, -12.0, -0.5, -0.7, -6.0
#: Lengths of the word beginnings that count as features beside the words.
BEGINNINGS = (3, 4, 5, 7)
SPACED_LETTERS = 3
LEXICON_DOCUMENTS = 4
CONTAINED_LENGTH = 4
#: Expected numbers of labelled documents the classifier is fitted on: the bound of
#: its sample, toxic and not.
SAMPLE_TOXIC, SAMPLE_OTHER = 4_000, 8_000
THRESHOLD = 0.3
#: Least odds ratio of a lexicon word, and the feature that any of them occurs.
LEAST_ODDS = 8
ANY = "-"
#: Share of the toxic documents that a sure word is in, and what its imagined document counts.
SURE_SHARE, SURE_WEIGHT = 0.1, 5.0
CACHED_FORMS = 400_000
SYMBOLS = 64

_WORDS = re.compile(r"[^\W\d_]+")
_DRAWN = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[ .\-_*]{1,2}\S){%d,}(?!\S)" % (SPACED_LETTERS - 1))
_OUTER = re.compile(r"^[^\w@$|]+|[^\w]+$")


def _symbols() -> np.ndarray:
    """Letter symbols of code points under 65,536: 1-26 for a-z, the others by hash."""
    table = np.zeros(1 << 16, np.uint8)
    for point in range(1 << 16):
        mark = chr(point)
        if "a" <= mark <= "z":
            table[point] = point - 96
        elif mark.isalpha():
            table[point] = 27 + point % (SYMBOLS - 27)
    return table


_TABLE = _symbols()


def symbol_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _TABLE[np.minimum(points, 0xFFFF)]


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``gram`` (three letter symbols, 0 between words) and ``n`` over all texts.

    Each task sums its batches; at most ``SYMBOLS`` cubed rows leave it.
    """
    bound_batches(docs.sparkSession)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for part in parts:
            for raw in utf8(part.column(0)):
                codes = symbol_codes(" " + raw.decode().lower() + " ").astype(np.int64)
                grams = (codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:]
                if len(grams) > len(total) // 8:
                    total += np.bincount(grams, minlength=len(total))
                else:
                    found, n = np.unique(grams, return_counts=True)
                    total[found] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(total[seen])], names=["gram", "n"]
        )

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class CharacterModel:
    """Interpolated trigram log-probabilities of letter symbols."""

    log_p: np.ndarray

    @staticmethod
    def of(counts: dict[int, int]) -> CharacterModel:
        three = np.zeros(SYMBOLS**3)
        for gram, n in counts.items():
            three[gram] = n
        three = three.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two, one = three.sum(0), three.sum((0, 1))
        base = (one + 1) / (one.sum() + SYMBOLS)
        bi = (two + 20 * base) / (two.sum(1, keepdims=True) + 20)
        tri = (three + 5 * bi) / (three.sum(2, keepdims=True) + 5)
        return CharacterModel(np.log(tri).astype(np.float32))


def lattice(form: str) -> list[list[tuple[str, float]]]:
    """Readings of each run of equal marks: letters and the channel's log-cost."""
    steps = []
    for mark, run in itertools.groupby(form):
        n = len(list(run))
        if mark.isalpha():
            once = 0.0 if n == 1 else DOUBLED if n == 2 else DRAWN_OUT
            steps.append([(mark, once), *([(mark * 2, DRAWN_OUT * (n > 2))] if n > 1 else [])])
        else:
            readings = [("", NOISE if mark in IMITATIONS else SEPARATOR)]
            for letter in IMITATIONS.get(mark, ""):
                readings += [(letter, IMITATED), *([(letter * 2, IMITATED)] if n > 1 else [])]
            steps.append(readings)
    return steps


def restore(form: str, model: CharacterModel) -> str:
    """The most probable word behind a written form (Viterbi over two symbols).

    A path keeps its letters as a chain back to the start, so a form of any length costs
    linear time.  Equally probable words: the greatest.
    """
    log_p, code = model.log_p, lambda c: int(_TABLE[min(ord(c), 0xFFFF)])
    beams: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
    for readings in [*lattice(form), [(" ", 0.0)]]:
        following: dict[tuple[int, int], tuple] = {}
        for (a, b), (score, made) in beams.items():
            for letters, cost in readings:
                x, y, total = a, b, score + cost
                for c in letters:
                    z = code(c)
                    total += float(log_p[x, y, z])
                    x, y = y, z
                if (x, y) not in following or following[x, y][0] < total:
                    following[x, y] = (total, (made, letters) if letters else made)
        beams = following
    best = max(score for score, _ in beams.values())
    return max(_spelt(chain) for score, chain in beams.values() if score == best).strip()


def _spelt(chain: tuple | None) -> str:
    """The letters of a path, from its start."""
    found = []
    while chain is not None:
        chain, letters = chain
        found.append(letters)
    return "".join(reversed(found))


def readings_of(token: str, model: CharacterModel) -> tuple[str, ...]:
    """Words that a lower-case token between blanks stands for."""
    core = _OUTER.sub("", token)
    if not core:
        return ()
    plain = tuple(_WORDS.findall(core))
    if plain == (core,):
        return (core, restore(core, model)) if _DRAWN.search(core) else plain
    if not plain:
        return plain
    return tuple(dict.fromkeys([*plain, restore(core, model)]))


def edge_forms(token: str) -> list[str]:
    """The token's core with the marks beside it that imitate letters: those before it,
    those after it, both.  A mark there may be punctuation or the word's first or last
    letter, so these readings count only where they are whole words of the lexicon."""
    core = _OUTER.sub("", token)
    at = token.find(core) if core else 0
    if not core:  # nothing but marks
        return []
    first, last = at, at + len(core)
    while first and token[first - 1] in IMITATIONS:
        first -= 1
    while last < len(token) and token[last] in IMITATIONS:
        last += 1
    before, after = token[first:at], token[at + len(core) : last]
    return list(dict.fromkeys(f for f in (before + core, core + after, before + core + after) if f != core))


def spaced_words(text: str, model: CharacterModel) -> list[str]:
    """Words behind letters that stand apart, blanks and points between them."""
    found = []
    for match in _SPACED.finditer(text):
        letters = re.sub(r"[ .\-_*]", "", match[0])
        if len(set(letters)) > 2:
            found.append(restore(letters, model))
    return found


def marks_of(word: str) -> list[str]:
    """Features of a word: itself and its beginnings (with a hyphen)."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


class Reader:
    """Distinct restored words of documents; readings of tokens are remembered."""

    def __init__(self, model: CharacterModel, weights: dict[str, float] | None = None):
        self.model, self.weights = model, weights or {}
        self.long = [w for w in self.weights if len(w) >= CONTAINED_LENGTH and "-" not in w]
        self.known: dict[str, tuple] = {}
        self.edged: dict[str, tuple] = {}

    def words(self, text: str) -> set[str]:
        low, found = text.lower(), set()
        for token in set(low.split()):
            found.update(readings_of(token, self.model))
        found.update(spaced_words(low, self.model))
        return found

    def hits(self, text: str) -> dict[str, list[str]]:
        """The words with features in the lexicon, and those features."""
        low, found = text.lower(), {}
        edged: set[str] = set()
        for token in set(low.split()):
            edged.update(self.edge_words(token))
            reading = self.known.get(token)
            if reading is None:
                reading = tuple(
                    (w, marks)
                    for w in readings_of(token, self.model)
                    if (marks := [m for m in marks_of(w) if m in self.weights])
                )
                if len(self.known) >= CACHED_FORMS:
                    self.known.clear()
                self.known[token] = reading
            found.update(reading)
        for run in spaced_words(low, self.model):
            for word in (run, *(w for w in self.long if w in run)):
                if marks := [m for m in marks_of(word) if m in self.weights]:
                    found[word] = marks
        for word in edged:
            found.setdefault(word, [word])
        return found

    def edge_words(self, token: str) -> tuple[str, ...]:
        """Words of the lexicon behind a token whose first or last letter is disguised."""
        if token[0].isalnum() and token[-1].isalnum():
            return ()
        words = self.edged.get(token)
        if words is None:
            made = (restore(form, self.model) for form in edge_forms(token))
            words = tuple(sorted({w for w in made if w in self.weights and w != ANY}))
            if len(self.edged) >= CACHED_FORMS:
                self.edged.clear()
            self.edged[token] = words
        return words

    def total(self, text: str) -> float:
        """Sum of the weights of the features of a text's distinct words."""
        found = self.hits(text)
        if not found:
            return 0.0
        features = itertools.chain(*found.values())
        return sum(map(self.weights.__getitem__, features)) + self.weights.get(ANY, 0.0)


@dataclass
class ToxicityModel:
    characters: CharacterModel
    weights: dict[str, float]
    bias: float

    def score(self, totals: Sequence[float]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(totals, float) + self.bias, -30, 30)))


def _logistic(entries, shape: tuple[int, int], y: np.ndarray, share: np.ndarray, ridge: float = 0.1):
    """Weights and bias of a table given by its ``entries`` (row, column, value arrays), by
    Newton steps whose systems conjugate gradients solve: nothing of the size of
    rows times columns, or of columns squared, is held."""
    rows, columns, values = entries
    n, d = shape
    penalty = np.append(np.full(d, ridge), 1e-3)

    def times(beta: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values * beta[columns], n) + beta[-1]

    def back(v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, values * v[rows], d), v.sum())

    beta = np.zeros(d + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(times(beta), -500, 500)))
        slope = back(share * (p - y)) + penalty * beta
        curve = share * np.maximum(p * (1 - p), 1e-6)
        scale = np.append(np.bincount(columns, values**2 * curve[rows], d), curve.sum()) + penalty
        step, left = np.zeros(d + 1), slope.copy()
        towards = left / scale
        size, goal = float(left @ towards), 1e-20 * float(slope @ (slope / scale))
        for _ in range(2 * (d + 1) + 50):
            if size <= goal:
                break
            bent = back(curve * times(towards)) + penalty * towards
            length = size / float(towards @ bent)
            step += length * towards
            left -= length * bent
            scaled = left / scale
            before, size = size, float(left @ scaled)
            towards = scaled + size / before * towards
        beta -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    sample_toxic: int = SAMPLE_TOXIC,
    sample_other: int = SAMPLE_OTHER,
) -> ToxicityModel:
    """The character model of all texts, and a word classifier from labelled rows that
    are not held out.

    Labelled documents are sampled by a hash of the id, at rates that keep the stated
    numbers; the sample's words are counted by Spark, and only those over the limits of
    count and odds, and the documents' hits among them, reach the driver.  Null labels and ids are
    not used; a repeated id counts with its largest label.
    """
    grams = {r["gram"]: r["n"] for r in trigram_counts(docs, text).collect()}
    characters = CharacterModel.of(grams)
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("__id"))
        .agg(F.max(F.col(label).cast("int")).alias("__label"))
    )
    sizes = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    rates = {k: min(1.0, (sample_toxic if k == 1 else sample_other) / n) for k, n in sizes.items()}
    if not rates.get(1) or len(rates) < 2:
        return ToxicityModel(characters, {}, 30.0 if rates.get(1) else -30.0)
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "__id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("__label") == 1, rates[1]).otherwise(max(v for k, v in rates.items() if k != 1))
    # The rates bound the chosen ids, whatever the documents, so texts stay where they are.
    chosen_ids = F.broadcast(known.where(place < rate))
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"))
    sample = texts.join(chosen_ids, "__id")
    shared = docs.sparkSession.sparkContext.broadcast(characters)

    def make():
        reader = Reader(shared.value)

        def work(column: pa.Array) -> list[pa.Array]:
            words = [
                sorted({m for w in reader.words(t or "") for m in marks_of(w)})
                for t in column.to_pylist()
            ]
            return [pa.array(words, pa.list_(pa.string()))]

        return work

    fields = [field("words", T.ArrayType(T.StringType()))]
    read = cut_lineage(
        map_rows(sample, [F.col("__text")], fields, make, ["__id", "__label", "__text"])
    )
    toxic = F.col("__label") == 1
    totals = read.agg(F.count(F.when(toxic, 1)).alias("p"), F.count(F.when(~toxic, 1)).alias("n")).first()
    pos, neg = max(1, totals["p"]), max(1, totals["n"])
    odds = F.log(((F.col("p") + 0.5) / pos) / ((F.col("n") + 0.5) / neg))
    chosen = (
        read.select(F.explode("words").alias("word"), toxic.alias("toxic"))
        .groupBy("word")
        .agg(F.count(F.when(F.col("toxic"), 1)).alias("p"), F.count(F.when(~F.col("toxic"), 1)).alias("n"))
        .where((F.col("p") >= LEXICON_DOCUMENTS) & (odds > math.log(LEAST_ODDS)))
    )
    # each is in several of the sampled toxic documents, so the sample bounds them
    listed = sorted((r["word"], r["p"], r["n"]) for r in chosen.collect())
    lexicon = [w for w, _, _ in listed]

    def make_hits():
        reader = Reader(shared.value, dict.fromkeys(lexicon, 0.0))

        def work(column: pa.Array) -> list[pa.Array]:
            hits = [sorted(itertools.chain(*reader.hits(t or "").values())) for t in column.to_pylist()]
            return [pa.array(hits, pa.list_(pa.string()))]

        return work

    hit_fields = [field("hit", T.ArrayType(T.StringType()))]
    hits = map_rows(read, [F.col("__text")], hit_fields, make_hits, ["__label"])
    # documents with equal hits are one weighted row
    table = hits.groupBy("hit", toxic.alias("toxic")).count().collect()
    rows = sorted((tuple(r["hit"]), r["toxic"], r["count"]) for r in table)
    # each class counts as if all its labelled documents had been read
    other = sum(n for k, n in sizes.items() if k != 1)
    scale = {True: sizes[1] / pos, False: other / neg}
    weighted = [(h, t, n * scale[t]) for h, t, n in rows]
    weights, bias = word_weights([*weighted, *sure_rows(listed, pos)], lexicon)
    return ToxicityModel(characters, weights, bias)


def sure_rows(listed: Sequence[tuple[str, int, int]], toxic_documents: int) -> list[tuple]:
    """Imagined toxic documents of one word each, for the words that a good share of the
    toxic documents and no other has: such a word is enough by itself."""
    lexicon = {w for w, _, _ in listed}
    return [
        ([m for m in marks_of(w) if m in lexicon], True, SURE_WEIGHT)
        for w, p, n in listed
        if "-" not in w and n == 0 and p >= SURE_SHARE * toxic_documents
    ]


def word_weights(
    rows: Sequence[tuple[Sequence[str], bool, float]], lexicon: Sequence[str]
) -> tuple[dict[str, float], float]:
    """Logistic weights of the lexicon from (features with repeats, toxic, weight) rows."""
    place_of = {w: i for i, w in enumerate([*lexicon, ANY])}
    counted: Counter[tuple[int, int]] = Counter()
    for i, (hit, _, _) in enumerate(rows):
        counted.update((i, place_of[w]) for w in hit)
        if hit:
            counted[i, place_of[ANY]] = 1
    pairs = np.array([*counted], np.int64).reshape(-1, 2)
    entries = (pairs[:, 0], pairs[:, 1], np.array([*counted.values()], float))
    y, share = (np.array([r[k] for r in rows], float) for k in (1, 2))
    weights, bias = _logistic(entries, (len(rows), len(place_of)), y, share)
    return dict(zip([*lexicon, ANY], weights.tolist())), bias


def toxicity(
    docs: DataFrame, model: ToxicityModel, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.3), for whole texts.

    Null, empty and word-less texts have the score of a document without a lexicon
    word.  Only the text is used.  No shuffle; one row out per row in, and a column
    of ``keep`` named as an output column gives way to it.  The model that is
    broadcast holds at most ``SYMBOLS`` cubed numbers and the words of a bounded sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value
        reader = Reader(fitted.characters, fitted.weights)

        def work(column: pa.Array) -> list[pa.Array]:
            score = fitted.score([reader.total(t or "") for t in column.to_pylist()])
            return [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]

        return work

    fields = [field("score", T.DoubleType()), field("predicted", T.IntegerType())]
    return map_rows(docs, [F.col(text).cast("string")], fields, make, keep)
