"""Benchmark decontamination (operator 3): one automaton over all test windows.

Windows of consecutive benchmark words form one Aho-Corasick automaton whose
alphabet is the benchmark's vocabulary.  A document is normalised, turned into
word numbers and scanned once; the words hit map back to offsets in its text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.llm.batches import field, map_rows, utf8
from tallyfern.sources.tables import cut_lineage

#: Fixed by the contract: words of a window; hit words per hundred that contaminate.
WINDOW_WORDS = 13
MIN_PERCENT = 5
#: Benchmark text in one automaton.  A larger benchmark is scanned in several passes.
BLOCK_BYTES = 4 << 20

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(raw: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return raw.translate(_WORD_BYTES).split()


class WindowAutomaton:
    """Finds every occurrence of every window of the given items."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW_WORDS):
        self.numbers: dict[bytes, int] = {}
        self.items: list[str] = []
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, raw in items:
            sequence = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(raw)]
            if not sequence:
                continue
            self.items.append(item)
            for i in range(max(1, len(sequence) - window + 1)):
                found = windows.setdefault(tuple(sequence[i : i + window]), set())
                found.add(len(self.items) - 1)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window_words, owners in windows.items():
            self.machine.add_word(window_words, (len(window_words), tuple(owners)))
        self.machine.make_automaton()
        self.empty = not windows

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs of hit words (first, end exclusive) and the items that occur."""
        runs: list[tuple[int, int]] = []
        owners: set[int] = set()
        if self.empty or not words:
            return runs, set()
        number = self.numbers.get
        for last, (length, found) in self.machine.iter(tuple([number(w, 0) for w in words])):
            first, end = last + 1 - length, last + 1
            # occurrences come by their ends; a longer one may reach back over runs
            while runs and runs[-1][1] >= first:
                first = min(first, runs.pop()[0])
            runs.append((first, end))
            owners.update(found)
        return runs, {self.items[i] for i in owners}


_built: dict[str, WindowAutomaton] = {}


def _automaton(name: str, shared, window: int) -> WindowAutomaton:
    """Built once in each worker process."""
    if name not in _built:
        _built.clear()
        _built[name] = WindowAutomaton(shared.value, window)
    return _built[name]


HITS = (
    field("n_words", T.LongType()),
    field("hit_runs", T.ArrayType(T.LongType())),
    field("hit_items", T.ArrayType(T.StringType())),
)


def _scan_block(docs: DataFrame, shared, name: str, text: str, keep, window: int, before: bool):
    def make():
        automaton = _automaton(name, shared, window)

        def work(column: pa.Array, *earlier: pa.Array) -> list[pa.Array]:
            counts, runs, items = [], [], []
            old = zip(*(e.to_pylist() for e in earlier)) if before else iter(())
            for raw in utf8(column):
                words = words_of(raw)
                found, owners = automaton.scan(words)
                if before:
                    flat, known = next(old)
                    found = _merged([*found, *zip(flat[::2], flat[1::2])])
                    owners |= set(known)
                counts.append(len(words))
                runs.append([p for run in found for p in run])
                items.append(sorted(owners))
            return [
                pa.array(counts, pa.int64()),
                pa.array(runs, pa.list_(pa.int64())),
                pa.array(items, pa.list_(pa.string())),
            ]

        return work

    inputs = [F.col(text).cast("string")]
    inputs += [F.col("hit_runs"), F.col("hit_items")] if before else []
    return map_rows(docs, inputs, HITS, make, keep)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((first, end))
    return merged


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    window: int = WINDOW_WORDS,
    min_percent: int = MIN_PERCENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` with ``n_words``, ``hit_runs`` (first and end word of each run of hit
    words, flat), ``n_hit``, ``hit_items`` (ids, sorted), ``n_items``, ``contaminated``.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.
    A benchmark item gives all its windows of ``window`` words, or its whole word
    sequence if it has fewer; a document is contaminated if hit words are at least
    ``min_percent`` of its words.

    The benchmark's size is measured first.  Up to ``block_bytes`` its texts are
    broadcast and the documents scanned once, without a shuffle; a larger one is
    dealt into blocks of that size, the documents are scanned once per block and
    each pass is cut into the shared folder.

    Null or word-less texts have no words and are clean; null or word-less items
    are never found; an item whose id is null has the id "".  Repeated items and
    documents count as they stand, and a column of ``keep`` named as an output
    column gives way to it.  ``keep`` must name what the caller still needs.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        F.encode(F.col(item_text).cast("string"), "UTF-8").alias("raw"),
    ).where(F.col("raw").isNotNull())
    size = items.agg(F.sum(F.length("raw")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    marked = items.withColumn("block", F.pmod(F.xxhash64("item", "raw"), F.lit(blocks)))
    found, kept = docs, list(keep)
    for i in range(blocks):
        rows = marked.where(F.col("block") == i).select("item", "raw").collect()
        value = [(r["item"], bytes(r["raw"])) for r in rows]
        shared, name = spark.sparkContext.broadcast(value), f"{hash(tuple(value))} {window}"
        last = i == blocks - 1
        carried = kept if last else [*dict.fromkeys([*kept, text])]
        found = _scan_block(found, shared, name, text, carried, window, i > 0)
        found = found if last else cut_lineage(found)
    hit = F.expr(
        "aggregate(transform(hit_runs, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)"
    )
    return (
        found.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("hit_items").cast("long"))
        .withColumn(
            "contaminated",
            (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words")),
        )
    )


def hit_spans(raw_text: str, hit_runs: Sequence[int]) -> list[tuple[int, int]]:
    """Code-point spans in the original text of flat word runs."""
    places = [m.span() for m in _WORD.finditer(raw_text)]
    pairs = zip(hit_runs[::2], hit_runs[1::2])
    return [(places[first][0], places[end - 1][1]) for first, end in pairs]


def locate(
    found: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` with ``hit_spans``: start and end (exclusive) in the original text of
    each run of hit words, flat, for rows that :func:`contamination` returned with
    their text kept; rows without hits have an empty list."""

    def make():
        def work(texts: pa.Array, runs: pa.Array) -> list[pa.Array]:
            spans = [
                [p for span in hit_spans(t, r) for p in span] if r else []
                for t, r in zip(texts.to_pylist(), runs.to_pylist())
            ]
            return [pa.array(spans, pa.list_(pa.int64()))]

        return work

    fields = [field("hit_spans", T.ArrayType(T.LongType()))]
    return map_rows(found, [F.col(text), F.col("hit_runs")], fields, make, keep)
