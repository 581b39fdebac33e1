"""Source divergence audit (operator 13): in-mapper stripes of terms.

A task folds whole documents into stripes: for each (language, term) the documents that
have it and its count by source.  Stripes are spilled to the shuffle when they hold many
entries, meet by key and are merged there; terms of few documents go.  Each merged
stripe then directly emits its part of every divergence: the distance of two sources'
smoothed shares of the term, and a source's excess over its language.  Tasks add these
parts up by pair and keep the largest excesses of each group, so only sums and top lists
are shuffled again.

Sources of a language are hashed into blocks of about ``BLOCK`` and a stripe goes once to
each pair of blocks, so a task holds ``BLOCK``-square sums at most, and the shares of the
two blocks' groups, which arrive ahead of the stripes in the same sorted stream.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyfern.llm.batches import bound_batches, field
from tallyfern.sources.tables import cut_lineage

# The terms, the documents a kept term is in, smoothing, scale and top list.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50

#: Entries (a term's count in a source) that a task's stripes hold before they spill.
STRIPE_ENTRIES = 1 << 19
#: Sources of a block, and the terms that are laid out as one matrix.
BLOCK, TERMS_TOGETHER = 256, 512
#: Parts that a language's terms are dealt into for each of this many kept terms.
TERMS_PER_PART = 4096

STRIPE = T.StructType(
    [
        field("lang", T.StringType()),
        field("term", T.StringType()),
        field("documents", T.LongType()),
        field("sources", T.ArrayType(T.StringType())),
        field("counts", T.ArrayType(T.LongType())),
    ]
)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


#: The key of the document count in a stripe, beside its sources.
DOCUMENTS = None


def _lists(values: list, sizes: list[int], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _stripe_rows(lang: str, stripes: dict[str, dict], step: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Stripes as rows; taking the document count out leaves the sources' counts."""
    terms = list(stripes)
    for at in range(0, len(terms), step):
        own = terms[at : at + step]
        rows = [stripes[t] for t in own]
        documents = [r.pop(DOCUMENTS) for r in rows]
        sizes = [len(r) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(own), pa.string()),
                pa.array(own, pa.string()),
                pa.array(documents, pa.int64()),
                _lists([x for r in rows for x in r], sizes, pa.string()),
                _lists([x for r in rows for x in r.values()], sizes, pa.int64()),
            ],
            names=STRIPE.names,
        )


def _folded(entries: int):
    find = re.compile(TERM).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[str, dict[str, dict]] = {}
        held = 0
        for batch in batches:
            for text, lang, source in zip(*[c.to_pylist() for c in batch.columns]):
                low = text.lower() if text.isascii() else text.encode().lower().decode()
                own = stripes.setdefault(lang, {})
                known = own.get
                for term, n in Counter(find(low)).items():
                    stripe = known(term)
                    if stripe is None:
                        own[term] = {DOCUMENTS: 1, source: n}
                        held += 1
                    else:
                        stripe[DOCUMENTS] += 1
                        if source in stripe:
                            stripe[source] += n
                        else:
                            stripe[source] = n
                            held += 1
                if held >= entries:
                    for name, full in stripes.items():
                        yield from _stripe_rows(name, full)
                    stripes, held = {}, 0
        for name, full in stripes.items():
            yield from _stripe_rows(name, full)

    return run


def _merged(least: int):
    """Over stripes sorted by key: runs of equal keys are found by whole columns, and only
    stripes of terms in enough documents are opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None  # the last key of a batch may go on in the next one
        documents, pieces = 0, []
        kept: dict[str, dict[str, dict]] = {}

        def take() -> None:
            if key is not None and documents >= least:
                stripe = kept.setdefault(key[0], {})[key[1]] = {DOCUMENTS: documents}
                for sources, own in pieces:
                    for source, n in zip(sources.to_pylist(), own.to_pylist()):
                        stripe[source] = stripe.get(source, 0) + n

        def flush(rows: int) -> Iterator[pa.RecordBatch]:
            if sum(map(len, kept.values())) >= rows:
                for lang, own in kept.items():
                    yield from _stripe_rows(lang, own)
                kept.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            langs, terms, sums, sources, counts = batch.columns
            fresh = np.ones(len(terms), bool)
            same = [pc.equal(c.slice(1), c.slice(0, len(c) - 1)) for c in (langs, terms)]
            fresh[1:] = ~pc.and_(*same).to_numpy(zero_copy_only=False)
            starts = np.nonzero(fresh)[0]
            ends = np.append(starts[1:], len(terms))
            totals = np.add.reduceat(sums.to_numpy(), starts)
            for i in np.nonzero((totals >= least) | (starts == 0) | (ends == len(terms)))[0].tolist():
                start, end = int(starts[i]), int(ends[i])
                own = (langs[start].as_py(), terms[start].as_py())
                if own != key:
                    take()
                    key, documents, pieces = own, 0, []
                documents += int(totals[i])
                pieces.append((sources.slice(start, end - start).flatten(), counts.slice(start, end - start).flatten()))
            yield from flush(4096)
        take()
        yield from flush(1)

    return run


def kept_stripes(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    entries: int = STRIPE_ENTRIES,
) -> DataFrame:
    """Stripes of the terms in at least ``min_documents`` documents of their language:
    ``lang``, ``term``, ``documents``, ``sources``, ``counts``."""
    bound_batches(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in (text, lang, source)])
    stripes = plain.mapInArrow(_folded(entries), STRIPE)
    met = stripes.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return met.mapInArrow(_merged(max(1, min_documents)), STRIPE)


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly."""
    below = totals + SMOOTHING * terms
    rest = counts + SMOOTHING
    if int(below.max(initial=1)) > 1 << 52:  # a thousandfold remainder would not fit
        return 1 + (SCALE * rest.astype(object) // below.astype(object)).astype(np.int64)
    whole = np.zeros(np.broadcast(rest, below).shape, np.int64)
    step = 1000
    for _ in range(3):  # long division, three decimal digits a time
        rest = rest * step
        whole = whole * step + rest // below
        rest = rest % below
    return 1 + whole


MADE = T.StructType(
    [
        field("lang", T.StringType()),
        field("source", T.StringType()),
        field("part", T.StringType()),
        field("item", T.StringType()),
        field("value", T.LongType()),
    ]
)
_MADE_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]


class _Cell:
    """Sums of one pair of blocks over the stripes of one part."""

    def __init__(self, lang: str, same: bool, terms: int, total: int, top: int):
        self.lang, self.same, self.terms, self.top = lang, same, terms, top
        self.total = np.array([total], np.int64)
        self.names: tuple[list[str], list[str]] = ([], [])
        self.totals: tuple[list[int], list[int]] = ([], [])
        self.stripes: list[tuple] = []
        self.sums: np.ndarray | None = None
        self.best: dict[int, list[tuple[int, bytes]]] = {}

    def close(self) -> None:
        """All groups are known: their places, and room for the sums."""
        self.at = tuple({s: i for i, s in enumerate(own)} for own in self.names)
        self.sums = np.zeros((len(self.names[0]), len(self.names[1])), np.int64)

    def _side(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros((len(self.stripes), len(self.names[side])), np.int64)
        at = self.at[side]
        for i, (_, sources, own) in enumerate(self.stripes):
            for source, n in zip(sources, own):
                j = at.get(source)
                if j is not None:
                    counts[i, j] = n
        return counts, shares(counts, np.array([self.totals[side]], np.int64), self.terms)

    def add(self) -> None:
        if self.sums is None:
            self.close()
        if not self.stripes:
            return
        counts, left = self._side(0)
        right = left if self.same else self._side(1)[1]
        for i in range(left.shape[1]):
            self.sums[i] += np.abs(left[:, i : i + 1] - right).sum(0)
        if self.same:
            every = np.array([[sum(x[2])] for x in self.stripes], np.int64)
            excess = left - shares(every, self.total, self.terms)
            for j in range(left.shape[1]):
                for i in np.nonzero((counts[:, j] > 0) & (excess[:, j] > 0))[0].tolist():
                    self._rank(j, int(excess[i, j]), self.stripes[i][0])
        self.stripes = []

    def _rank(self, j: int, value: int, term: str) -> None:
        """Keep the largest; of equal ones the first by bytes."""
        heap = self.best.setdefault(j, [])
        entry = (value, _Last(term.encode()))
        if len(heap) < self.top:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def rows(self) -> Iterator[tuple]:
        self.add()
        for i, a in enumerate(self.names[0]):
            for j, b in enumerate(self.names[1]):
                if a != b and (not self.same or i < j):
                    yield self.lang, a, "pair", b, int(self.sums[i, j])
        for j, heap in self.best.items():
            for value, term in heap:
                yield self.lang, self.names[0][j], "term", term.text.decode(), value


class _Last:
    """Bytes in descending order."""

    __slots__ = ("text",)

    def __init__(self, text: bytes):
        self.text = text

    def __lt__(self, other: _Last) -> bool:
        return self.text > other.text

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and self.text == other.text


def _emitted(top: int):
    """Over one task's stream, by (language, blocks, part): groups first, then stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        rows: list[tuple] = []
        for batch in batches:
            for lang, a, b, part, kind, terms, total, name, group, sources, counts in zip(
                *[c.to_pylist() for c in batch.columns]
            ):
                if (lang, a, b, part) != key:
                    if cell is not None:
                        rows.extend(cell.rows())
                    key, cell = (lang, a, b, part), _Cell(lang, a == b, terms, total, top)
                if kind < 2:
                    cell.names[kind].append(name)
                    cell.totals[kind].append(group)
                    if a == b:
                        cell.names[1].append(name)
                        cell.totals[1].append(group)
                else:
                    cell.stripes.append((name, sources, counts))
                    if len(cell.stripes) >= TERMS_TOGETHER:
                        cell.add()
            while len(rows) >= 4096:
                yield _batch(rows[:4096], MADE.names, _MADE_KINDS)
                rows = rows[4096:]
        if cell is not None:
            rows.extend(cell.rows())
        if rows:
            yield _batch(rows, MADE.names, _MADE_KINDS)

    return run


def divergences(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP_TERMS,
    entries: int = STRIPE_ENTRIES,
    block: int = BLOCK,
) -> DataFrame:
    """One row per group (language and source) and other source of the language (part
    ``pair``) or term of the ``top`` most over-represented (part ``term``): ``lang``,
    ``source``, ``part``, ``item``, ``value``, ``rank``.

    Null text, language and source are empty ones and form groups as any other; empty
    texts have no terms but make their group occur; repeated rows are documents each;
    very long texts are folded whole; extra columns are ignored; an empty table gives no
    row.  A language without kept terms has distances of 0 between its sources.
    """
    spark = docs.sparkSession
    stripes = cut_lineage(kept_stripes(docs, text, lang, source, min_documents, entries))
    seen = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("name"),
    ).distinct()
    counted = (
        stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
        .groupBy("lang", F.col("x.sources").alias("name"))
        .agg(F.sum("x.counts").alias("group"))
    )
    groups = seen.join(counted, ["lang", "name"], "left").na.fill({"group": 0})
    terms = stripes.groupBy("lang").agg(F.count("*").alias("terms"))
    languages = cut_lineage(
        groups.groupBy("lang")
        .agg(F.sum("group").alias("total"), F.count("*").alias("n"))
        .join(terms, "lang", "left")
        .na.fill({"terms": 0})
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("parts", F.ceil((F.col("terms") + 1) / TERMS_PER_PART).cast("int"))
        .select("lang", "total", "terms", "blocks", "parts")
    )

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # Each group goes to the pairs of its block with every block, in each part.
    own = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    placed = (
        groups.join(languages, "lang")
        .withColumn("own", own)
        .withColumn("other", every("blocks"))
        .withColumn("part", every("parts"))
        .select(
            "lang",
            F.least("own", "other").alias("a"),
            F.greatest("own", "other").alias("b"),
            "part",
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("kind"),
            "terms",
            "total",
            "name",
            "group",
            F.lit(None).cast("array<string>").alias("sources"),
            F.lit(None).cast("array<long>").alias("counts"),
        )
    )
    laid = (
        stripes.join(languages, "lang")
        .withColumn("a", every("blocks"))
        .withColumn("b", F.explode(F.sequence(F.col("a"), F.col("blocks") - 1)))
        .withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
        .select(
            "lang", "a", "b", "part", F.lit(2).alias("kind"), "terms", "total", F.col("term").alias("name"),
            F.lit(None).cast("long").alias("group"), "sources", "counts",
        )
    )
    cell = ["lang", "a", "b", "part"]
    stream = placed.unionByName(laid).repartition(*cell).sortWithinPartitions(*cell, "kind")
    made = cut_lineage(stream.mapInArrow(_emitted(top), MADE))
    pairs = made.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select(
        "lang",
        F.explode(
            F.array(
                F.struct(F.col("source").alias("s"), F.col("item").alias("i")),
                F.struct(F.col("item").alias("s"), F.col("source").alias("i")),
            )
        ).alias("x"),
        "value",
    ).select("lang", F.col("x.s").alias("source"), F.lit("pair").alias("part"), F.col("x.i").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = both.withColumn("rank", F.row_number().over(order))
    best = made.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best)
