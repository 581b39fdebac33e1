"""Quality rules from lines that many documents of a host share (operator 8).

Normalised lines are hashed; for each host and line the distinct documents are
counted over the whole table; exact copies count once.  Lines above the limits are removed, and documents
that lose most of their words with them are rejected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.llm.batches import field, map_rows, utf8
from tallyfern.sources.tables import cut_lineage

#: Fixed by the contract: least words, most percent of words in repeated windows, symbols.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate of a host above both: documents with it, share of the host's.
LINE_DOCUMENTS = 10
LINE_SHARE = 0.01
#: A document is depleted when fewer of its words than this share are left.
LEFT_SHARE = 0.3
SALTS = 16

_BLANKS = b"\t\n\x0b\x0c\r "


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n + 2)
    if len(seen) < 1 << 21:
        codes = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    else:
        pairs = np.unique(numbers[:-1] * len(seen) + numbers[1:], return_inverse=True)[1]
        codes = pairs[:-1] * len(seen) + numbers[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for i in range(3):
        covered[i : n + i] |= repeated
    return int(covered.sum())


def _mark(parts: list[bytes]) -> int:
    digest = hashlib.md5(b" ".join(parts).lower(), usedforsecurity=False).digest()
    return int.from_bytes(digest[:8]) >> 4


def without_lines(raw: bytes, gone: Sequence[int]) -> bytes:
    """The text without the lines of these hashes; all other lines stay as they are."""
    marks = set(gone)
    lines = raw.split(b"\n")
    return b"\n".join(
        line for line in lines if not (parts := line.split()) or _mark(parts) not in marks
    )


def _lines(raw: bytes) -> tuple[int, dict[int, int]]:
    """Lines equal to an earlier one, and words by hash (the first 60 bits of the md5) of
    each normalised line: its words, A-Z lowered, one blank between."""
    duplicates, seen, words = 0, set(), {}
    for line in raw.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        duplicates += line in seen
        seen.add(line)
        mark = _mark(parts)
        words[mark] = words.get(mark, 0) + len(parts)
    return duplicates, words


STATISTICS = (
    field("n_words", T.LongType()),
    field("word_chars", T.LongType()),
    field("n_symbols", T.LongType()),
    field("n_dup_lines", T.LongType()),
    field("n_repeat_words", T.LongType()),
    field("__lines", T.ArrayType(T.LongType())),
    field("__line_words", T.ArrayType(T.LongType())),
    field("__digest", T.LongType()),
)


def line_statistics(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` with the text statistics, and each distinct line's hash and words.

    ``__digest`` is the first 63 bits of the whole text's md5.  Only exact copies share
    it, so that a text posted many times counts as one document and its own lines
    don't become boilerplate.
    """

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            rows = []
            for raw in utf8(column):
                words = raw.split()
                chars = len(raw) - sum(map(raw.count, (b"%c" % c for c in _BLANKS)))
                marks = np.frombuffer(raw, np.uint8)
                chars -= int(((marks & 0xC0) == 0x80).sum())
                symbols = sum(map(raw.count, (c.encode() for c in SYMBOLS)))
                duplicates, lines = _lines(raw)
                whole = hashlib.md5(raw, usedforsecurity=False).digest()
                rows.append(
                    (len(words), chars, symbols, duplicates, repeat_words(words),
                     list(lines), list(lines.values()), int.from_bytes(whole[:8]) >> 1)
                )
            columns = list(zip(*rows)) or [[]] * len(STATISTICS)
            longs, lists = pa.int64(), pa.list_(pa.int64())
            kinds = [longs] * 5 + [lists, lists, longs]
            return [pa.array(c, k) for c, k in zip(columns, kinds)]

        return work

    return map_rows(docs, [F.col(text).cast("string")], STATISTICS, make, keep)


def frequent_lines(
    statistics: DataFrame, host: str, min_documents: int, min_share: float
) -> DataFrame:
    """``host`` and ``line`` of the lines above the limits."""
    lines = statistics.select(host, "__digest", F.explode("__lines").alias("line"))
    counted = (
        lines.groupBy(host, "line")
        .agg(F.countDistinct("__digest").alias("documents"))
        .where(F.col("documents") > min_documents)
    )
    hosts = statistics.groupBy(host).agg(F.countDistinct("__digest").alias("all_documents"))
    return (
        counted.join(hosts, host)
        .where(F.col("documents") > min_share * F.col("all_documents"))
        .select(host, "line")
    )


def judge_quality(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    keep: Sequence[str] = ("doc_id",),
    line_documents: int = LINE_DOCUMENTS,
    line_share: float = LINE_SHARE,
    left_share: float = LEFT_SHARE,
    lines_column: str | None = None,
) -> DataFrame:
    """``keep`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``n_boilerplate_words``, ``base_failed``, ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated
    three-word windows.  ``kept``: not failed, and at least ``left_share`` of the
    words remain without the lines that more than ``line_documents`` and more than
    ``line_share`` of the host's distinct documents have.

    Lines are counted by host and hash after a map-side count, over all documents.
    Lines meet the frequent ones by a salted join, so a line that a third of all
    documents has is spread over tasks; only hashes and counts move, never texts.

    ``lines_column`` names a further column, the hashes of the document's own lines
    above the limits; ``remove_lines`` takes them out of the texts.

    Null and empty texts have no words and fail.  Documents of a null host form the
    host "".  Rows that repeat a document are judged alike.  A column of ``keep``
    named as an output column gives way to it.
    """
    named = docs.withColumn("__host", F.coalesce(F.col(host).cast("string"), F.lit("")))
    made = {"n_boilerplate_words", "base_failed", "kept", *(f.name.lower() for f in STATISTICS)}
    kept = [c for c in keep if c.lower() not in made]
    statistics = cut_lineage(
        line_statistics(named, text, [*kept, "__host"]).withColumn(
            "__row", F.monotonically_increasing_id()
        )
    )
    frequent = cut_lineage(frequent_lines(statistics, "__host", line_documents, line_share))
    salt = F.expr(f"explode(sequence(0, {SALTS - 1}))")
    lines = statistics.select(
        "__host",
        "__row",
        F.pmod("__row", F.lit(SALTS)).cast("int").alias("salt"),
        F.explode(F.arrays_zip("__lines", "__line_words")).alias("entry"),
    ).select(
        "__host",
        "__row",
        "salt",
        F.col("entry.__lines").alias("line"),
        F.col("entry.__line_words").alias("words"),
    )
    removed = (
        lines.join(frequent.withColumn("salt", salt), ["__host", "line", "salt"])
        .groupBy("__row")
        .agg(
            F.sum("words").alias("n_boilerplate_words"),
            *([F.collect_list("line").alias(lines_column)] if lines_column else []),
        )
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    left = F.col("n_words") - F.col("n_boilerplate_words")
    return (
        statistics.drop("__lines", "__line_words", "__digest", "__host")
        .join(removed, "__row", "left")
        .withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= left_share * F.col("n_words")))
        .drop("__row")
    )


def remove_lines(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
    keep: Sequence[str] = ("doc_id",),
    line_documents: int = LINE_DOCUMENTS,
    line_share: float = LINE_SHARE,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """``keep`` and ``text`` of the documents that ``judge_quality`` keeps, the texts
    without their host's lines above the limits.

    Texts move once, to meet the hashes of their own lines; documents that lose
    nothing have no row on the other side.  Rows equal in id, text and host share
    their verdict.  ``text`` in ``keep`` gives way to the new one.
    """
    row = {
        "__id": F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
        "__no_id": F.col(doc_id).isNull(),
        "__text_mark": F.xxhash64(text, host),
    }
    limits = (line_documents, line_share, left_share)
    verdict = judge_quality(docs.withColumns(row), text, host, list(row), *limits, "__gone")
    changed = (
        verdict.where(~F.col("kept") | F.col("__gone").isNotNull())
        .select(*row, "kept", "__gone")
        .dropDuplicates(list(row))
        .withColumnRenamed("kept", "__kept")
    )
    left = (
        docs.withColumns(row)
        .join(changed, list(row), "left")
        .where(F.coalesce("__kept", F.lit(True)))
    )

    def make():
        def work(texts: pa.Array, gone: pa.Array) -> list[pa.Array]:
            made = [
                without_lines(raw, marks) if marks else raw
                for raw, marks in zip(utf8(texts), gone.to_pylist())
            ]
            return [pa.array(made, pa.binary()).cast(pa.string())]

        return work

    inputs = [F.col(text).cast("string"), F.col("__gone")]
    return map_rows(left, inputs, [field(text, T.StringType())], make, keep)
