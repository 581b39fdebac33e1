"""Repeated word windows across documents (operator 10), by super-k-mers.

Consecutive windows that share a minimiser (the run of ``MINIMISER_WORDS`` words
with the least hash) form one super-k-mer.  It travels as one packed string to the
bucket of its minimiser, where every occurrence of each of its windows arrives;
sorting the bucket's windows finds each window's smallest document exactly.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.llm.batches import bound_batches, field, map_rows, utf8

#: Fixed by the contract: words of a window.
WINDOW_WORDS = 13
MINIMISER_WORDS = 2
#: Text of a bucket on the average: some 300,000 windows.
BUCKET_BYTES = 2 << 20
#: Windows of a bucket above which its windows are dealt to several; about 100 bytes each.
HOT_WINDOWS = 2 << 20
#: Text gathered before its super-k-mers are packed and sent.
PACK_BYTES = 8 << 20
#: Bytes whose words are hashed at a time.
STRETCH = 1 << 19

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64 and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    both = []
    for base in (_BASE, inverse):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """Word places and hashes of UTF-8 bytes whose words single blanks or line feeds
    separate, as the packer writes them; any other byte belongs to a word.

    Hashes come from prefix sums over stretches of about ``STRETCH`` bytes, so that
    the wide arrays stay small however long the data are.
    """

    def __init__(self, data: bytes):
        marks = np.frombuffer(data, np.uint8)
        gap = (marks == 32) | (marks == 10)
        gaps = np.flatnonzero(gap)
        self.ends = gaps if len(marks) and gap[-1] else np.append(gaps, len(marks))
        self.starts = np.append(0, self.ends[:-1] + 1)
        self.hashes = np.empty(len(self.ends), np.uint64)
        first, n = 0, len(self.ends)
        while first < n:
            begin = self.starts[first]
            stop = max(first + 1, int(np.searchsorted(self.ends, begin + STRETCH, side="right")))
            part = marks[begin : self.ends[stop - 1]]
            up, down = _powers(max(STRETCH, len(part)) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            s, e = self.starts[first:stop] - begin, self.ends[first:stop] - begin
            self.hashes[first:stop] = _mixed((sums[e] - sums[s]) * down[s])
            first = stop


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(hashes) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * _MULTIPLIER + hashes[i : i + n]
    return _mixed(total)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values, in log(width) steps."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


ROW = np.dtype([("id", "<i8"), ("mark", "<i4"), ("first", "<i4"), ("windows", "<i4")])


class Packer:
    """Cuts texts into super-k-mers, one packed string for each bucket.

    Among equal super-k-mers of the texts gathered, only those of the smallest
    document go to the bucket: a later document's words are already known to be
    repeated.  So a passage that millions of documents share reaches its bucket
    once for each pack.

    ``parts`` has the number of buckets that each hot bucket is dealt to.  The hash of
    the window itself chooses among them, so equal windows still meet.
    """

    def __init__(self, buckets: int, window: int, parts: dict[int, int] | None = None):
        self.buckets, self.window = buckets, window
        self.parts, self.offsets = np.ones(buckets, np.int64), np.arange(buckets)
        at = buckets
        for bucket, n in sorted((parts or {}).items()):
            self.parts[bucket], self.offsets[bucket] = n, at
            at += n
        self.all_buckets = at
        self.compressor = zstandard.ZstdCompressor(level=6)
        self.texts: list[tuple[int, int, bytes]] = []
        self.size = 0

    def add(self, doc: int, mark: int, words: list[bytes]) -> None:
        if len(words) >= self.window:
            joined = b" ".join(words)
            self.texts.append((doc, mark, joined))
            self.size += len(joined) + 1

    def full(self) -> bool:
        return self.size >= PACK_BYTES

    def _cut(self) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """The gathered texts' super-k-mers: rows, buckets, strings, and which are sent."""
        data = b"\n".join([t[2] for t in self.texts])
        words = Words(data)
        ends_at = np.cumsum([len(t[2]) + 1 for t in self.texts]) - 1
        last = np.searchsorted(words.ends, ends_at, side="right")
        first = np.append(0, last[:-1])
        grams = _rolled(words.hashes, MINIMISER_WORDS)
        least = _sliding_least(grams, self.window - MINIMISER_WORDS + 1)
        target = (_mixed(least) % np.uint64(self.buckets)).astype(np.int64)
        hot = np.flatnonzero(self.parts[target] > 1)
        if len(hot):
            among = _rolled(words.hashes, self.window)[hot] % self.parts[target[hot]].astype(np.uint64)
            target[hot] = self.offsets[target[hot]] + among.astype(np.int64)
        # windows that lie inside one text, and where a run of one minimiser starts
        inside = np.zeros(len(words.ends) + 1, bool)
        for a, b in zip(first.tolist(), (last - self.window + 1).tolist()):
            inside[a:b] = True
        inside = inside[: len(least)]
        turns = (least[1:] != least[:-1]) | (target[1:] != target[:-1])
        begins = inside & np.append(True, turns | ~inside[:-1])
        begins[first[first < len(begins)]] = True
        at = np.flatnonzero(begins & inside)
        stops = np.flatnonzero(inside & np.append((begins | ~inside)[1:], True)) + 1
        bucket = target[at]
        owner = np.searchsorted(last, at, side="right")
        begin, end = words.starts[at].tolist(), words.ends[stops + self.window - 2].tolist()
        rows = np.zeros(len(at), ROW)
        rows["id"] = np.array([t[0] for t in self.texts], np.int64)[owner]
        rows["mark"] = np.array([t[1] for t in self.texts], np.int32)[owner]
        rows["first"], rows["windows"] = at - first[owner], stops - at
        smallest: dict[bytes, int] = {}
        strings = [data[a:b] for a, b in zip(begin, end)]
        ids = rows["id"].tolist()
        for string, doc in zip(strings, ids):
            if smallest.setdefault(string, doc) > doc:
                smallest[string] = doc
        sent = np.fromiter((smallest[s] == d for s, d in zip(strings, ids)), bool, len(ids))
        self.texts, self.size = [], 0
        return rows, bucket, strings, sent

    def counts(self) -> np.ndarray:
        """Windows of the gathered texts that go to each bucket."""
        if not self.texts:
            return np.zeros(self.all_buckets, np.int64)
        rows, bucket, _, sent = self._cut()
        n = np.bincount(bucket[sent], rows["windows"][sent], self.all_buckets)
        return n.astype(np.int64)

    def packs(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed super-k-mers), then (-1, runs known to be repeated)."""
        if not self.texts:
            return
        rows, bucket, strings, sent = self._cut()
        order = np.flatnonzero(sent)
        order = order[np.argsort(bucket[order], kind="stable")]
        edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
        for a, b in itertools.pairwise([*edges, len(order)]):
            mine = order[a:b]
            text = b"\n".join([strings[i] for i in mine.tolist()])
            columns = b"".join(np.ascontiguousarray(rows[mine][c]).tobytes() for c in ROW.names)
            head = np.array([len(mine)], "<i8").tobytes()
            yield int(bucket[mine[0]]), self.compressor.compress(head + columns + text)
        if not sent.all():
            known = rows[~sent]
            columns = b"".join(np.ascontiguousarray(known[c]).tobytes() for c in ROW.names)
            head = np.array([len(known)], "<i8").tobytes()
            yield -1, self.compressor.compress(head + columns)


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, place = int(np.frombuffer(raw, "<i8", 1)[0]), 8
    rows = np.zeros(n, ROW)
    for name in ROW.names:
        kind = ROW[name]
        rows[name] = np.frombuffer(raw, kind, n, place)
        place += n * kind.itemsize
    return rows, raw[place:]


def repeated_runs(rows: np.ndarray, data: bytes, window: int) -> np.ndarray:
    """Of a bucket's super-k-mers (one per line), the runs of windows that also
    start in a smaller document: rows of ``ROW``."""
    words = Words(data)
    hashes = _rolled(words.hashes, window)
    owner = np.repeat(np.arange(len(rows)), rows["windows"])
    firsts = np.append(0, np.cumsum(rows["windows"].astype(np.int64) + window - 1)[:-1])
    within = np.arange(len(owner)) - np.repeat(
        np.cumsum(rows["windows"].astype(np.int64)) - rows["windows"], rows["windows"]
    )
    places = firsts[owner] + within
    keys, ids = hashes[places], rows["id"][owner]
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    opens = np.append(True, keys[1:] != keys[:-1])
    group = np.cumsum(opens) - 1
    head = np.flatnonzero(opens)
    later = np.flatnonzero(ids > ids[head[group]])
    if not len(later):
        return rows[:0]
    begin, end = words.starts, words.ends
    at, to = places[order[later]], places[order[head[group[later]]]]
    a1, a2 = begin[at].tolist(), end[at + window - 1].tolist()
    b1, b2 = begin[to].tolist(), end[to + window - 1].tolist()
    same = np.fromiter(
        (data[p:q] == data[r:s] for p, q, r, s in zip(a1, a2, b1, b2)), bool, len(later)
    )
    hit = np.zeros(len(owner), bool)
    hit[order[later[same]]] = True
    for i in np.unique(group[later[~same]]).tolist():  # equal hashes of unlike windows
        stop = head[i + 1] if i + 1 < len(head) else len(order)
        seen: dict[bytes, int] = {}
        for k in range(head[i], stop):
            place = places[order[k]]
            string = data[begin[place] : end[place + window - 1]]
            hit[order[k]] = seen.setdefault(string, int(ids[k])) < ids[k]
    # consecutive windows of one super-k-mer become one run
    at = np.flatnonzero(hit)
    opens = np.append(True, (np.diff(at) > 1) | (np.diff(owner[at]) > 0))
    first = at[opens]
    found = rows[owner[first]].copy()
    found["first"] += within[first].astype(np.int32)
    found["windows"] = np.diff(np.append(np.flatnonzero(opens), len(at)))
    return found


def _runs_frame(rows: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({c: rows[c] for c in ROW.names})


def hot_buckets(source: DataFrame, buckets: int, window: int, limit: int) -> dict[int, int]:
    """Buckets of more than ``limit`` windows, and to how many each is dealt; from
    (id, mark, text) rows.

    A task tells only buckets with more than ``least`` of its windows, and adds
    ``least`` to the slack (bucket -1) that any bucket may have besides what is told.
    """
    least = limit // 4096

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, total = Packer(buckets, window), np.zeros(buckets, np.int64)
        for part in parts:
            ids, marks = part.column(0).to_pylist(), part.column(1).to_pylist()
            for doc, mark, raw in zip(ids, marks, utf8(part.column(2))):
                packer.add(doc, mark, raw.split())
                if packer.full():
                    total += packer.counts()
        total += packer.counts()
        seen = np.flatnonzero(total > least)
        told, n = np.append(seen, -1), np.append(total[seen], least)
        yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(n)], names=["bucket", "n"])

    counted = source.mapInArrow(measure, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r["bucket"]: r["n"] for r in counted.collect()}
    slack = found.pop(-1, 0)
    # parts of half the limit: a hash deals unlike windows evenly, so none comes near it
    return {k: -(-2 * (n + slack) // limit) for k, n in found.items() if n + slack > limit}


def repeated_windows(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW_WORDS
) -> DataFrame:
    """Runs of windows that also start in a document with a smaller id: ``id``,
    ``mark`` (a hash of the text, for ids that repeat), ``first`` word, ``windows``.

    The number of buckets follows the length of all texts, whatever the number of tasks.
    A first pass counts the windows of each bucket; those of buckets above
    ``HOT_WINDOWS`` are dealt to several by their own hash.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    length = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = 1 + length // BUCKET_BYTES
    source = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long"), F.hash(text), F.col(text).cast("string")
    )
    hot = hot_buckets(source, buckets, window, HOT_WINDOWS)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sent = Packer(buckets, window, hot), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sent
            for bucket, blob in packer.packs():
                sent += 1
                # runs already known may be unpacked anywhere
                target = bucket if bucket >= 0 else -1 - sent % buckets
                yield pa.RecordBatch.from_arrays(
                    [pa.array([target], pa.int64()), pa.array([blob], pa.binary())],
                    names=["bucket", "pack"],
                )

        for part in parts:
            ids, marks = part.column(0).to_pylist(), part.column(1).to_pylist()
            for doc, mark, raw in zip(ids, marks, utf8(part.column(2))):
                packer.add(doc, mark, raw.split())
                if packer.full():
                    yield from flush()
        yield from flush()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        unpacked = [_unpack(p) for p in group["pack"]]
        rows = np.concatenate([r for r, _ in unpacked])
        if group["bucket"].iloc[0] < 0:
            return _runs_frame(rows)
        return _runs_frame(repeated_runs(rows, b"\n".join([d for _, d in unpacked]), window))

    packed = source.mapInArrow(pack, "bucket long, pack binary")
    return packed.groupBy("bucket").applyInPandas(
        count, "id long, mark int, first int, windows int"
    )


def remove_repeated(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: Sequence[str] = (),
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """``doc_id``, ``keep``, ``n_words``, ``n_removed`` and ``kept_text``: the words, joined
    by one blank, that no window covers which also starts in a smaller doc_id.

    Words are what ASCII white space separates.  Texts move once, to meet their
    runs; super-k-mers move once, compressed by bucket.

    Null, empty and short texts have no window and keep all their words.  A row whose
    doc_id is null loses nothing and takes nothing from others.  Rows that repeat a
    doc_id don't count as smaller than each other.
    """
    runs = repeated_windows(docs, text, doc_id, window)
    by_doc = runs.groupBy(F.col("id").alias("__of"), F.col("mark").alias("__of_mark")).agg(
        F.sort_array(F.collect_set(F.struct("first", "windows"))).alias("__runs")
    )
    kept = [c for c in keep if c.lower() != doc_id.lower()]
    source = docs.select(
        doc_id, *kept, F.col(text).cast("string").alias("__text"), F.hash(text).alias("__mark")
    )
    matched = source.join(
        by_doc, (F.col(doc_id) == F.col("__of")) & (F.col("__mark") == F.col("__of_mark")), "left"
    )
    fields = [
        field("n_words", T.LongType()),
        field("n_removed", T.LongType()),
        field("kept_text", T.StringType()),
    ]

    def make():
        def work(texts: pa.Array, firsts: pa.Array, windows: pa.Array) -> list[pa.Array]:
            counts, removed, left = [], [], []
            for raw, at, n in zip(utf8(texts), firsts.to_pylist(), windows.to_pylist()):
                words, stay, reached = raw.split(), [], 0
                for first, many in zip(at or (), n or ()):
                    stay += words[reached:first]
                    reached = max(reached, first + many + window - 1)
                stay += words[reached:]
                counts.append(len(words))
                removed.append(len(words) - len(stay))
                left.append(b" ".join(stay))
            return [
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(left, pa.binary()).cast(pa.string()),
            ]

        return work

    inputs = [F.col("__text"), F.col("__runs.first"), F.col("__runs.windows")]
    return map_rows(matched, inputs, fields, make, [doc_id, *kept])
