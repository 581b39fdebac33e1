"""Byte-level BPE (operator 1): encode whole texts to ids and decode them back.

Pre-tokenisation is a finite-state scan over code points.  Every code point has a
class (letter, number, white space ...); a class is a function from state to
state; composing functions is associative, so the states of a whole batch come
from a blocked prefix scan over table look-ups, without a regular expression.
The slices between boundaries feed a cache of merged pieces.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.llm.batches import field, map_rows

# Classes: what a code point is, given the one or two that follow it.
OTHER, LETTER, NUMBER, BLANK_RUN, BLANK_PREFIX, BLANK_LAST, QUOTE_1, QUOTE_2, END = range(9)
# States: the token the scan is in after a code point.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_PREFIX, S_BLANK, S_ONE_LEFT, S_TWO_LEFT = range(8)

# The contractions that form a token of their own after an apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
# Separators that are white space to Python but not to the pattern.
NOT_BLANK = (0x1C, 0x1D, 0x1E, 0x1F)

BLOCK = 512
CHUNK_POINTS = 1 << 20
CACHED_PIECES = 500_000
CACHED_BYTES = 64
QUADRATIC_BYTES = 48


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this code point."""
    if kind == LETTER and state in (S_ONE_LEFT, S_TWO_LEFT):
        return (S_START if state == S_ONE_LEFT else S_ONE_LEFT), False
    joined = {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER}
    if kind in joined:
        return joined[kind], state not in (joined[kind], S_PREFIX)
    if kind in (QUOTE_1, QUOTE_2):
        if state in (S_OTHER, S_PREFIX):
            return S_OTHER, False
        return (S_ONE_LEFT if kind == QUOTE_1 else S_TWO_LEFT), True
    if kind == BLANK_RUN:
        return S_BLANK, state != S_BLANK
    return (S_PREFIX if kind == BLANK_PREFIX else S_START), True


@functools.cache
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The closure of the classes' functions under composition.

    Returns the function of each class, the composition table (flat), each
    function's values by state, and whether (class, state) starts a token.
    """
    states, kinds = range(8), range(9)
    functions = {tuple(states): 0}
    of_kind = [tuple(_step(s, k)[0] for s in states) for k in kinds]
    queue = [tuple(states)]
    while queue:
        f = queue.pop()
        for g in of_kind:
            h = tuple(g[x] for x in f)
            if h not in functions:
                functions[h] = len(functions)
                queue.append(h)
    known = list(functions)
    table = np.array([[functions[tuple(g[x] for x in f)] for g in known] for f in known], np.uint16)
    starts = np.array([[_step(s, k)[1] for s in states] for k in kinds], bool)
    ids = np.array([functions[f] for f in of_kind], np.uint16)
    return ids, table, np.array(known, np.uint8), starts


@functools.cache
def _point_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        mark = chr(point)
        category = unicodedata.category(mark)[0]
        if category == "L":
            table[point] = LETTER
        elif category == "N":
            table[point] = NUMBER
        elif mark.isspace() and point not in NOT_BLANK:
            table[point] = BLANK_RUN
    return table


def _classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of each code point; ``ends`` are the positions after each text."""
    kinds = _point_classes()[points]
    kinds[ends] = BLANK_RUN
    blank = kinds == BLANK_RUN
    alone = blank & ~np.append(blank[1:], True)
    kinds[alone] = np.where(points[alone] == ord(" "), BLANK_PREFIX, BLANK_LAST)
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        following = np.append(points, [0, 0])
        following[ends] = 0
        one, two = following[quotes + 1], following[quotes + 2]
        kinds[quotes[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = QUOTE_1
        for a, b in LONG_ENDINGS:
            kinds[quotes[(one == ord(a)) & (two == ord(b))]] = QUOTE_2
    kinds[ends] = END
    return kinds


def _scan(functions: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of a sequence of functions."""
    n, size = len(functions), len(table)
    if n <= BLOCK:
        composed, shift = functions.astype(np.int64), 1
        while shift < n:
            composed[shift:] = table[composed[:-shift], composed[shift:]]
            shift *= 2
        return composed
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.int64)
    padded[:n] = functions
    # column j of a block becomes row j, so that each step works on whole rows
    blocks = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    flat = table.ravel()
    for j in range(1, BLOCK):
        blocks[j] = flat[blocks[j - 1] * size + blocks[j]]
    before = np.zeros(rows, np.int64)
    before[1:] = _scan(blocks[-1], table)[:-1]
    return flat[before * size + blocks].T.ravel()[:n]


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where a token starts; each text's end counts as one."""
    of_kind, table, values, starts = _machine()
    kinds = _classes(points, ends)
    states = np.zeros(len(points), np.uint8)
    states[1:] = values[_scan(of_kind[kinds], table)[:-1], S_START]
    return np.flatnonzero(starts[kinds, states])


def split_texts(texts: Sequence[str]) -> list[list[str]]:
    """The pre-tokens of each text."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    cuts = boundaries(points, ends)
    last = np.searchsorted(cuts, ends).tolist()
    cuts = cuts.tolist()
    pieces, first = [], 0
    for stop in last:
        mine = cuts[first : stop + 1]
        pieces.append([joined[a:b] for a, b in itertools.pairwise(mine)])
        first = stop + 1
    return pieces


def stretches(text: str, size: int = CHUNK_POINTS) -> list[str]:
    """A long text in parts of about ``size``, cut where a token starts whatever stands
    around: before a blank that a non-blank follows."""
    parts, first = [], 0
    while len(text) - first > size:
        cut = text.rfind(" ", first + 1, first + size)
        while cut > first and text[cut + 1].isspace():
            cut = text.rfind(" ", first + 1, cut)
        if cut <= first:
            cut = text.find(" ", first + size)
            while 0 <= cut < len(text) - 1 and text[cut + 1].isspace():
                cut = text.find(" ", cut + 1)
            if cut < 0 or cut == len(text) - 1:
                break
        parts.append(text[first:cut])
        first = cut
    return [*parts, text[first:]]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _merge_short(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    none = len(ranks) + 1
    pairs = [ranks.get(a + b, none) for a, b in itertools.pairwise(parts)]
    while pairs and (best := min(pairs)) < none:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long piece, by a heap over a linked list."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            stop = end[end[i]]
            if (rank := ranks.get(piece[i:stop])) is not None:
                heapq.heappush(heap, (rank, i, stop))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if end[i] < 0 or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        end[i], end[gone] = stop, -1
        if stop < n:
            before[stop] = i
        offer(before[i])
        offer(i)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class PieceCache(dict):
    """Packed ids of pieces; a miss is merged, and short pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        if raw in self.ranks:
            ids = [self.ranks[raw]]
        elif len(raw) <= QUADRATIC_BYTES:
            ids = _merge_short([raw[i : i + 1] for i in range(len(raw))], self.ranks)
        else:
            ids = _merge_long(raw, self.ranks)
        packed = np.array(ids, "<u4").tobytes()
        if len(raw) <= CACHED_BYTES:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.cache = PieceCache(ranks)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.uint32)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        packed: list[list[bytes]] = [[] for _ in texts]
        chunk: list[str] = []
        owners: list[int] = []
        points = 0
        for owner, text in [*enumerate(texts), (-1, "")]:
            for part in stretches(text):
                if chunk and (owner < 0 or points + len(part) > CHUNK_POINTS):
                    for i, pieces in zip(owners, split_texts(chunk)):
                        packed[i].append(b"".join(map(self.cache.__getitem__, pieces)))
                    chunk, owners, points = [], [], 0
                chunk.append(part)
                owners.append(owner)
                points += len(part)
        return [b"".join(parts) for parts in packed]

    def starts(self, packed: bytes) -> bytes:
        """Byte offset in the text at which each token starts, packed like the ids."""
        lengths = self.lengths[np.frombuffer(packed, "<u4")]
        return (np.cumsum(lengths, dtype="<u4") - lengths).astype("<u4").tobytes()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


class _Ranks:
    """A broadcast rank table; each worker process builds its codec once."""

    def __init__(self, docs: DataFrame, path: str):
        ranks = read_ranks(path)
        self.name = f"{path} {hash(frozenset(ranks.items()))}"
        self.shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def codec(self) -> Codec:
        if self.name not in _codecs:
            _codecs.clear()
            _codecs[self.name] = Codec(self.shared.value)
        return _codecs[self.name]


def encode(
    docs: DataFrame,
    ranks_path: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    offsets: bool = True,
    decoded: bool = False,
) -> DataFrame:
    """``keep`` with ``ids``: the tokens of every whole text, packed as
    little-endian unsigned 32-bit integers (4 bytes a token).

    ``offsets`` adds ``starts``, each token's byte offset in the UTF-8 text, packed
    alike; ``decoded`` adds ``decoded``, the bytes that the ids stand for.  The rank
    file is read on the driver and broadcast: its size is that of the vocabulary,
    whatever the documents.  No shuffle; one row out per row in.

    Null and empty texts have no tokens.  A piece without a break of any length
    merges in n log n time.  Repeated rows are encoded alike.  A column of ``keep``
    named as an output column gives way to it.
    """
    ranks = _Ranks(docs, ranks_path)
    fields = [field("ids", T.BinaryType())]
    fields += [field("starts", T.BinaryType())] * offsets
    fields += [field("decoded", T.BinaryType())] * decoded

    def make():
        codec = ranks.codec()

        def work(column: pa.Array) -> list[pa.Array]:
            packed = codec.encode([t or "" for t in column.to_pylist()])
            made = [pa.array(packed, pa.binary())]
            if offsets:
                made.append(pa.array(map(codec.starts, packed), pa.binary()))
            if decoded:
                made.append(pa.array(map(codec.decode, packed), pa.binary()))
            return made

        return work

    return map_rows(docs, [F.col(text).cast("string")], fields, make, keep)


def decode(
    encoded: DataFrame,
    ranks_path: str,
    ids: str = "ids",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``keep`` with ``decoded``: the bytes of packed ids; null ids give no bytes."""
    ranks = _Ranks(encoded, ranks_path)

    def make():
        codec = ranks.codec()
        return lambda column: [
            pa.array([codec.decode(v or b"") for v in column.to_pylist()], pa.binary())
        ]

    return map_rows(encoded, [F.col(ids)], [field("decoded", T.BinaryType())], make, keep)
