"""BPE by a tokenization automaton (operator 11): encode whole texts, decode the ids.

The automaton reads token ids and accepts exactly the sequences that the merges
produce.  It starts as one state with an arc for every base symbol and grows by one
gadget for each merge (u, v), in order: the state that u leads to is copied without its
v arc, u now leads to the copy, and wherever u could be read, the new token uv can be
read instead, leading where v leads.  So every text has one path, and so has each of
its prefixes: the last token of a prefix is the one token that ends there and whose arc
leaves the state of the prefix before it.  Encoding a word follows the arcs of a
symbol automaton (which tokens end here) and looks each arc up in the state's row,
in time linear in the word; no pair is merged and no rank compared while encoding.

A state is its parent state and one removed arc, which costs constant space a merge.
Arcs are numbered so that "v and every later token that begins with v" is one
interval; a state's row is the sorted bounds of its removed intervals.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from bisect import bisect_left, bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, normalizers

from tallyfern.llm.batches import field, map_rows, utf8

CACHED_WORDS = 400_000
CACHED_BYTES = 48
# The tokenizer file's word pattern; its letters, numbers and rest left open.
WORD = "'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|{other}+"
EVERY = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
#: Code points below it have no combining class and compose with nothing.
COMBINING = "\u0300"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Automaton:
    """The compiled automaton of a vocabulary with word ends.

    ``labels`` has each id's arc label; ``n_states`` counts the states built.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], ending: str):
        symbols = byte_symbols()
        size = max(vocabulary.values(), default=-1) + 1
        self.labels: list[bytes] = [b""] * size
        for text, i in vocabulary.items():
            self.labels[i] = text.encode()
        # Symbols 0 to 255 are bytes, 256 to 511 bytes that end a word.
        base = [vocabulary[s] for s in symbols] + [vocabulary[s + ending] for s in symbols]
        spelt: dict[int, tuple[int, ...]] = {t: (i,) for i, t in enumerate(base)}
        born = dict.fromkeys(base, -1)
        starts: dict[int, list[int]] = {}  # tokens by the token they begin with, in order
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        parents, removed = [-1], [-1]  # of each state: where it was copied from, the arc it lost
        leads = dict.fromkeys(base, 0)
        rules: dict[tuple[int, int], int] = {}
        for step, (left, right) in enumerate(merges):
            u, v = vocabulary[left], vocabulary[right]
            joined = left[: -len(ending)] if left.endswith(ending) else left
            made = vocabulary[joined + right]
            if u not in leads or v not in leads or not _readable(u, v, first, last, born, rules):
                continue  # no path reads u and then v, so the token never arises
            if made in leads:
                raise ValueError(f"two merges make {joined + right!r}")
            spelt[made] = spelt[u] + spelt[v]
            born[made], first[made], last[made] = step, u, v
            starts.setdefault(u, []).append(made)
            leads[made] = leads[v]
            parents.append(leads[u])
            removed.append(step)
            leads[u] = len(parents) - 1
            rules[u, v] = step
        self.n_states = len(parents)
        place, until = _numbered(base, starts, born)
        lost = {step: (place[v], until(v, step)) for (_, v), step in rules.items()}
        rows: dict[int, list[int]] = {}
        for state in set(leads.values()):
            spans, at = [], state
            while at:
                spans.append(lost[removed[at]])
                at = parents[at]
            rows[state] = _bounds(spans)
        self.row = {t: rows[s] for t, s in leads.items()}
        self.place = place
        self._compile_symbols(spelt)

    def _compile_symbols(self, spelt: dict[int, tuple[int, ...]]) -> None:
        """The automaton over symbols: after each symbol, the tokens that end there."""
        arcs: list[dict[int, int]] = [{}]
        own: list[int] = [-1]
        for token, word in spelt.items():
            node = 0
            for symbol in word:
                following = arcs[node].get(symbol)
                if following is None:
                    following = arcs[node][symbol] = len(arcs)
                    arcs.append({})
                    own.append(-1)
                node = following
            own[node] = token
        depth, back = [0] * len(arcs), [0] * len(arcs)
        ends: list[tuple] = [()] * len(arcs)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for symbol, child in arcs[node].items():
                depth[child] = depth[node] + 1
                at = back[node]
                while node and at and symbol not in arcs[at]:
                    at = back[at]
                back[child] = arcs[at].get(symbol, 0) if node else 0
                token = own[child]
                here = ((token, depth[child], self.place[token], self.row[token]),) if token >= 0 else ()
                ends[child] = here + ends[back[child]]
                queue.append(child)
        self.arcs, self.back, self.ends = arcs, back, ends

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word: its only path, found prefix by prefix."""
        arcs, back, ends = self.arcs, self.back, self.ends
        n, node = len(word), 0
        token_at, from_at, row_at = [0] * (n + 1), [0] * (n + 1), [()] * (n + 1)
        for i, symbol in enumerate(word, 1):
            if i == n:
                symbol += 256
            following = arcs[node].get(symbol)
            while following is None:
                node = back[node]
                following = arcs[node].get(symbol)
            node = following
            for token, length, place, row in ends[node]:
                j = i - length
                if not bisect_right(row_at[j], place) & 1:
                    token_at[i], from_at[i], row_at[i] = token, j, row
                    break
            else:
                raise ValueError(f"no path reads {word!r}")
        path = []
        while n:
            path.append(token_at[n])
            n = from_at[n]
        path.reverse()
        return path


def _readable(u: int, v: int, first: dict, last: dict, born: dict, rules: dict) -> bool:
    """Whether v can be read after u: no removed arc on u's right ends meets v's beginnings."""
    x, x_until = u, len(rules) + len(born)
    while x is not None:
        y, y_until = v, len(rules) + len(born)
        while y is not None:
            step = rules.get((x, y))
            if step is not None and step < x_until and step <= y_until:
                return False
            y_until, y = born[y], first.get(y)
        x_until, x = born[x], last.get(x)
    return True


def _numbered(base: list[int], starts: dict, born: dict):
    """Places of all tokens such that a token and the later of the tokens that begin
    with it follow each other, latest first; and where those made from a step on end."""
    place: dict[int, int] = {}
    size: dict[int, int] = {}
    stack = [(t, False) for t in reversed(base)]
    while stack:
        token, done = stack.pop()
        if done:
            size[token] = len(place) - place[token]
            continue
        place[token] = len(place)
        stack.append((token, True))
        stack.extend((t, False) for t in starts.get(token, ()))  # the last pushed comes first

    births = {t: [born[x] for x in own] for t, own in starts.items()}

    def until(token: int, step: int) -> int:
        later = bisect_left(births.get(token, ()), step)
        if later == len(births.get(token, ())):
            return place[token] + 1
        oldest = starts[token][later]
        return place[oldest] + size[oldest]

    return place, until


def _bounds(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted bounds of the union: a place is inside after an odd number of them."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _classes() -> dict[str, set[str]]:
    """The tokenizer library's own letters, numbers and blanks."""
    mark = "\x00"
    made = {}
    for name, pattern in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        hit = normalizers.Replace(Regex(pattern), mark).normalize_str(EVERY[1:])
        made[name] = {c for c, x in zip(EVERY[1:], hit) if x == mark}
    return made


def _ranges(points: set[str]) -> str:
    """The body of a character class of these code points."""
    out = []
    for _, run in itertools.groupby(enumerate(sorted(map(ord, points))), lambda x: x[1] - x[0]):
        own = [c for _, c in run]
        out.append(rf"\U{own[0]:08x}-\U{own[-1]:08x}")
    return "".join(out)


class WordTokenizer:
    """Texts to ids and back, as the tokenizer file says, by its automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        self.automaton = Automaton(
            model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"]
        )
        self.labels = list(self.automaton.labels)
        self.added = {a["content"]: a["id"] for a in stored["added_tokens"]}
        for text, i in self.added.items():
            self.labels += [b""] * (i + 1 - len(self.labels))
            self.labels[i] = text.encode()
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        own = _classes()
        body = {k: _ranges(v) for k, v in own.items()}
        self.exact = re.compile(
            WORD.format(letter=f"[{body['L']}]", number=f"[{body['N']}]", other="[^{S}{L}{N}]".format(**body))
        )
        self.ascii = re.compile(WORD.format(letter="[a-z]", number="[0-9]", other=r"[^\t-\r a-z0-9]"))
        # Python's own classes are faster; texts with a code point that they class
        # differently take the exact pattern.
        self.usual = re.compile(WORD.format(letter=r"[^\W\d_]", number=r"\d", other=r"(?:[^\w\s]|_)"))
        letters = {c for c in EVERY if c.isalnum() and not c.isdecimal()}
        self.odd = own["L"] ^ letters
        self.odd |= own["N"] ^ {c for c in EVERY if c.isdecimal()}
        self.odd |= own["S"] ^ {c for c in EVERY if c.isspace()}
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        low = text.lower()
        if low.isascii():
            return self.ascii.findall(low)
        points = set(low)
        if max(points) >= COMBINING:
            low = self.normal(text)
            points = set(low)
        return (self.usual if self.odd.isdisjoint(points) else self.exact).findall(low)

    def _ids(self, word: str) -> bytes:
        ids = np.array(self.automaton.encode_word(word.encode()), "<u4").tobytes()
        if len(word) <= CACHED_BYTES:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, at, known = [], 0, self.known
        for mark in itertools.chain(self.marks.finditer(text) if "<|" in text else (), [None]):
            piece = text[at : mark.start() if mark else len(text)]
            if piece:
                out += [known.get(w) or self._ids(w) for w in self.words(piece)]
            if mark:
                out.append(np.uint32(self.added[mark[0]]).astype("<u4").tobytes())
                at = mark.end()
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The labels of the arcs that the ids name, with a blank between two."""
        labels = self.labels
        return b" ".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """One compiled tokenizer for each Python process and file."""
    return WordTokenizer(path)


FIELDS = (field("ids", T.BinaryType()), field("decoded", T.BinaryType()))


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the packed ``ids`` of each text and the text ``decoded`` from them.

    A null text is an empty one; an empty or blank text has no ids and decodes to
    nothing.  Very long texts and words take time in proportion; equal rows give equal
    rows, an empty table an empty one, and a kept column named like an output gives way.
    ``path`` names a tokenizer file that every executor has.
    """

    def make():
        own = tokenizer(path)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids = [own.encode(v.decode()) for v in utf8(texts)]
            return [pa.array(ids, pa.binary()), pa.array([own.decode(i) for i in ids], pa.binary())]

        return work

    return map_rows(docs, [F.col(text)], FIELDS, make, keep)
