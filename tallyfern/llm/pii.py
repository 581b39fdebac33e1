"""Personal data (operator 7): base patterns, and spans that weak labelers agree on.

The base patterns find e-mail addresses, IP addresses, card and phone numbers.
Beside them wider patterns propose candidates; regular-expression, gazetteer and
context labelers vote on each.  The votes of all documents are counted by pattern,
expectation-maximisation estimates each labeler's reliability from the counts, and
a logistic span classifier learns the resulting probabilities from votes and shape.
Candidates that it accepts are added to the base spans, which always stay.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.llm.batches import bound_batches, field, map_rows

KINDS = ("email", "ip", "card", "phone")

# Fixed by the contract: the base patterns; possessive where that changes no match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

# Wider patterns for candidates.
_SPELT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?[A-Za-z0-9-]{1,63}+"
    r"(?: ?[\[({<]? ?(?:dot|DOT|\.) ?[\])}>]? ?[A-Za-z0-9-]{2,63}+)+"
)
_NUMBER = re.compile(r"(?<![0-9A-Za-z.])\(?[0-9](?:[ ().-]{0,2}[0-9]){8,18}(?![0-9A-Za-z])")

# Gazetteers of the labelers, in the corpus's four languages.
DOMAIN_ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu")
PHONE_CUES = (
    "phone", "tel", "telephone", "mobile", "cell", "call", "fax", "whatsapp", "sms",
    "telefon", "handy", "anruf", "téléphone", "portable", "appel", "teléfono", "móvil", "llamar",
)
CARD_CUES = (
    "card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte",
    "carte", "bancaire", "tarjeta", "crédito",
)
EMAIL_CUES = ("mail", "email", "e-mail", "contact", "write", "kontakt", "courriel", "correo", "contacto")
NEGATIVE_CUES = ("version", "isbn", "issn", "id", "order", "license", "copyright", "serial", "page", "invoice")
CONTEXT = 40
VOTES = ("format", "checksum", "gazetteer", "cue", "no_cue", "company")
ACCEPT = 0.9
ROUNDS = 50

_CUE_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for match in _DOMAIN.finditer(text):
        start = at = match.start()
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at:
            done = match.end()
            yield start, done


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if PHONE_DIGITS[0] <= len(_digits(m[0])) <= PHONE_DIGITS[1]:
                found.append(("phone", *m.span()))
    return found


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...] = ()
    shape: tuple[int, ...] = ()

    @property
    def pattern(self) -> str:
        """Votes and shape, the unit that documents are counted by."""
        return f"{self.kind}|{','.join(map(str, self.votes))}|{','.join(map(str, self.shape))}"


def _kind_of(s: str, digits: str) -> str:
    return "card" if len(digits) >= 13 else "phone"


def candidates(text: str) -> list[Candidate]:
    """Base spans and proposals, with votes: 1 for, -1 against, 0 abstaining."""
    base = base_spans(text)
    found = [Candidate(k, a, b, True) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    proposals = []
    if "[" in text or "(" in text or "{" in text or "<" in text:
        proposals += [("email", *m.span()) for m in _SPELT.finditer(text)]
    for m in _NUMBER.finditer(text):
        proposals.append(("card" if len(_digits(m[0])) >= CARD_DIGITS[0] else "phone", *m.span()))
    reach = list(itertools.accumulate((b for _, b in taken), max))
    added: list[tuple[int, int]] = []
    for kind, start, end in sorted(proposals, key=lambda p: (p[1], -p[2])):
        before = bisect.bisect_left(taken, (end, 0))
        if before and reach[before - 1] > start or added and added[-1][1] > start:
            continue
        found.append(Candidate(kind, start, end, False))
        added.append((start, end))
    places = sorted((c.start, c.end) for c in found)
    for c in found:
        _vote(c, text, places)
    return found


def _vote(c: Candidate, text: str, places: list[tuple[int, int]]) -> None:
    span = text[c.start : c.end]
    digits = _digits(span)
    before = text[max(0, c.start - CONTEXT) : c.start].lower()
    cues = set(_CUE_WORDS.findall(before)[-4:])
    if c.kind == "email":
        ending = re.split(r"[^A-Za-z]+", span.rstrip(")]}> "))[-1].lower()
        shape_ok, check = 1, 0
        listed = 1 if ending in DOMAIN_ENDINGS else -1
        own = EMAIL_CUES
    elif c.kind == "ip":
        shape_ok, check, own = 1, 0, ("ip", "host", "server")
        listed = -1 if span.startswith(("0.", "1.", "2.")) else 0
    elif c.kind == "card":
        groups = [len(g) for g in re.split(r"[ -]+", span)]
        shape_ok = 1 if len(groups) == 1 or set(groups[:-1]) == {4} else -1
        check, own = (1 if luhn(digits) else -1), CARD_CUES
        listed = 1 if digits[:1] in "3456" else -1
    else:
        groups = re.findall(r"[0-9]+", span)
        shape_ok = 1 if c.base or len(groups) >= 3 and len(groups[-1]) >= 3 else -1
        check = -1 if re.fullmatch(r"(19|20)\d\d[-. ]\d\d[-. ]\d\d.*", span) else 0
        listed = 1 if "(" in span or span.startswith(("+", "0")) else 0
        own = PHONE_CUES
    at = bisect.bisect_left(places, (c.start, c.end))
    beside = [*places[max(0, at - 1) : at], *places[at + 1 : at + 2]]
    near = any(a - c.end <= CONTEXT and c.start - b <= CONTEXT for a, b in beside)
    c.votes = (
        shape_ok,
        check,
        listed,
        1 if cues.intersection(own) else 0,
        -1 if cues.intersection(NEGATIVE_CUES) else 0,
        1 if near else 0,
    )
    before_mark, after_mark = text[c.start - 1 : c.start], text[c.end : c.end + 1]
    c.shape = (
        min(len(digits), 20),
        int(" " in span),
        int("-" in span),
        int("(" in span),
        int(before_mark.isalnum() or before_mark in ('"', "/", "=")),
        int(after_mark.isalnum() or after_mark in ('"', "/", "=")),
    )


def pattern_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``pattern`` and ``n``: the candidates of all texts, counted by votes and shape.

    Patterns are bounded by what votes and shapes can be, not by the documents.
    """
    bound_batches(docs.sparkSession)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for part in parts:
            for t in part.column(0).to_pylist():
                total.update(c.pattern for c in candidates(t or ""))
        rows = sorted(total.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
            names=["pattern", "n"],
        )

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "pattern string, n long")
    return counted.groupBy("pattern").agg(F.sum("n").alias("n"))


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS):
    """Expectation-maximisation over counted vote rows (1, -1, 0).

    Returns each row's probability to be personal data, the prior, and each
    labeler's probability of each vote given the truth (labeler, vote + 1, truth).
    """
    n = np.asarray(n, float)
    soft = 1 / (1 + np.exp(-(votes.sum(1).astype(float))))
    table = np.empty((votes.shape[1], 3, 2))
    prior = 0.5
    for _ in range(rounds):
        weight = np.stack([n * (1 - soft), n * soft], 1)
        prior = float(np.clip(weight[:, 1].sum() / max(n.sum(), 1e-9), 0.02, 0.98))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                # two imagined votes keep a labeler's sense: for means likelier true
                lean = {1: (1.0, 3.0), -1: (3.0, 1.0), 0: (1.0, 1.0)}[v]
                table[j, v + 1] = weight[votes[:, j] == v].sum(0) + np.array(lean)
            table[j] /= table[j].sum(0)
        logit = np.log(prior / (1 - prior)) + sum(
            np.log(table[j, votes[:, j] + 1, 1] / table[j, votes[:, j] + 1, 0])
            for j in range(votes.shape[1])
        )
        soft = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return soft, prior, table


@dataclass
class SpanClassifier:
    """Logistic weights of each kind over one-hot votes and shape."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def features(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        hot = [votes == v for v in (-1, 1)]
        digits = shape[:, :1] == np.arange(21)
        return np.hstack([*hot, digits, shape[:, 1:] > 0, np.ones((len(votes), 1))]).astype(float)

    def accept(self, c: Candidate, limit: float = ACCEPT) -> bool:
        if c.kind not in self.weights or c.votes[VOTES.index("checksum")] < 0:
            return False  # a failed checksum is proof, not one vote among others
        x = self.features(np.array([c.votes]), np.array([c.shape]))[0]
        return bool(1 / (1 + np.exp(-np.clip(x @ self.weights[c.kind], -30, 30))) >= limit)


def fit(docs: DataFrame, text: str = "text") -> SpanClassifier:
    """Reliabilities and classifier from the counted candidates of all texts."""
    by_kind: dict[str, list] = {}
    for row in sorted((r["pattern"], r["n"]) for r in pattern_counts(docs, text).collect()):
        kind, votes, shape = row[0].split("|")
        by_kind.setdefault(kind, []).append(
            ([*map(int, votes.split(","))], [*map(int, shape.split(","))], row[1])
        )
    weights = {}
    for kind, rows in by_kind.items():
        votes, shape, n = (np.array(x) for x in zip(*rows))
        soft, _, _ = reliabilities(votes, n)
        x = SpanClassifier.features(votes, shape)
        beta, share = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x.T @ (share * (p - soft)) + 1e-3 * beta
            curve = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x
            step = np.linalg.solve(curve + 1e-3 * np.eye(len(beta)), slope)
            beta -= step
            if np.abs(step).max() < 1e-6:
                break
        weights[kind] = beta
    return SpanClassifier(weights)


SPANS = T.ArrayType(
    T.StructType([field("kind", T.StringType()), field("start", T.LongType()), field("end", T.LongType())])
)


def all_spans(text: str, model: SpanClassifier) -> tuple[list, list]:
    """Base spans, and all spans with those the classifier adds."""
    if not any(c in text for c in "0123456789@[({<"):  # every pattern needs one of these
        return [], []
    found = candidates(text)
    base = [(c.kind, c.start, c.end) for c in found if c.base]
    added = [(c.kind, c.start, c.end) for c in found if not c.base and model.accept(c)]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_spans(
    docs: DataFrame, model: SpanClassifier, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` with ``base`` and ``spans``: lists of kind, start and end (code points,
    end exclusive) in whole texts, by kind (e-mail, IP, card, phone), then start.

    ``base`` has the pattern matches, ``spans`` also what the classifier adds where
    no base span lies.  Null and empty texts have none.  Work grows with a text's
    length only.  No shuffle; one row out per row in, and a column of ``keep``
    named as an output column gives way to it.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            pairs = [all_spans(t or "", model) for t in column.to_pylist()]
            listed = [
                [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in side]
                for side in (([p[0] for p in pairs]), ([p[1] for p in pairs]))
            ]
            return [pa.array(side, kind) for side in listed]

        return work

    fields = [field("base", SPANS), field("spans", SPANS)]
    return map_rows(docs, [F.col(text).cast("string")], fields, make, keep)


def mask_text(text: str, spans: Sequence[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap
    the covered stretch gets the first one's kind."""
    made, reached = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= reached:
            made += [text[reached:start], f"[{kind.upper()}]"]
        reached = max(reached, end)
    return "".join([*made, text[reached:]])


def mask(
    docs: DataFrame, model: SpanClassifier, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` and ``text`` with all spans masked; a null text stays null."""

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            made = []
            for t in column.to_pylist():
                spans = all_spans(t, model)[1] if t else []
                made.append(mask_text(t, spans) if spans else t)
            return [pa.array(made, pa.string())]

        return work

    return map_rows(docs, [F.col(text).cast("string")], [field(text, T.StringType())], make, keep)
