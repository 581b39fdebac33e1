"""Main text of web pages (operator 9): a recurrent labeller of text blocks.

A page becomes a sequence of leaf blocks, each with its tag path and its words.  A
bidirectional LSTM in numpy reads hashed vectors of both along the page and decides
for every block, with the whole page as context, whether it belongs to the article.
It is trained here on pages of the table, whose semantic tags label their blocks,
laid out anew with other tags and with menus, notices, sidebars, adverts, forms and
comments around them.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.llm.batches import field, map_rows

# Elements whose content is never text, and those that bound a block.
SILENT = frozenset(
    "script style noscript template head svg iframe textarea select option "
    "math object canvas audio video".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that a new block of the same kind closes.
CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"),
    "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
BREAKS_P = BLOCK - {"button", "label"}

PATH_SIZE, WORD_SIZE, EXTRA = 32, 16, 8
FEATURES = PATH_SIZE + WORD_SIZE + EXTRA
HIDDEN = 12
#: Marks of a path that generated layouts have at most; outer ones of real pages fade.
PATH_DEPTH = 12
#: Expected number of pages the labeller is trained on: the bound of its sample.
SAMPLE_PAGES = 160
TRAIN_BLOCKS = 48
DENSE_WORDS, DENSE_LINKED = 12, 0.3
STEPS = 450
BATCH_PAGES = 64
SEED = 11

_TAG = re.compile(r"<(?:!--|/?[a-zA-Z][^\s/>]*|[!?])")
_REST = re.compile(r"""(?:[^"'>]++|"[^"]*"|'[^']*')*+>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z]{2,}")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def attributes_end(page: str, place: int) -> int:
    """Where the tag ends whose attributes begin here, '>' in quotes passed over; -1 if
    a quote or the tag never ends."""
    match = _REST.match(page, place)
    return match.end() if match else -1


def blocks_of(page: str) -> list[Block]:
    """Non-empty leaf blocks in page order, white space and references resolved."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = place = 0
    n = len(page)
    quotes = True
    opened: Counter[str] = Counter()
    ended: set[str] = set()  # silent elements that nothing closes any more

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                marks = [mark for name, marks in stack if name in BLOCK for mark in marks]
                found.append(Block(tuple(marks), text, linked))
            parts.clear()
        linked = 0

    def cut(first: int) -> None:
        opened.subtract(name for name, _ in stack[first:])
        del stack[first:]

    def drop(names: Sequence[str]) -> None:
        """Close the innermost open element of these names, not beyond a container."""
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                cut(i)
                return
            if stack[i][0] in ("table", "ul", "ol", "dl", "div", "section", "article"):
                return

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        linked += len(piece) if links else 0

    while place < n:
        match = _TAG.search(page, place)
        if not match:
            add(page[place:])
            break
        if match.start() > place:
            add(page[place : match.start()])
        mark = match[0]
        if mark == "<!--":
            end = page.find("-->", match.end())
            if end < 0:  # never closed: the rest of the page is a comment
                break
            place = end + 3
            continue
        end = attributes_end(page, match.end()) if quotes else -1
        if end < 0:  # a quote that nothing closes: from here on tags end at the first '>'
            quotes, end = False, page.find(">", match.end()) + 1
            if not end:
                break
        attributes, place = page[match.end() : end], end
        name = mark.lstrip("</").lower()
        if mark in ("<!", "<?"):
            continue
        if mark.startswith("</"):
            if name in BLOCK:
                close()
            if name == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    cut(i)
                    break
            continue
        if name in SILENT and name not in ended:
            stop = _closing(name).search(page, place)
            if stop:
                place = stop.end()
            elif name in ("script", "style"):  # never closed: so is the page's rest
                break
            else:
                ended.add(name)
            continue
        if name == "br":
            add(" ")
        elif name in BLOCK:
            close()
            if name in CLOSES:
                drop(CLOSES[name])
            elif name in BREAKS_P:
                drop(("p",))
        if name == "a":
            links += 1
        if name not in VOID and name in BLOCK and not attributes.endswith("/>"):
            words = [w.lower() for v in _NAMES.findall(attributes) for w in _NAME.findall(v)]
            stack.append((name, (f"<{name}", *words[:4])))
            opened[name] += 1
    close()
    return found


@functools.cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.IGNORECASE)


@functools.lru_cache(1 << 17)
def _bucket(word: str, size: int) -> int:
    """Bucket of a word, with the sign in the lowest bit."""
    return zlib.crc32(word.encode()) % (2 * size)


def features(blocks: Sequence[Block]) -> np.ndarray:
    """One row per block: hashed path, hashed words, and how it lies in the page."""
    out = np.zeros((len(blocks), FEATURES), np.float32)
    total = sum(len(b.text) for b in blocks) or 1
    before = 0
    for i, block in enumerate(blocks):
        row = out[i]
        for depth, mark in enumerate(reversed(block.path)):
            at = _bucket(mark, PATH_SIZE)
            weight = 1.0 if depth < 6 else 0.5 if depth < PATH_DEPTH else 0.5 * PATH_DEPTH / (depth + 1)
            row[at >> 1] += (1 if at & 1 else -1) * weight
        words = block.text.split()
        hashed = np.array([_bucket(w.lower(), WORD_SIZE) for w in words])
        signed = np.bincount(hashed >> 1, np.where(hashed & 1, 1.0, -1.0), WORD_SIZE)
        row[PATH_SIZE : PATH_SIZE + WORD_SIZE] = signed / np.sqrt(len(words))
        length = len(block.text)
        row[-EXTRA:] = (
            np.log1p(len(words)) / 4,
            min(1.0, block.linked / max(1, length)),
            before / total,
            length / total,
            block.text[-1] in ".!?…:;\"'",
            i / len(blocks),
            len(blocks) < 8,
            "©" in block.text,
        )
        before += length
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one output a block; ``weights`` by name."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @staticmethod
    def fresh(seed: int = SEED) -> Labeller:
        rng = np.random.default_rng(seed)
        weights = {}
        for side in "fb":
            weights["x" + side] = rng.normal(0, 0.15, (FEATURES, 4 * HIDDEN))
            weights["h" + side] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            weights["c" + side] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        weights["o"] = rng.normal(0, 0.15, (2 * HIDDEN + FEATURES, 1))
        weights["d"] = np.zeros(1)
        return Labeller(weights)

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """Hidden states of one direction; gates: forget, input, output, candidate."""
        w, (pages, steps, _) = self.weights, x.shape
        given = x @ w["x" + side] + w["c" + side]
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        states, saved = np.zeros((pages, steps, HIDDEN)), []
        order = range(steps) if side == "f" else range(steps - 1, -1, -1)
        for t in order:
            gates = given[:, t] + h @ w["h" + side]
            f, i, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            on = mask[:, t, None]
            new_c = on * (f * c + i * g)
            squashed = np.tanh(new_c)
            new_h = on * o * squashed
            if keep:
                saved.append((t, h, c, f, i, o, g, squashed, on))
            h, c = new_h, new_c
            states[:, t] = h
        return states, saved

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        sides = [self._pass(x, mask, side, keep) for side in "fb"]
        joined = np.concatenate([sides[0][0], sides[1][0], x], 2)
        return (joined @ self.weights["o"])[:, :, 0] + self.weights["d"][0], joined, sides

    def slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy, back through time."""
        w = self.weights
        logits, joined, sides = self.logits(x, mask, True)
        error = (_sigmoid(logits) - y) * mask / mask.sum()
        made = {"o": np.einsum("pti,pt->i", joined, error)[:, None], "d": np.array([error.sum()])}
        to_states = error[:, :, None] * w["o"][: 2 * HIDDEN, 0]
        for k, side in enumerate("fb"):
            to_x, to_h = np.zeros_like(w["x" + side]), np.zeros_like(w["h" + side])
            to_b = np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, h, c, f, i, o, g, squashed, on in reversed(sides[k][1]):
                dh = (dh + to_states[:, t, k * HIDDEN : (k + 1) * HIDDEN]) * on
                dc = (dc + dh * o * (1 - squashed**2)) * on
                gates = np.hstack(
                    [
                        dc * c * f * (1 - f),
                        dc * g * i * (1 - i),
                        dh * squashed * o * (1 - o),
                        dc * i * (1 - g**2),
                    ]
                )
                to_x += x[:, t].T @ gates
                to_h += h.T @ gates
                to_b += gates.sum(0)
                dh, dc = gates @ w["h" + side].T, dc * f
            made |= {"x" + side: to_x, "h" + side: to_h, "c" + side: to_b}
        return made

    def article(self, pages: Sequence[Sequence[Block]]) -> list[np.ndarray]:
        """For each page, which blocks belong to the article."""
        kept = [np.zeros(len(p), bool) for p in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        for a in range(0, len(order), BATCH_PAGES):
            part = order[a : a + BATCH_PAGES]
            x, mask = _padded([features(pages[i]) for i in part])
            logits = self.logits(x, mask)[0]
            for row, i in zip(logits, part):
                kept[i] = row[: len(pages[i])] > 0
        return kept


def _padded(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((len(rows), steps, FEATURES), np.float32), np.zeros((len(rows), steps))
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, 1
    return x, mask


# How pages commonly name their parts.
ARTICLE_PATHS = (
    ("<article",), ("<main", "<article"), ("<div", "post"), ("<div", "content"), ("<div", "entry", "content"),
    ("<section", "article"), ("<main",), ("<div", "story", "body"), ("<div",),
)
CLUTTER = {
    "menu": (
        ("<nav", "<ul", "<li"),
        ("<div", "menu", "<ul", "<li"),
        ("<ul", "navigation", "<li"),
        ("<header", "<nav", "<ul", "<li"),
    ),
    "header": (("<header",), ("<div", "header"), ("<div", "banner"), ("<header", "<p")),
    "notice": (
        ("<div", "cookie", "notice"),
        ("<div", "consent"),
        ("<div", "notice", "<p"),
        ("<section", "alert"),
        ("<dialog", "<p"),
    ),
    "advert": (
        ("<div", "ad"),
        ("<div", "ads"),
        ("<aside", "advert"),
        ("<div", "sponsored", "<p"),
        ("<div", "promo"),
    ),
    "sidebar": (
        ("<aside", "<ul", "<li"),
        ("<aside", "<p"),
        ("<div", "sidebar", "<ul", "<li"),
        ("<div", "related", "<li"),
        ("<aside", "sidebar", "<h3"),
    ),
    "form": (
        ("<form",),
        ("<form", "newsletter", "<p"),
        ("<form", "search", "<label"),
        ("<div", "subscribe", "<form"),
    ),
    "comment": (
        ("<section", "comments", "<p"),
        ("<div", "comments", "<div", "comment", "<p"),
        ("<ol", "commentlist", "<li", "<p"),
        ("<div", "comment", "<p"),
        ("<section", "comments", "<h2"),
    ),
    "share": (
        ("<div", "share", "<ul", "<li"),
        ("<div", "tags", "<ul", "<li"),
        ("<div", "breadcrumb", "<ul", "<li"),
    ),
    "footer": (
        ("<footer",),
        ("<footer", "<p"),
        ("<div", "footer", "<p"),
        ("<div", "copyright"),
        ("<footer", "<ul", "<li"),
    ),
}
BEFORE = ("menu", "header", "notice", "advert", "share", "sidebar")
AFTER = ("share", "form", "comment", "sidebar", "advert", "footer")
LEAVES = ("<h2", "<li", "<li", "<blockquote", "<pre", "<td")


def _semantic_label(block: Block) -> int:
    """1 inside an article or main element and outside its asides."""
    path = block.path
    inside = "<article" in path or "<main" in path
    clutter = {"<nav", "<footer", "<aside", "<form", "ad", "comments"}
    return int(inside and not clutter.intersection(path))


def _by_density(page: Sequence[Block]) -> list[Block]:
    """The page with its running text taken as an article: blocks of ``DENSE_WORDS``
    words or more, at most ``DENSE_LINKED`` of them links."""
    return [
        Block(("<article", "<p"), b.text, b.linked)
        if len(b.text.split()) >= DENSE_WORDS and b.linked <= DENSE_LINKED * len(b.text)
        else b
        for b in page
    ]


def laid_out(page: Sequence[Block], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page's article in a new layout: tags renamed, clutter around and within."""
    core = [b for b in page if _semantic_label(b)]
    other = [b for b in page if not _semantic_label(b)]
    words = [w for b in (*core, *other) for w in b.text.split()][:4000] or ["text"]
    outer = ("<html", "<body") if rng.random() < 0.8 else ()
    if rng.random() < 0.4:
        outer += (("<div", "page"), ("<div", "wrapper"), ("<div",), ("<div", "container"))[rng.integers(4)]

    def phrase(n: int) -> str:
        at = int(rng.integers(max(1, len(words) - n)))
        return " ".join(words[at : at + n])

    def clutter(kind: str) -> list[Block]:
        path = outer + CLUTTER[kind][rng.integers(len(CLUTTER[kind]))]
        listed = path[-1] == "<li"
        made = []
        for _ in range(int(rng.integers(2, 9)) if listed else int(rng.integers(1, 4))):
            long = kind in ("comment", "notice", "advert", "sidebar", "footer") and not listed
            text = phrase(int(rng.integers(1, 4 if listed else 40 if long else 8)))
            if kind == "footer" and rng.random() < 0.6:
                text = "© " + text
            made.append(Block(path[-PATH_DEPTH:], text, len(text) if listed and rng.random() < 0.9 else 0))
        return made

    def choose(kinds: Sequence[str]) -> list[str]:
        return [k for k in kinds if rng.random() < 0.45]

    inner = ARTICLE_PATHS[rng.integers(len(ARTICLE_PATHS))]
    blocks: list[Block] = []
    labels: list[int] = []
    for kind in choose(BEFORE):
        new = clutter(kind)
        blocks, labels = blocks + new, labels + [0] * len(new)
    middle = int(rng.integers(1, len(core) + 1)) if core and rng.random() < 0.25 else -1
    for i, b in enumerate(core):
        leaf = "<p"
        if i == 0 and rng.random() < 0.8:
            leaf = "<h1"
        elif rng.random() < 0.15:
            leaf = LEAVES[rng.integers(len(LEAVES))]
        around = {"<li": ("<ul",), "<td": ("<table", "<tr")}.get(leaf, ())
        path = (*outer, *inner, *around, leaf)
        share = len(b.text) // 3 if rng.random() < 0.1 else 0
        blocks.append(Block(path[-PATH_DEPTH:], b.text, share))
        labels.append(1)
        if i == middle:
            new = clutter(("advert", "share", "form")[rng.integers(3)])
            new = [Block((outer + inner + n.path[len(outer):])[-PATH_DEPTH:], n.text, n.linked) for n in new]
            blocks, labels = blocks + new, labels + [0] * len(new)
    for kind in choose(AFTER):
        new = clutter(kind)
        blocks, labels = blocks + new, labels + [0] * len(new)
    return blocks, labels


def train(pages: Sequence[Sequence[Block]], seed: int = SEED, steps: int = STEPS) -> Labeller:
    """Adam on pages as they are and laid out anew, windows of ``TRAIN_BLOCKS`` blocks.

    Where no page has an article or main element, running text makes the articles that
    are laid out anew, and no page is learnt from as it is.
    """
    rng = np.random.default_rng(seed)
    model = Labeller.fresh(seed)
    usable = [p for p in pages if any(map(_semantic_label, p))]
    told = bool(usable)
    if not told:
        usable = [p for p in map(_by_density, pages) if any(map(_semantic_label, p))]
    if not usable:
        return model
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    for step in range(1, steps + 1):
        rows, marks = [], []
        for i in rng.integers(len(usable), size=16).tolist():
            page = usable[i]
            if rng.random() < 0.45 and told:
                blocks, labels = list(page), [_semantic_label(b) for b in page]
            else:
                if len(page) > TRAIN_BLOCKS:  # shorter articles: their surroundings are seen
                    share = TRAIN_BLOCKS / len(page)
                    page = [b for b in page if not _semantic_label(b) or rng.random() < share]
                blocks, labels = laid_out(page, rng)
            if not blocks:
                continue
            first = int(rng.integers(max(1, len(blocks) - TRAIN_BLOCKS + 1)))
            if rng.random() < 0.7:
                first = 0 if rng.random() < 0.5 else max(0, len(blocks) - TRAIN_BLOCKS)
            rows.append(features(blocks)[first : first + TRAIN_BLOCKS])
            marks.append(labels[first : first + TRAIN_BLOCKS])
        x, mask = _padded(rows)
        y = np.zeros(mask.shape)
        for i, labels in enumerate(marks):
            y[i, : len(labels)] = labels
        rate = 0.02 * (1 - 0.9 * step / steps)
        for name, slope in model.slopes(x, mask, y).items():
            slope = np.clip(slope, -1, 1)
            m, v = moments[name]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            model.weights[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def fit(
    pages: DataFrame, page_html: str = "html", page_id: str = "page_id", sample_pages: int = SAMPLE_PAGES
) -> Labeller:
    """A labeller trained on a bounded sample of the table's pages, chosen by a hash of
    the id at a rate that the number of pages gives.  Pages are cut into blocks where
    they lie.  Without semantic tags the articles of training are the pages' running
    text; without any text the labeller is untrained."""
    ids = pages.where(F.col(page_id).isNotNull())
    rate = min(1.0, sample_pages / max(1, ids.count()))
    place = F.pmod(F.xxhash64(F.lit("pages"), page_id), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            pages = [blocks_of(p or "") for p in column.to_pylist()]
            listed = [[{"path": list(b.path), "text": b.text, "linked": b.linked} for b in p] for p in pages]
            kind = pa.struct([("path", pa.list_(pa.string())), ("text", pa.string()), ("linked", pa.int64())])
            return [pa.array(listed, pa.list_(kind))]

        return work

    kind = T.StructType(
        [
            field("path", T.ArrayType(T.StringType())),
            field("text", T.StringType()),
            field("linked", T.LongType()),
        ]
    )
    sample = ids.where(place < rate).withColumn("__id", F.col(page_id))
    fields = [field("blocks", T.ArrayType(kind))]
    cut = map_rows(sample, [F.col(page_html).cast("string")], fields, make, ["__id"])
    rows = sorted(((str(r["__id"]), r["blocks"]) for r in cut.collect()), key=lambda r: r[0])
    return train([[Block(tuple(b["path"]), b["text"], b["linked"]) for b in blocks] for _, blocks in rows])


def extract(
    pages: DataFrame,
    model: Labeller,
    page_html: str = "html",
    keep: Sequence[str] = ("page_id", "url"),
) -> DataFrame:
    """``keep`` with ``text``, the article's blocks joined by newlines, and ``n_chars``.

    Whole pages are read.  Null, empty and text-less pages have an empty text.
    Unclosed tags and quotes end where the page does; work grows with its length.
    No shuffle; one row out per row in, and a column of ``keep`` named as an output
    column gives way to it.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model.weights)

    def make():
        labeller = Labeller(shared.value)

        def work(column: pa.Array) -> list[pa.Array]:
            cut = [blocks_of(p or "") for p in column.to_pylist()]
            kept = labeller.article(cut)
            texts = ["\n".join(b.text for b, k in zip(p, on) if k) for p, on in zip(cut, kept)]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    fields = [field("text", T.StringType()), field("n_chars", T.LongType())]
    return map_rows(pages, [F.col(page_html).cast("string")], fields, make, keep)
