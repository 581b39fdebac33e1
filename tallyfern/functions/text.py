"""Column expressions for text: blanks, cleaning, windows and content ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as blanks (Unicode white space
# plus the four ASCII separators U+001C..U+001F).
BLANK_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
BLANKS = "".join(chr(c) for c in BLANK_CODEPOINTS)
REDACTION = r"(?iU)\bXX+\b"
LONG_DASHES = "\u2013\u2014"

CHUNK_SIZE = 300
CHUNK_OVERLAP = 50
MIN_CHUNK_LENGTH = 30
CHUNK_ID_LENGTH = 16


def strip(c: Column) -> Column:
    """Drop leading and trailing blanks (Spark's plain trim knows only U+0020)."""
    return F.trim(c, F.lit(BLANKS))


def is_nonempty(c: Column) -> Column:
    """True for text that is neither null nor blank; never null itself."""
    return F.coalesce(strip(c) != "", F.lit(False))


def clean_text(c: Column) -> Column:
    """Strip, unify dashes, drop redaction marks, squeeze blanks; null becomes ''.

    Blanks become spaces in the pass that unifies dashes, so the squeezing regex meets
    runs of spaces alone and leaves the single ones where they are.  The redaction
    regex is Unicode-aware and slow, so it only sees texts that hold two adjacent x at all.
    """
    others = BLANKS.replace(" ", "")
    plain = F.translate(c, LONG_DASHES + others, "--" + " " * len(others))
    redacted = F.when(
        F.contains(F.lower(plain), F.lit("xx")), F.regexp_replace(plain, REDACTION, "")
    ).otherwise(plain)
    squeezed = F.regexp_replace(redacted, "  +", " ")
    return F.coalesce(F.trim(squeezed), F.lit(""))


def is_valid_text(c: Column, min_length: int = MIN_CHUNK_LENGTH) -> Column:
    """True when the stripped text has at least ``min_length`` characters."""
    return F.coalesce(F.length(strip(c)) >= min_length, F.lit(False))


def chunk_text(
    c: Column,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    min_length: int = MIN_CHUNK_LENGTH,
) -> Column:
    """Overlapping character windows of a text as an array of strings.

    A text of at most ``size`` characters is its own only window.  Longer texts
    give a window at every ``size - overlap`` characters while the start lies
    inside the text.  Windows are stripped and those under ``min_length`` drop.

    One regex pass steps through the text and looks ahead for each window, so the cost
    is linear in the text: taking a substring per window would walk the text from its
    start every time.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    if overlap < 0 or size <= 0:
        raise ValueError("size must be positive and overlap not negative")
    ahead = f"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}"
    windows = F.regexp_extract_all(c, F.lit(ahead), F.lit(1))
    cut = F.transform(windows, strip)
    pieces = F.when(F.length(c) <= size, F.array(c)).otherwise(cut)
    return F.filter(pieces, lambda piece: F.length(piece) >= min_length)


def chunk_id(document_id: Column, index: Column, text: Column) -> Column:
    """Content address: leading hex digits of SHA-256 over ``document:index:text``."""
    payload = F.concat_ws(":", document_id.cast("string"), index.cast("string"), text)
    return F.substring(F.sha2(payload, 256), 1, CHUNK_ID_LENGTH)


def seeded_hash(seed: int, *keys: Column) -> Column:
    """md5 hex of the seed and the keys: a reproducible random order for rows."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
