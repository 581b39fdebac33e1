"""WARC derivatives (operator 5): linked metadata and plain-text conversion records.

A WARC record is a row: its type, id, named fields and block.  Every response gives
two derived records that refer to it: ``metadata`` (its HTTP status and header
fields, links and sizes, as ``application/warc-fields``) and ``conversion`` (its
visible text).  Records of other types pass through untouched where asked.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.llm.batches import bound_batches, field, map_rows
from tallyfern.llm.html_extraction import attributes_end, blocks_of

# Fixed values of the format.
VERSION = "WARC/1.1"
HTTP_TYPE, FIELDS_TYPE, TEXT_TYPE = "application/http; msgtype=response", "application/warc-fields", "text/plain"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace

RECORD = T.StructType(
    [
        field("record_id", T.StringType()),
        field("warc_type", T.StringType()),
        field("target_uri", T.StringType()),
        field("warc_date", T.StringType()),
        field("refers_to", T.StringType()),
        field("content_type", T.StringType()),
        field("block_digest", T.StringType()),
        field("payload_digest", T.StringType()),
        field("fields", T.MapType(T.StringType(), T.StringType())),
        field("block", T.BinaryType()),
    ]
)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_ELEMENT = re.compile(r"<(?:!--|[a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']\S*))?""")
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")
_RAW_ENDS = {n: re.compile(rf"</{n}(?=[\s/>])", re.IGNORECASE) for n in ("script", "style", "textarea", "title")}
READ_BYTES = 1 << 20
#: Type of the row that stands for the unread rest of a damaged file.
DAMAGED = "x-damaged"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_name(*parts: str) -> str:
    """The same parts always give the same record id, whatever task writes it."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join(parts))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields in order, and body of an HTTP response."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        head, mark, body = block.partition(b"\n\n")
    if not head.startswith(b"HTTP/"):
        return "", [], block
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if lines[1:] and line[:1] in (" ", "\t"):  # a folded field goes on
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    named = (line.partition(":") for line in lines[1:] if ":" in line)
    return lines[0], [(k.strip(), v.strip()) for k, _, v in named], body


def gathered(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Named fields in order; the values of a name that stands more than once (whatever
    its case) are lines of one value, under its first spelling."""
    names: dict[str, str] = {}
    values: dict[str, list[str]] = {}
    for name, value in pairs:
        values.setdefault(names.setdefault(name.lower(), name), []).append(value)
    return {name: "\n".join(listed) for name, listed in values.items()}


def listed(headers: list[tuple[str, str]], name: str) -> list[str]:
    """The comma-parted values of all header fields of this name, in lower case."""
    values = (v for k, v in headers if k.lower() == name)
    return [part.strip().lower() for v in values for part in v.split(",") if part.strip()]


def unchunked(body: bytes) -> bytes:
    """The body without chunk marks; one that does not begin with a chunk stays as it is,
    and of one that breaks off, all that arrived is kept."""
    parts, place = [], 0
    while match := _CHUNK.match(body, place):
        size = int(match[1], 16)
        if not size:
            break
        parts.append(body[match.end() : match.end() + size])
        place = match.end() + size
        end = body[place : place + 2]
        if end[:1] == b"\n":
            place += 1
        elif end == b"\r\n":
            place += 2
        else:  # not a chunk's end: broken off, or never chunked
            if place < len(body):
                return body
            break
    else:
        if not parts:
            return body
    return b"".join(parts)


def inflated(body: bytes, coding: str) -> bytes | None:
    """The body without this content coding; None if it cannot be undone.  Of damaged
    data all that can be read is kept."""
    if coding == "identity":
        return body
    if coding in ("gzip", "x-gzip"):
        bits = 31
        if body[:2] != b"\x1f\x8b":  # already undone by the crawler
            return body
    elif coding == "deflate":
        zlib_head = len(body) > 1 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0
        bits = 15 if zlib_head else -15
    else:
        return None
    made, left = [], body
    while left:
        stream = zlib.decompressobj(bits)
        try:
            for i in range(0, len(left), 1 << 16):
                made.append(stream.decompress(left[i : i + (1 << 16)]))
                if stream.eof:
                    break
        except zlib.error:
            return b"".join(made) if any(made) else (body if coding == "deflate" else b"")
        if not stream.eof or bits != 31:
            break
        left = left[min(i + (1 << 16), len(left)) - len(stream.unused_data) :]
        if left[:2] != b"\x1f\x8b":
            break
    return b"".join(made)


def entity(headers: list[tuple[str, str]], body: bytes) -> tuple[bytes, bytes, list[str]]:
    """The payload (without transfer coding), its content (without content codings), and
    the codings that are left because they are not known here."""
    payload = body
    for coding in reversed(listed(headers, "transfer-encoding")):
        if coding == "chunked":
            payload = unchunked(payload)
        else:
            payload = inflated(payload, coding) or payload
    content, codings = payload, listed(headers, "content-encoding")
    while codings:
        plain = inflated(content, codings[-1])
        if plain is None:
            break
        content = plain
        codings.pop()
    return payload, content, codings


def links_of(page: str) -> list[str]:
    """Targets of the page's ``a`` elements in page order, references resolved; not those
    in comments, scripts, styles or titles.  Tags of any length; linear in the page."""
    found, place, quotes = [], 0, True
    while match := _ELEMENT.search(page, place):
        if match[0] == "<!--":
            place = page.find("-->", match.end()) + 3
            if place < 3:
                break
            continue
        end = attributes_end(page, match.end()) if quotes else -1
        if end < 0:  # a quote that nothing closes: from here on tags end at the first '>'
            quotes, end = False, page.find(">", match.end()) + 1
            if not end:
                break
        name, place = match[0][1:].lower(), end
        if name == "a":
            for attribute in _ATTRIBUTE.finditer(page, match.end(), end - 1):
                if attribute[1].lower() == "href":
                    target = attribute[2] or ""
                    if target[:1] in ("'", '"'):
                        target = target[1:-1]
                    found.append(" ".join(html.unescape(target).split()))
                    break
        elif name in _RAW_ENDS:
            stop = _RAW_ENDS[name].search(page, end)
            if not stop:
                break
            place = stop.end()
    return found


def decoded(body: bytes, header: str) -> str:
    match = _CHARSET.search(header) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(match[1] if match else "utf-8", "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def responses(
    pages: DataFrame, url: str = "url", page_html: str = "html", date: str = "1970-01-01T00:00:00Z",
    keep: Sequence[str] = ("page_id",),
) -> DataFrame:
    """``keep`` and a response record for each page.

    The id comes from address and content; equal pages have equal ids.  A null
    page has an empty body, a null address stays null.
    """
    bound_batches(pages.sparkSession)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

    def make():
        def work(urls: pa.Array, bodies: pa.Array) -> list[pa.Array]:
            rows = []
            for address, body in zip(urls.to_pylist(), bodies.to_pylist()):
                payload = (body or "").encode()
                block = head % len(payload) + payload
                mark = digest(payload)
                rows.append(
                    (record_name("response", address or "", mark), "response", address, date, None,
                     HTTP_TYPE, digest(block), mark, None, block)
                )
            return _columns(rows)

        return work

    inputs = [F.col(url).cast("string"), F.col(page_html).cast("string")]
    return map_rows(pages, inputs, RECORD.fields, make, keep)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    text, kinds = pa.string(), [pa.string()] * 8
    columns = list(zip(*rows)) or [()] * len(RECORD.fields)
    made = [pa.array(c, k) for c, k in zip(columns, [*kinds, pa.map_(text, text), pa.binary()])]
    return made


def _derive(row: dict) -> list[tuple]:
    """Metadata and conversion record of one response."""
    block = bytes(row["block"] or b"")
    status, headers, body = split_http(block)
    source = row["record_id"] or record_name("response", row["target_uri"] or "", digest(block))
    body, content, left = entity(headers, body)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    page = "" if left else decoded(content, kind)
    is_html = "html" in kind.lower() or not kind
    plain = "\n".join(b.text for b in blocks_of(page)) if is_html else page
    payload = row["payload_digest"] or digest(body)
    lines = [
        *([f"http-status: {status}"] if status else []),
        *(f"http-header-{k.lower()}: {v}" for k, v in headers),
        f"source-payload-digest: {payload}",
        f"source-block-digest: {row['block_digest'] or digest(block)}",
        f"payload-length: {len(body)}",
        *([f"coding-not-undone: {', '.join(left)}"] if left else []),
        f"text-length: {len(plain)}",
        *(f"outlink: {link}" for link in (links_of(page) if is_html else ())),
    ]
    made = []
    for name, content_type, content in (
        ("metadata", FIELDS_TYPE, "\r\n".join(lines) + "\r\n"),
        ("conversion", TEXT_TYPE, plain),
    ):
        raw = content.encode()
        # headers of the source that the derived record hands on
        extra = gathered(
            [("WARC-Source-Payload-Digest", payload), *((f"HTTP-{k}", v) for k, v in headers)]
        )
        made.append(
            (record_name(name, source), name, row["target_uri"], row["warc_date"], source,
             content_type, digest(raw), digest(raw) if name == "conversion" else None,
             list(extra.items()), raw)
        )
    return made


def derivatives(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Two rows for each response record: ``keep`` and the fields of ``RECORD``.

    ``refers_to`` of both is the response's id; the target address and date are the
    response's own; digests of its block and payload and its HTTP header fields are
    kept in the metadata and, as named fields, in both records; fields of equal name
    are lines of one value.  Chunked transfer and gzip or deflate content codings are
    undone; a body in another coding gives empty text, and the metadata name the coding.
    Records of other types give no rows.  A response without HTTP head is taken as a
    body, one with an empty or null block gives empty text, one without an id gets one
    from its address and block.  Equal responses give equal records.  Blocks of any
    length are read whole.  A column of ``keep`` named as a field of a record gives way
    to it.  No shuffle.
    """
    spark = records.sparkSession
    bound_batches(spark)
    kept = [c for c in keep if c.lower() not in {n.lower() for n in RECORD.names}]
    needed = ["record_id", "target_uri", "warc_date", "block_digest", "payload_digest", "block"]
    source = records.where(F.col("warc_type") == "response").select(*kept, *needed)
    schema = T.StructType([*source.schema.fields[: len(kept)], *RECORD.fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = part.select(needed).to_pylist()
            made = [r for row in rows for r in _derive(row)]
            twice = pa.array([i for i in range(part.num_rows) for _ in range(2)], pa.int64())
            carried = [part.column(i).take(twice) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*carried, *_columns(made)], names=schema.names)

    return source.mapInArrow(run, schema)


def serialised(row: dict) -> bytes:
    """A record as it stands in a WARC file, without the two line ends after it."""
    named = [
        ("WARC-Type", row["warc_type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Date", row["warc_date"]),
        ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Block-Digest", row["block_digest"]),
        ("WARC-Payload-Digest", row["payload_digest"]),
        *((k, v) for k, lines in dict(row["fields"] or {}).items() for v in (lines or "").split("\n")),
        ("Content-Type", row["content_type"]),
        ("Content-Length", str(len(row["block"] or b""))),
    ]
    lines = [VERSION, *(f"{k}: {v}" for k, v in named if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + bytes(row["block"] or b"")


def write_warc(records: DataFrame, path: str) -> None:
    """Write text records (metadata, conversion) as WARC files, one per partition.

    Spark's text writer commits them, so a lost executor leaves no half file.
    """

    def make():
        def work(*columns: pa.Array) -> list[pa.Array]:
            rows = zip(*(c.to_pylist() for c in columns))
            whole = [serialised(dict(zip(RECORD.names, r))) for r in rows]
            return [pa.array(whole, pa.binary()).cast(pa.string())]

        return work

    inputs = [F.col(n) for n in RECORD.names]
    lines = map_rows(records, inputs, [field("value", T.StringType())], make)
    lines.write.option("lineSep", "\r\n\r\n").mode("overwrite").text(path)


def _records(stream) -> Iterator[tuple]:
    own = {"warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-refers-to",
           "warc-block-digest", "warc-payload-digest", "content-type", "content-length"}
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        pairs: list[tuple[str, str]] = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            if line[:1] in (b" ", b"\t") and pairs:  # a folded field goes on
                pairs[-1] = (pairs[-1][0], f"{pairs[-1][1]} {line.decode('utf-8', 'replace').strip()}")
            else:
                pairs.append((name.strip(), value.strip()))
        got = {k.lower(): v for k, v in reversed(pairs)}
        length = got.get("content-length", "0")
        size = int(length) if length.isdigit() else 0
        block = stream.read(size)
        if len(block) < size:
            raise EOFError(f"a record of {size} bytes ends after {len(block)}")
        extra = list(gathered((n, v) for n, v in pairs if n.lower() not in own).items())
        yield (
            got.get("warc-record-id"), got.get("warc-type"), got.get("warc-target-uri"),
            got.get("warc-date"), got.get("warc-refers-to"), got.get("content-type"),
            got.get("warc-block-digest"), got.get("warc-payload-digest"), extra, block,
        )


def _file_records(path: str) -> Iterator[tuple]:
    """A file's records, one at a time; what is damaged ends it with a row that says so."""
    try:
        system, place = pafs.FileSystem.from_uri(path)
        with system.open_input_stream(place, compression=None) as opened:
            raw = io.BufferedReader(opened, READ_BYTES)
            packed = raw.peek(2)[:2] == b"\x1f\x8b"
            yield from _records(gzip.GzipFile(fileobj=raw) if packed else raw)
    except (EOFError, gzip.BadGzipFile, zlib.error) as error:
        extra = [("Path", path), ("Error", " ".join(str(error).split()))]
        yield (None, DAMAGED, None, None, None, None, None, None, extra, None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files of a folder, plain or compressed record by record.

    One task streams one file, a record at a time, so a file may be of any length and
    only a record must fit in memory.  Files are found by Spark and opened by their
    addresses in the tasks.  A damaged or cut file gives the records before the damage
    and one row of type ``x-damaged`` with its path and the error; no other file suffers.
    An empty folder or file gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    number = max(1, files.count())
    spread = files.repartitionByRange(number, "path")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for address in part.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                for record in _file_records(address):
                    rows.append(record)
                    held += len(record[-1] or b"")
                    if len(rows) == 256 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays(_columns(rows), names=RECORD.names)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays(_columns(rows), names=RECORD.names)

    return spread.mapInArrow(run, RECORD)
