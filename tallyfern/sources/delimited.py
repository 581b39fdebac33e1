"""Split reading of CSV files whose quoted cells hold line breaks (S3).

A cut may fall inside a quoted cell, so a range of a file cannot tell by itself where
its records begin.  But at a line break only two things are possible, inside a quoted
cell or not, and the lines of a range turn each of them into one of them: a function on
two states.  One pass computes the function of every range; a running composition over
a file's ranges gives the state before each; a second pass reads the records.  A record
that spans ranges is put together from the ends that the first pass kept.

Ranges are the splits of Spark's own text source, so any store that Spark reads will do
and ``spark.sql.files.maxPartitionBytes`` sets their size.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyfern.sources.tables import cut_lineage

#: The number of cells of a record, beside its columns.
CELLS = "_cells"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"

_RANGE_FIELDS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("after_closed", T.IntegerType()),
        T.StructField("after_open", T.IntegerType()),
        T.StructField("rest_closed", T.BinaryType()),
        T.StructField("lead_open", T.BinaryType()),
        T.StructField("rest_open", T.BinaryType()),
        T.StructField("whole_closed", T.BooleanType()),
    ]
)


class Grammar:
    """Cells of a record: quoted ones hold separators, line breaks and doubled quotes.

    A quote inside an unquoted cell, or after a cell's closing quote, is an ordinary
    character; a cell that is never closed reaches to the end of the file.
    """

    def __init__(self, sep: str = ","):
        if len(sep) != 1 or sep in '"\r\n':
            raise ValueError(f"{sep!r} cannot separate cells")
        inside, rest = rb'[^"]*+(?:""[^"]*+)*+', rb"[^%s]*+" % re.escape(sep.encode())
        part = re.escape(sep.encode())
        cell = rb'"%s"%s|(?!")%s' % (inside, rest, rest)
        self.sep = sep.encode()
        self.closes = re.compile(rb'%s"%s(?:%s|\Z)' % (inside, rest, part))
        self.opens = re.compile(rb'(?:(?:%s)%s)*+"%s\Z' % (cell, part, inside))
        self.cell = re.compile(
            rb'"(%s)"(%s)(?:%s|\Z)|"(%s)\Z|(%s)(?:%s|\Z)' % (inside, rest, part, inside, rest, part)
        )

    def is_open_after(self, line: bytes, is_open: bool) -> bool:
        """Whether a quoted cell is open after a line, given whether one was before it."""
        if b'"' not in line:
            return is_open
        at = 0
        if is_open:
            closed = self.closes.match(line)
            if not closed:
                return True
            at = closed.end()
            if at == len(line) and not line.endswith(self.sep):
                return False
        return self.opens.match(line, at) is not None

    def cells(self, record: bytes) -> list[bytes]:
        if b'"' not in record:
            return record.split(self.sep)
        out, at = [], 0
        while True:
            found = self.cell.match(record, at)
            quoted, after, unclosed, plain = found.groups()
            if plain is not None:
                out.append(plain)
            elif unclosed is not None:
                out.append(unclosed.replace(b'""', b'"'))
            else:
                out.append(quoted.replace(b'""', b'"') + after)
            at = found.end()
            if at >= len(record):
                # A separator at the very end begins one more, empty cell.
                if unclosed is None and found.group().endswith(self.sep) and self._parted(found):
                    out.append(b"")
                return out

    @staticmethod
    def _parted(found: re.Match) -> bool:
        """Whether a match ended with a separator, not with the end of the record."""
        end = found.end(2) if found.group(2) is not None else found.end(4)
        return found.end() > end


class _Reading:
    """The lines of a range, read as if a quoted cell were open before it or not."""

    def __init__(self, grammar: Grammar, is_open: bool):
        self.grammar, self.open = grammar, is_open
        self.leading = is_open  # still in the record that began in an earlier range
        self.lead: bytes | None = None
        self.pending: list[bytes] = []
        self.whole = False  # a record began and ended here

    def add(self, line: bytes) -> bytes | None:
        """The record that this line ends, if it began in this range."""
        self.open = self.grammar.is_open_after(line, self.open)
        if self.open or self.pending:
            self.pending.append(line)
            if self.open:
                return None
            line, self.pending = b"\n".join(self.pending), []
        if self.leading:
            self.lead, self.leading = line, False
            return None
        self.whole = True
        return line

    def end(self) -> None:
        if self.leading:
            self.lead, self.pending = b"\n".join(self.pending), []


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines in the order of their ranges, with each one's file and range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    for batch in batches:
        for file, start, line in zip(*[c.to_pylist() for c in batch.columns]):
            yield (file, start), line


def _ranges(lines: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per range: its function, and the ends of records that cross its bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, closed, opened = None, None, None

        def row() -> pa.RecordBatch:
            closed.end()
            opened.end()
            rest = [b"\n".join(x.pending) if x.pending else None for x in (closed, opened)]
            values = [*key, int(closed.open), int(opened.open), rest[0], opened.lead, rest[1], closed.whole]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds)], names=_RANGE_FIELDS.names
            )

        for at, line in _by_range(batches):
            if at != key:
                if key is not None:
                    yield row()
                key, closed, opened = at, _Reading(grammar, False), _Reading(grammar, True)
            closed.add(line)
            opened.add(line)
        if key is not None:
            yield row()

    return lines.mapInArrow(run, _RANGE_FIELDS)


def states_before(ranges: DataFrame) -> DataFrame:
    """``file``, ``start`` and ``is_open``: the composition of all earlier ranges' functions.

    A function either ignores its argument, keeps it or swaps it: the last one that
    ignores it decides, and the swaps since then.
    """
    earlier = (
        Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    )
    swaps = F.col("after_closed") > F.col("after_open")
    fixed = F.col("after_closed") == F.col("after_open")
    upto = Window.partitionBy("file").orderBy("start")
    counted = ranges.select("file", "start", "after_closed", "after_open").withColumn(
        "n", F.sum(swaps.cast("int")).over(upto)
    )
    last = F.struct(F.col("after_closed").alias("value"), F.col("n"))
    return counted.select(
        "file",
        "start",
        F.last(F.when(fixed, last), ignorenulls=True).over(earlier).alias("last"),
        F.coalesce(F.max("n").over(earlier), F.lit(0)).alias("n"),
    ).select(
        "file",
        "start",
        F.expr("(coalesce(last.value, 0) + n - coalesce(last.n, 0)) % 2 = 1").alias("is_open"),
    )


def _stitched(ranges: DataFrame, states: DataFrame) -> DataFrame:
    """Records over several ranges: ``record``, and whether it is its file's first one."""
    own = ranges.join(states, ["file", "start"]).select(
        "file",
        "start",
        F.when(F.col("is_open"), F.col("lead_open")).alias("lead"),
        F.when(F.col("is_open"), F.col("rest_open")).otherwise(F.col("rest_closed")).alias("rest"),
        "whole_closed",
    )
    order = Window.partitionBy("file").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    begun = own.select("file", "start", F.when(F.col("rest").isNotNull(), F.col("start")).alias("begins"))
    begun = begun.withColumn("began", F.last("begins", ignorenulls=True).over(earlier)).drop("begins")
    pieces = own.join(begun, ["file", "start"])
    first = (F.col("start") == 0) & ~F.col("whole_closed")
    parts = pieces.where("rest IS NOT NULL").select(
        "file", F.col("start").alias("id"), "start", F.col("rest").alias("piece"), first.alias("first")
    )
    parts = parts.unionByName(
        pieces.where("lead IS NOT NULL AND began IS NOT NULL").select(
            "file", F.col("began").alias("id"), "start", F.col("lead").alias("piece"), F.lit(False).alias("first")
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("start", "piece")))
    return parts.groupBy("file", "id").agg(ordered.alias("pieces"), F.max("first").alias("first"))


def _parser(
    names: Sequence[str], wanted: Sequence[str], grammar: Grammar
) -> tuple[Callable[[list[bytes]], pa.RecordBatch], T.StructType]:
    places = [list(names).index(w) for w in wanted]
    schema = T.StructType([*[T.StructField(w, T.StringType()) for w in wanted], T.StructField(CELLS, T.IntegerType())])

    def parse(records: list[bytes]) -> pa.RecordBatch:
        cells = [grammar.cells(r) for r in records]
        columns = [
            pa.array([c[i].decode(errors="replace") if i < len(c) else None for c in cells], pa.string())
            for i in places
        ]
        counts = pa.array([len(c) for c in cells], pa.int32())
        return pa.RecordBatch.from_arrays([*columns, counts], names=schema.names)

    return parse, schema


def _record(line: bytes) -> bytes | None:
    """A record without its carriage return; None for a blank line."""
    line = line[:-1] if line.endswith(b"\r") else line
    return line if line.strip(b" \t") else None


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The cells of the first line of the first file that the path names."""
    return spark.read.csv(path, sep=sep, header=True, quote='"', escape='"').columns


def read_quoted_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = ","
) -> DataFrame:
    """The named columns of CSV files as strings, and ``_cells``, the cells of each record.

    Each file starts with a header.  Files are read in parallel ranges wherever the
    cuts fall.  A short record lacks its last columns (null); a record with more cells
    than the header has a larger ``_cells``, for the caller to reject and count; blank
    lines are no records; bytes that are not UTF-8 become the replacement character.
    The states of ranges pass through the driver, eight bytes for each range that begins
    inside a quoted cell.
    """
    grammar = Grammar(sep)
    names = header(spark, path, sep)
    parse, schema = _parser(names, columns or names, grammar)
    lines = _lines(spark, path)
    ranges = cut_lineage(_ranges(lines, grammar))
    states = states_before(ranges)
    opened: dict[str, list[int]] = {}
    for file, start in states.where("is_open").orderBy("file", "start").select("file", "start").collect():
        opened.setdefault(file, []).append(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reading, skip = None, None, False
        ready: list[bytes] = []
        size = 0
        for at, line in _by_range(batches):
            if at != key:
                key = at
                known = opened.get(at[0], [])
                place = bisect_left(known, at[1])
                reading = _Reading(grammar, place < len(known) and known[place] == at[1])
                skip = at[1] == 0
                line = line.removeprefix(BYTE_ORDER_MARK) if skip else line
            record = reading.add(line)
            if record is None:
                continue
            if skip:
                skip = False
                continue
            record = _record(record)
            if record is not None:
                ready.append(record)
                size += len(record)
                if len(ready) >= 2048 or size >= 16 << 20:
                    yield parse(ready)
                    ready, size = [], 0
        if ready:
            yield parse(ready)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [_record(b"\n".join(p["piece"] for p in x)) for x in batch.column(0).to_pylist()]
            yield parse([r for r in whole if r is not None])

    inside = lines.mapInArrow(run, schema)
    across = _stitched(ranges, states).where("NOT first").select("pieces").mapInArrow(joined, schema)
    return inside.unionByName(across)
