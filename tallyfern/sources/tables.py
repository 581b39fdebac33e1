"""Table sinks: parquet, append-only logs, lineage cuts, versioned chunk indexes.

Each added version of an index has a record of its keys: how many, their range and a
Bloom filter.  A reader tests the keys of a version against the filters of the later
ones, so only keys that may have a newer row are compared with the stored keys, and the
rows themselves are read where they lie.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Callable, Sequence
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.operators.chunking import one_per_key
from tallyfern.sources.paths import child_names, create_once, read_small, remove
from tallyfern.sources.session import shared_folder, small_side

VERSION = "version"
COMMITS = "_commits"
RECORDS = "_records"
#: Filter bits for each key, least and most bits, and bits set for a key.
BITS_PER_KEY, LEAST_BITS, MOST_BITS, HASHES = 10, 1 << 10, 1 << 23, 4
ADDED, WHOLE = "added", "whole"
#: Folders of the tables cut while :func:`cut_result` makes its table.
_CUTS: ContextVar[list[str] | None] = ContextVar("cuts", default=None)


def write_table(
    df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    """Overwrite a table; ``kind`` is parquet, csv or json."""
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later passes reread the
    table instead of recomputing it, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (cuts := _CUTS.get()) is not None:
        cuts.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_result(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, cut; every table cut while it was made is
    deleted once this one is written.  ``make`` must hand out no other table that reads
    them.  If it fails they stay."""
    token = _CUTS.set([])
    try:
        made = make()
        within = _CUTS.get()
    finally:
        _CUTS.reset(token)
    result = cut_lineage(made)
    for path in within:
        remove(spark, path)
    return result


def drop_cut(cut: DataFrame) -> None:
    """Delete the files of a table that :func:`cut_lineage` returned, once whatever
    reads it has been written."""
    spark = cut.sparkSession
    folder = shared_folder(spark).split(":", 1)[-1].lstrip("/")
    for file in cut.inputFiles():
        place = file.rpartition("/")[0]
        if place.rpartition("/")[2].startswith("cut-") and folder in place:
            remove(spark, place)


def _commits(spark: SparkSession, base: str) -> list[tuple[int, str, bool]]:
    """(number, version name, replaces all before) of an index, oldest first."""
    found = []
    for number in child_names(spark, f"{base}/{COMMITS}"):
        name, _, kind = read_small(spark, f"{base}/{COMMITS}/{number}").partition(" ")
        if name:  # a writer that died before it named its version left an empty file
            found.append((int(number), name, kind == WHOLE))
    return sorted(found)


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the committed versions of an index, oldest first."""
    return [number for number, _, _ in _commits(spark, base)]


def _commit(spark: SparkSession, base: str, name: str, kind: str, after: int | None = None) -> int:
    """Give a written version the next number.  Creating the number's file is what
    commits: of two writers that want one number, one gets the next.  With ``after``
    the number must directly follow it, else -1 is returned."""
    while True:
        known = child_names(spark, f"{base}/{COMMITS}")
        number = int(known[-1]) + 1 if known else 0
        if after is not None and number != after + 1:
            return -1
        if create_once(spark, f"{base}/{COMMITS}/{number:012d}", f"{name} {kind}"):
            return number


@dataclass(frozen=True)
class KeyRecord:
    """What a version's keys are: their number, range as text, filter, and columns."""

    rows: int
    low: str | None
    high: str | None
    bits: bytes
    schema: T.StructType

    def text(self) -> str:
        return json.dumps(
            {
                "rows": self.rows,
                "low": self.low,
                "high": self.high,
                "bits": base64.b64encode(zlib.compress(self.bits)).decode(),
                "schema": self.schema.jsonValue(),
            }
        )

    @classmethod
    def parse(cls, text: str) -> KeyRecord:
        own = json.loads(text)
        bits = zlib.decompress(base64.b64decode(own["bits"]))
        return cls(own["rows"], own["low"], own["high"], bits, T.StructType.fromJson(own["schema"]))


def _bit(key: Column, number: int, bits: int) -> Column:
    """Place of a key's ``number``-th bit in a filter of ``bits`` bits, a power of two."""
    return F.xxhash64(key, F.lit(number)).bitwiseAND(F.lit(bits - 1))


def key_record(rows: DataFrame, key: str) -> KeyRecord:
    """The record of a stored version; its filter is put together by the tasks, and at
    most ``MOST_BITS`` of it reach the driver.  More keys than that holds fill it, and a
    full filter admits every key."""
    return _record_of(rows, key, _key_facts(rows, key))


def _key_facts(rows: DataFrame, key: str) -> Row:
    """Rows, least and greatest key, and the most rows that share one."""
    name = F.col(key).cast("string")
    return (
        rows.groupBy(F.col(key))
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.min(name).alias("low"),
            F.max(name).alias("high"),
            F.max("n").alias("most"),
        )
        .first()
    )


def _record_of(rows: DataFrame, key: str, known: Row) -> KeyRecord:
    name = F.col(key)
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_KEY * known["n"]):
        bits *= 2
    places = F.array(*[_bit(name, i, bits) for i in range(HASHES)])
    words = (
        rows.where(name.isNotNull())
        .select(F.explode(places).alias("place"))
        .groupBy(F.shiftright("place", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 31 AS int))")).alias("set"))
        .collect()
    )
    filled = np.zeros(bits // 32, "<u4")
    for r in words:
        filled[r["word"]] = r["set"]
    return KeyRecord(known["n"], known["low"], known["high"], filled.tobytes(), rows.schema)


def _joint_filter(records: Sequence[KeyRecord]) -> bytes:
    """One filter for the keys of all records: a smaller filter repeats itself to the
    size of the largest, since a place keeps its lower digits."""
    size = max(len(r.bits) for r in records)
    joint = np.zeros(size, np.uint8)
    for r in records:
        joint |= np.tile(np.frombuffer(r.bits, np.uint8), size // len(r.bits))
    return joint.tobytes()


def may_hold(key: Column, records: Sequence[KeyRecord]) -> Column:
    """Whether a key may be among those of the records; false means that it is not."""
    known = [r for r in records if r.rows and r.low is not None]
    if not known:
        return F.lit(False)
    joint = _joint_filter(known)
    bits, text = F.lit(bytearray(joint)), key.cast("string")
    found = (text >= min(r.low for r in known)) & (text <= max(r.high for r in known))
    for i in range(HASHES):
        place = _bit(key, i, 8 * len(joint))
        byte = F.substring(bits, F.shiftright(place, 3).cast("int") + 1, F.lit(1))
        mask = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), place.bitwiseAND(F.lit(7)).cast("int") + 1)
        found &= F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(mask) != 0
    return F.coalesce(found, F.lit(False))


def _record(spark: SparkSession, base: str, name: str) -> KeyRecord | None:
    """A version's record; None for one that was written without."""
    text = read_small(spark, f"{base}/{RECORDS}/{name}") if name in child_names(spark, f"{base}/{RECORDS}") else ""
    return KeyRecord.parse(text) if text else None


def write_version(
    rows: DataFrame, base: str, name: str, key: str | None = "chunk_id", kind: str = ADDED
) -> int:
    """Write ``rows``, one per key, as the version ``name``; returns its number.

    A name belongs to one writer and batch.  A version that is committed already is
    left as it is, so a replayed batch changes nothing, and no writer ever touches
    another's rows.  Rows are written as they come; only if the written keys show
    repeats, which content ids do not, are the rows compared and written again.
    """
    spark = rows.sparkSession
    for number, known, _ in _commits(spark, base):
        if known == name:
            return number
    place = f"{base}/{VERSION}={name}"
    rows.write.mode("overwrite").parquet(place)
    if key is not None:
        stored = spark.read.schema(rows.schema).parquet(place)
        facts = _key_facts(stored, key)
        if facts["n"] and facts["most"] > 1:
            single = cut_lineage(one_per_key(stored, key))
            single.write.mode("overwrite").parquet(place)
            drop_cut(single)
            stored = spark.read.schema(rows.schema).parquet(place)
            facts = _key_facts(stored, key)
        record = f"{base}/{RECORDS}/{name}"
        remove(spark, record)  # of an earlier try that did not commit
        create_once(spark, record, _record_of(stored, key, facts).text())
    return _commit(spark, base, name, kind)


def upsert_version(rows: DataFrame, base: str, key: str = "chunk_id") -> int:
    """Insert or replace by key as a new version; returns its number.

    Only the new rows are written.  Readers take the newest row of each key.
    """
    return write_version(rows, base, uuid.uuid4().hex, key)


def replace_all(rows: DataFrame, base: str, name: str) -> int:
    """Commit ``rows`` as the whole table; readers of earlier versions keep theirs."""
    return write_version(rows, base, name, None, WHOLE)


def read_index(spark: SparkSession, base: str, key: str | None = "chunk_id") -> DataFrame:
    """The newest row of every key over the committed versions since the last whole one.

    The keys of each version are tested against the joint filter of the later ones;
    those that pass, a hundredth and the truly replaced ones, are compared with the stored
    keys of later versions.  Up to ``BROADCAST_ROWS`` replaced keys are sent to the
    index, whose rows then never move; of more, only the rows that may be replaced do.
    :func:`compact` keeps the number of versions small.
    """
    known = _commits(spark, base)
    if not known:
        raise FileNotFoundError(f"no index version in {base}")
    first = max((i for i, (_, _, whole) in enumerate(known) if whole), default=0)
    names = [name for _, name, _ in known[first:]]
    records = [_record(spark, base, n) for n in names]

    def read(some: Sequence[int]) -> DataFrame:
        paths = [f"{base}/{VERSION}={names[i]}" for i in some]
        reader = spark.read.option("basePath", base).option("mergeSchema", True)
        order = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
        schema = _merged_schema(spark, paths, [records[i] for i in some])
        return reader.schema(schema).parquet(*paths).withColumn(VERSION, order[F.col(VERSION)])

    every = range(len(names))
    rows = read(every)
    if len(names) == 1 or key is None:
        return rows.drop(VERSION)
    replaceable = F.lit(False)
    for i in every[:-1]:
        later = records[i + 1 :]
        held = F.lit(True) if None in later else may_hold(F.col(key), later)
        replaceable = F.when(F.col(VERSION) == i, held).otherwise(replaceable)
    newer = read(every[1:]).select(F.col(key).alias("_key"), F.col(VERSION).alias("_later"))
    candidates = rows.select(key, VERSION).where(replaceable).toDF("_key", "_old")
    dead = cut_lineage(
        candidates.join(newer.groupBy("_key").agg(F.max("_later").alias("_later")), "_key")
        .where("_later > _old")
        .select("_key", "_old")
    )
    if dead.isEmpty():
        return rows.drop(VERSION)
    gone = (F.col(key) == F.col("_key")) & (F.col(VERSION) == F.col("_old"))
    few = small_side(dead)
    if few is not dead:
        return rows.join(few, gone, "left_anti").drop(VERSION)
    moved = rows.where(replaceable).join(dead, gone, "left_anti")
    return rows.where(~replaceable).unionByName(moved).drop(VERSION)


def _merged_schema(
    spark: SparkSession, paths: Sequence[str], records: Sequence[KeyRecord | None]
) -> T.StructType:
    """All columns of the versions, with the version's name as text."""
    fields: dict[str, T.StructField] = {}
    for path, record in zip(paths, records):
        for f in (record.schema if record else spark.read.parquet(path).schema).fields:
            fields.setdefault(f.name, f)
    return T.StructType([*fields.values(), T.StructField(VERSION, T.StringType())])


def compact(spark: SparkSession, base: str, key: str = "chunk_id") -> int:
    """Write the current index as one whole version; -1 if another writer committed
    meanwhile, and the index is left as it was."""
    last = versions(spark, base)[-1]
    name = uuid.uuid4().hex
    read_index(spark, base, key).write.parquet(f"{base}/{VERSION}={name}")
    return _commit(spark, base, name, WHOLE, after=last)
